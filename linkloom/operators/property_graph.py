"""Property graph as tables, and the extraction of a network from annotations.

``nodes(id, label, reversible, direction)``, ``id_nodes(label, node_info)``,
``rels(src, rel_type, dst, stoichiometry, pos)``; ``pos`` orders the participants of one side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.arrays import spread
from linkloom.functions.equations import equation_sides
from linkloom.session import cut

# Field names with their relationship type.
LINK_FIELDS = {
    "genes_connected": "CONNECTED_TO",
    "proteins_connected": "CONNECTED_TO",
    "reactions_connected": "CONNECTED_TO",
    "compounds_connected": "CONNECTED_TO",
    "has_subunits": "HAS_SUBUNIT",
    "in_complex": "IN_COMPLEX",
}
EQUATION_FIELDS = ["reaction_compounds", "stoichiometry"]
NA = ["NA", "N_A"]


def property_nodes(kv: DataFrame) -> DataFrame:
    """One node per entity of ``kv(entity_type, internal_id, k, v)``; reactions say whether they are reversible."""
    eq = F.when(F.col("k") == "reaction_compounds", F.contains(F.col("v"), F.lit("<=>")))
    return kv.groupBy(F.col("internal_id").alias("id"), F.initcap("entity_type").alias("label")).agg(
         F.bool_or(eq).alias("reversible"),
        F.max(F.when(F.col("k") == "reaction_compounds", equation_sides("v")["sign"])).alias("direction"),
    )


def property_id_nodes(kv: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One node per distinct id value, and the ``HAS_<id type>`` relations of the entities to them."""
    ids = kv.filter(~F.col("k").isin([*LINK_FIELDS, *EQUATION_FIELDS]))
    label = F.initcap(F.replace("k", F.lit("_"), F.lit(" ")))
    label = F.replace(label, F.lit(" "), F.lit("_"))
    nodes = ids.select(label.alias("label"), F.col("v").alias("node_info")).distinct()
    rels = ids.select(
        F.col("internal_id").alias("src"), F.concat(F.lit("HAS_"), F.upper("k")).alias("rel_type"),
        F.concat_ws(":", label, F.col("v")).alias("dst"), F.lit(None).cast("string").alias("stoichiometry"),
        F.lit(None).cast("int").alias("pos"),
    ).distinct()
    return nodes, rels


def property_rels(kv: DataFrame) -> DataFrame:
    """Relations between entities; the stoichiometry of an equation is taken by position."""
    kinds = F.create_map(*[F.lit(x) for kv_ in LINK_FIELDS.items() for x in kv_])
    links = kv.filter(F.col("k").isin(list(LINK_FIELDS))).select(
        F.col("internal_id").alias("src"), F.element_at(kinds, F.col("k")).alias("rel_type"), F.col("v").alias("dst"),
        F.lit(None).cast("string").alias("stoichiometry"), F.lit(None).cast("int").alias("pos"),
    )
    eq = kv.filter(F.col("k").isin(EQUATION_FIELDS)).groupBy("internal_id").agg(
        F.max(F.when(F.col("k") == "reaction_compounds", F.col("v"))).alias("eq"),
        F.max(F.when(F.col("k") == "stoichiometry", F.col("v"))).alias("st"),
    ).filter(F.col("eq").isNotNull() & F.col("st").isNotNull())
    parts = eq.select("internal_id", equation_sides("eq").alias("s"), F.split("st", ",").alias("st"))
    left = F.transform("s.left", lambda c: F.struct(F.lit("IS_SUBSTRATE").alias("rel_type"), c.alias("dst")))
    right = F.transform("s.right", lambda c: F.struct(F.lit("IS_PRODUCT").alias("rel_type"), c.alias("dst")))
    both = spread(parts, F.concat(left, right), "x", "internal_id", "st", pos="i")
    sides = both.select(
        F.col("internal_id").alias("src"), "x.rel_type", "x.dst", F.try_element_at("st", F.col("i") + 1).alias("stoichiometry"),
        F.col("i").alias("pos"),
    )
    return links.unionByName(sides).distinct()


def drop_na_nodes(id_nodes: DataFrame, rels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Remove id nodes whose value is ``NA``, together with the relations to them."""
    bad = id_nodes.filter(F.col("node_info").isin(NA)).select(F.concat_ws(":", "label", "node_info").alias("dst"))
    return id_nodes.filter(~F.col("node_info").isin(NA)), rels.join(bad, "dst", "left_anti").select(*rels.columns)


def _neighbours(of: DataFrame, rels: DataFrame, nodes: DataFrame, label: str, types: list[str]) -> DataFrame:
    """Nodes with ``label`` next to ``of(id)`` in either direction."""
    r = rels.filter(F.col("rel_type").isin(types))
    both = r.select(F.col("src").alias("id"), F.col("dst").alias("other")).unionByName(
        r.select(F.col("dst").alias("id"), F.col("src").alias("other")))
    near = both.join(of.select("id").distinct(), "id", "left_semi").select(F.col("other").alias("id")).distinct()
    return near.join(nodes.filter(F.col("label") == label), "id", "left_semi")


def network_from_annotations(annotations: DataFrame, nodes: DataFrame, id_rels: DataFrame, rels: DataFrame) -> DataFrame:
    """``(id, label)``: proteins that hold an annotation id, their reactions and genes, and the reactions' compounds.

    Each kind of node is written once, since the next kinds and whoever reads the result would walk to it again.
    """
    wanted = annotations.select(
        F.concat(F.lit("HAS_"), F.upper("id_type")).alias("rel_type"), F.col("id_value")).distinct()
    holder = id_rels.select(F.col("src").alias("id"), "rel_type", F.expr("substring(dst, locate(':', dst) + 1)").alias("id_value"))
    protein = cut(holder.join(wanted, ["rel_type", "id_value"], "left_semi").select("id").distinct().join(
        nodes.filter(F.col("label") == "Protein"), "id", "left_semi"))
    reaction = cut(_neighbours(protein, rels, nodes, "Reaction", ["CONNECTED_TO"]))
    gene = _neighbours(protein, rels, nodes, "Gene", ["CONNECTED_TO"])
    compound = _neighbours(reaction, rels, nodes, "Compound", ["IS_SUBSTRATE", "IS_PRODUCT"])
    tag = lambda df, label: df.select("id", F.lit(label).alias("label"))
    return cut(tag(protein, "Protein").unionByName(tag(reaction, "Reaction")).unionByName(tag(gene, "Gene")).unionByName(tag(compound, "Compound")))


def rels_to_kv(chosen: DataFrame, id_rels: DataFrame, rels: DataFrame, nodes: DataFrame) -> DataFrame:
    """Graph rows of the chosen nodes back to ``(entity_type, internal_id, k, v)``, equations rebuilt."""
    keep = chosen.select("id", "label").distinct()
    inside = keep.select(F.col("id").alias("dst"), F.col("label").alias("dst_label"))
    ids = id_rels.join(keep.select(F.col("id").alias("src"), "label"), "src").select(
        F.lower("label").alias("entity_type"), F.col("src").alias("internal_id"),
        F.lower(F.expr("substring(rel_type, 5)")).alias("k"), F.expr("substring(dst, locate(':', dst) + 1)").alias("v"))
    own = rels.join(keep.select(F.col("id").alias("src"), "label"), "src").join(inside, "dst")
    field = F.when(F.col("rel_type") == "HAS_SUBUNIT", "has_subunits").when(F.col("rel_type") == "IN_COMPLEX", "in_complex").when(
        F.col("rel_type") == "CONNECTED_TO", F.concat(F.lower("dst_label"), F.lit("s_connected")))
    links = own.select(F.lower("label").alias("entity_type"), F.col("src").alias("internal_id"), field.alias("k"), F.col("dst").alias("v")).filter(
        F.col("k").isNotNull())
    eq = own.filter(F.col("rel_type").isin("IS_SUBSTRATE", "IS_PRODUCT")).groupBy("src").agg(
        F.array_sort(F.collect_list(F.struct((F.col("rel_type") == "IS_PRODUCT").alias("right"), "pos", F.col("dst").alias("id"), F.col("stoichiometry").alias("st")))).alias("p")
    ).join(nodes.select(F.col("id").alias("src"), "direction"), "src")
    side = lambda right: F.array_join(F.transform(F.filter("p", lambda x: x["right"] == F.lit(right)), lambda x: x["id"]), " + ")
    text = eq.select("src", F.concat_ws(" ", side(False), "direction", side(True)).alias("eq"), F.array_join(F.transform("p", lambda x: x["st"]), ",").alias("st"))
    back = text.select(F.lit("reaction").alias("entity_type"), F.col("src").alias("internal_id"), F.explode(F.array(
        F.struct(F.lit("reaction_compounds").alias("k"), F.col("eq").alias("v")),
        F.struct(F.lit("stoichiometry").alias("k"), F.col("st").alias("v")))).alias("x")).select("entity_type", "internal_id", "x.k", "x.v")
    return ids.unionByName(links).unionByName(back)


def network_sif(chosen: DataFrame, rels: DataFrame) -> DataFrame:
    """SIF edges among the chosen nodes, with ``cplx`` and ``subu`` edges between proteins."""
    a = chosen.select(F.col("id").alias("src"), F.lower(F.substring("label", 1, 1)).alias("sl"))
    b = chosen.select(F.col("id").alias("dst"), F.lower(F.substring("label", 1, 1)).alias("dl"))
    r = rels.join(a, "src").join(b, "dst")
    kind = (
        F.when(F.col("rel_type") == "IN_COMPLEX", "cplx").when(F.col("rel_type") == "HAS_SUBUNIT", "subu")
        .when(F.col("rel_type") == "IS_SUBSTRATE", "cr").when(F.col("rel_type") == "IS_PRODUCT", "rc")
        .otherwise(F.concat("sl", "dl"))
    )
    swap = F.col("rel_type") == "IS_SUBSTRATE"  # stored from the reaction, written from the compound
    return r.select(
        F.when(swap, F.col("dst")).otherwise(F.col("src")).alias("SOURCE"), kind.alias("INTERACTION"),
        F.when(swap, F.col("src")).otherwise(F.col("dst")).alias("TARGET"),
    ).distinct()
