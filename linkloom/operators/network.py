"""Networks of compounds and reactions: building, expanding, dead ends, components, reports.

Network edges are ``(src, dst)`` rows; one end is a reaction (prefix ``R_`` of a model or ``RD_`` of an annotation).
An optional ``model`` column keeps many models apart in one run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.equations import equation_sides
from linkloom.operators.components import component_counts, connected_components
from linkloom.operators.samples import Pairs, organism_proteins
from linkloom.session import cut

ADDED = "RD_"
MODEL = "R_"
OUTSIDE = "_e"
COMPARTMENTS = ["c", "e", "p"]


def is_reaction(col: str):
    return F.col(col).startswith(MODEL) | F.col(col).startswith(ADDED)


def participants_of_text(reactions: DataFrame, column: str = "reaction_compounds") -> DataFrame:
    """``(reaction_key, side, pos, compound_key)`` from id equations."""
    s = reactions.select("reaction_key", equation_sides(column).alias("s")).filter(F.col("s.sign").isNotNull())
    side = lambda name: s.select("reaction_key", F.lit(name).alias("side"), F.posexplode(f"s.{name}").alias("pos", "compound_key"))
    return side("left").unionByName(side("right"))


def model_network(participant: DataFrame) -> DataFrame:
    """Base network: reactant to reaction, reaction to product."""
    left = F.col("side") == "left"
    return participant.select(
        F.when(left, F.col("compound_key")).otherwise(F.col("reaction_key")).alias("src"),
        F.when(left, F.col("reaction_key")).otherwise(F.col("compound_key")).alias("dst"),
    ).distinct()


def match_species(compounds: DataFrame, species: DataFrame) -> DataFrame:
    """``(compound_key, species_key)`` on any shared id; a species goes to its smallest compound only.

    Inputs: ``(entity_key, id_type, id_value)`` of compounds and of model species. Only the smallest compound per
    id is kept before the join, so an id held by very many compounds yields one row per species, not their product.
    """
    best = compounds.groupBy("id_type", "id_value").agg(F.min("entity_key").alias("compound_key"))
    s = species.select(F.col("entity_key").alias("species_key"), "id_type", "id_value").distinct()
    return s.join(best, ["id_type", "id_value"]).groupBy("species_key").agg(F.min("compound_key").alias("compound_key")).select(
        "compound_key", "species_key"
    )


def annotated_network(participant: DataFrame, species_map: DataFrame) -> DataFrame:
    """Network of annotated reactions, compounds replaced by their species where there are any."""
    return model_network(annotated_participants(participant, species_map))


def annotated_participants(participant: DataFrame, species_map: DataFrame) -> DataFrame:
    return participant.join(species_map, "compound_key", "left").select(
        F.concat(F.lit(ADDED), "reaction_key").alias("reaction_key"), "side",
        F.coalesce("species_key", "compound_key").alias("compound_key"),
        F.col("species_key").isNotNull().alias("mapped"),
    )


def expanded_network(base: DataFrame, participant: DataFrame, species_map: DataFrame, stoplist: DataFrame | None = None,
                     only_connected: bool = False) -> tuple[DataFrame, DataFrame]:
    """Base network plus annotated reactions; returns the edges and the rejected reactions.

    Stop-listed compounds ``(compound_key)`` get no edge. With ``only_connected`` a reaction needs a mapped compound.
    """
    parts = annotated_participants(participant, species_map)
    rejected = parts.groupBy("reaction_key").agg(F.bool_or("mapped").alias("touches")).filter(~F.col("touches"))
    rejected = rejected.select("reaction_key") if only_connected else rejected.select("reaction_key").limit(0)
    if only_connected:
        parts = parts.join(rejected, "reaction_key", "left_anti")
    if stoplist is not None:
        parts = parts.join(stoplist.select("compound_key").distinct(), "compound_key", "left_anti")
    return base.select("src", "dst").unionByName(model_network(parts)).distinct(), rejected


def dead_ends(edges: DataFrame) -> DataFrame:
    """Metabolites inside the cell that are only produced or only consumed: ``(node, role)``."""
    made = edges.filter(is_reaction("src") & ~F.col("dst").endswith(OUTSIDE)).select(F.col("dst").alias("node"), F.lit(True).alias("made"))
    used = edges.filter(is_reaction("dst") & ~F.col("src").endswith(OUTSIDE)).select(F.col("src").alias("node"), F.lit(False).alias("made"))
    both = made.unionByName(used).groupBy("node").agg(
        F.bool_or("made").alias("produced"), F.bool_or(~F.col("made")).alias("consumed")
    )
    return both.filter(F.col("produced") != F.col("consumed")).select(
        "node", F.when(F.col("produced"), "produced").otherwise("consumed").alias("role")
    )


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def n_metabolites(edges: DataFrame) -> DataFrame:
    """Number of metabolites inside the cell."""
    return nodes_of(edges).filter(~is_reaction("node") & ~F.col("node").endswith(OUTSIDE)).agg(F.count("*").alias("n_metabolites"))


def compare_dead_ends(base: DataFrame, expanded: DataFrame) -> DataFrame:
    """One row: dead ends of both networks, the newly connected ones, and their share of all nodes in percent.

    Networks and dead ends are written once, since each is read several times.
    """
    base, expanded = cut(base), cut(expanded)
    d1, d2 = cut(dead_ends(base)), cut(dead_ends(expanded))
    fixed = d1.select("node").join(d2.select("node"), "node", "left_anti")
    count = lambda df, name: df.agg(F.count("*").alias("v")).select(F.lit(name).alias("k"), "v")
    rows = count(d1, "d1").unionByName(count(d2, "d2")).unionByName(count(fixed, "fixed")).unionByName(
        count(nodes_of(base), "n1")).unionByName(count(nodes_of(expanded), "n2"))
    v = lambda k: F.max(F.when(F.col("k") == k, F.col("v")))
    share = lambda a, b: F.round(100 * v(a) / v(b), 3)
    return rows.agg(
        v("d1").alias("base_dead_ends"), share("d1", "n1").alias("base_pct"),
        v("d2").alias("expanded_dead_ends"), share("d2", "n2").alias("expanded_pct"),
        v("fixed").alias("newly_connected"), share("fixed", "n1").alias("newly_connected_pct"),
    )


def component_sizes(edges: DataFrame) -> DataFrame:
    """Per weakly connected component: compounds and reactions."""
    return component_counts(edges, n_compounds=~is_reaction("node"), n_reactions=is_reaction("node"))


def size_histogram(sizes: DataFrame) -> DataFrame:
    """How many components have a given number of compounds or of reactions."""
    rows = sizes.select(F.explode(F.array(
        F.struct(F.lit("compounds").alias("kind"), F.col("n_compounds").alias("size")),
        F.struct(F.lit("reactions").alias("kind"), F.col("n_reactions").alias("size")),
    )).alias("x")).select("x.*")
    return rows.groupBy("kind", "size").agg(F.count("*").alias("n_components"))


def network_report(edges: DataFrame, sizes: DataFrame | None = None) -> DataFrame:
    """One row: share of reactions in the component with most reactions, component count, compartment counts."""
    sizes = component_sizes(edges) if sizes is None else sizes
    largest = sizes.agg(
        F.count("*").alias("n_components"), F.sum("n_reactions").alias("n_reactions"),
        F.round(100 * F.max("n_reactions") / F.sum("n_reactions"), 3).alias("pct_reactions_largest"),
    )
    per = nodes_of(edges).agg(*[F.count_if(F.col("node").endswith(f"_{c}")).alias(f"n_{c}") for c in COMPARTMENTS])
    # both sides are single-row aggregates; the constant key keeps this an ordinary equi join
    return largest.withColumn("one", F.lit(1)).join(per.withColumn("one", F.lit(1)), "one").drop("one")


def same_reaction(participant: DataFrame, species_map: DataFrame, model_participant: DataFrame) -> DataFrame:
    """``(reaction_key, model_reaction)``: all participants mapped and both sides equal, in either direction.

    Sides are compared by order-free set hashes, so no side is collected into one row.
    """
    mapped = participant.join(species_map.groupBy("compound_key").agg(F.min("species_key").alias("species_key")), "compound_key", "left")
    ours = _side_sets(mapped.select("reaction_key", "side", F.col("species_key").alias("item")))
    theirs = _side_sets(model_participant.select("reaction_key", "side", F.col("compound_key").alias("item"))).select(
        F.col("reaction_key").alias("model_reaction"), F.col("left").alias("ml"), F.col("right").alias("mr")
    )
    either = theirs.unionByName(theirs.select("model_reaction", F.col("mr").alias("ml"), F.col("ml").alias("mr")))
    return ours.join(either, (F.col("left") == F.col("ml")) & (F.col("right") == F.col("mr"))).groupBy("reaction_key").agg(
        F.min("model_reaction").alias("model_reaction")
    )


def _side_sets(items: DataFrame) -> DataFrame:
    """Per reaction one text per side that identifies its item set; reactions with an unmapped item or empty side drop out."""
    one = items.distinct().groupBy("reaction_key").agg(
        F.count_if(F.col("item").isNull()).alias("open"),
        *[
            F.concat_ws(
                ":",
                F.hex(F.bit_xor(F.when(F.col("side") == s, F.xxhash64("item")))),
                F.hex(F.bit_xor(F.when(F.col("side") == s, F.xxhash64(F.lit("second"), "item")))),
                F.count_if(F.col("side") == s),
            ).alias(s)
            for s in ("left", "right")
        ],
        F.count_if(F.col("side") == "left").alias("nl"), F.count_if(F.col("side") == "right").alias("nr"),
    )
    return one.filter((F.col("open") == 0) & (F.col("nl") > 0) & (F.col("nr") > 0)).select("reaction_key", "left", "right")


def reactions_not_in_model_by_participants(reactions: DataFrame, participant: DataFrame, species_map: DataFrame,
                                           model_participant: DataFrame) -> DataFrame:
    return reactions.join(same_reaction(participant, species_map, model_participant), "reaction_key", "left_anti")


def reactions_not_in_model_by_id(reaction_ids: DataFrame, model_ids: DataFrame, id_types: tuple[str, ...] = ("kegg", "metacyc")) -> DataFrame:
    """Reactions without an id of the model; reactions that have none of the id types are dropped."""
    ids = reaction_ids.filter(F.col("id_type").isin(list(id_types)))
    known = ids.join(model_ids.select("id_type", "id_value").distinct(), ["id_type", "id_value"], "left_semi")
    return ids.select("reaction_key").distinct().join(known.select("reaction_key").distinct(), "reaction_key", "left_anti")


def proteins_in_sample(protein_ids: DataFrame, annotations: DataFrame, id_types: tuple[str, ...] = ("enzyme_ec", "metacyc"),
                       expand: bool = True) -> DataFrame | Pairs:
    """``(sample, protein_key)``: proteins that hold an annotation of the sample; without ``expand`` as pairs of sets, which the filters below take too."""
    return organism_proteins(protein_ids.filter(F.col("id_type").isin(list(id_types))), annotations, expand)


def _kept(proteins: DataFrame | Pairs, keys: DataFrame, how: str) -> DataFrame | Pairs:
    """Proteins that are (``left_semi``) or are not (``left_anti``) in ``keys (protein_key)``."""
    if isinstance(proteins, Pairs):
        return proteins.keep_right(keys.select(F.col("protein_key").alias("right")), how)
    return proteins.join(keys, "protein_key", how)


def with_reaction(proteins: DataFrame | Pairs, edge: DataFrame) -> DataFrame | Pairs:
    """Proteins with at least one reaction."""
    has = edge.filter(F.col("edge_type") == "pr").select(F.col("src_key").alias("protein_key")).unionByName(
        edge.filter(F.col("edge_type") == "rp").select(F.col("dst_key").alias("protein_key"))
    ).distinct()
    return _kept(proteins, has, "left_semi")


def proteins_not_in_model(proteins: DataFrame | Pairs, protein_ids: DataFrame, model_ids: DataFrame) -> DataFrame | Pairs:
    """Proteins none of whose enzyme numbers is in the model; proteins without one are dropped."""
    ec = protein_ids.filter(F.col("id_type") == "enzyme_ec").select("protein_key", "id_type", "id_value")
    known = ec.join(model_ids.select("id_type", "id_value").distinct(), ["id_type", "id_value"], "left_semi").select("protein_key").distinct()
    return _kept(_kept(proteins, ec.select("protein_key").distinct(), "left_semi"), known, "left_anti")


def reactions_of(proteins: DataFrame | Pairs, edge: DataFrame) -> DataFrame:
    """Reactions linked to the proteins."""
    found = proteins.right_keys().withColumnRenamed("right", "protein_key") if isinstance(proteins, Pairs) else proteins.select("protein_key").distinct()
    links = edge.filter(F.col("edge_type") == "pr").select(F.col("src_key").alias("protein_key"), F.col("dst_key").alias("reaction_key")).unionByName(
        edge.filter(F.col("edge_type") == "rp").select(F.col("dst_key").alias("protein_key"), F.col("src_key").alias("reaction_key")))
    return links.join(found, "protein_key", "left_semi").select("reaction_key").distinct()


def funnel(stages: dict[str, DataFrame | Pairs]) -> DataFrame:
    """``(pos, stage, n)``: row count after each filter, in one job. Stages that build on one another are best ``cut``."""
    total = lambda x: x.count() if isinstance(x, Pairs) else x.agg(F.count("*").alias("n"))
    out = None
    for i, (name, df) in enumerate(stages.items()):
        one = total(df).select(F.lit(i).alias("pos"), F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def sif_expansion(model_edges: DataFrame, expanded_edges: DataFrame) -> DataFrame:
    """Edges with a flag: 0 for model edges, 1 for edges only the expansion has."""
    new = expanded_edges.select("src", "dst").distinct().join(model_edges.select("src", "dst").distinct(), ["src", "dst"], "left_anti")
    rows = model_edges.select("src", "dst").distinct().withColumn("EXPANSION", F.lit(0)).unionByName(new.withColumn("EXPANSION", F.lit(1)))
    kind = F.when(is_reaction("src"), "rc").otherwise("cr")
    return rows.select(F.col("src").alias("SOURCE"), kind.alias("INTERACTION"), F.col("dst").alias("TARGET"), "EXPANSION")
