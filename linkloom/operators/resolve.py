"""Entity resolution: records of several sources become one entity each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkloom.functions.text import is_ec
from linkloom.operators.components import connected_components
from linkloom.operators.expand import end_type
from linkloom.operators.lookup import name_search
from linkloom.operators.matching import DEFAULTS, MatchConfig, features, match_links, participant_signature
from linkloom.session import cut


def clusters(xref: DataFrame, config: MatchConfig, forced_pairs: DataFrame | None = None) -> DataFrame:
    """``(entity_key, cluster_key)`` for one entity type; the smallest member names the cluster.

    ``forced_pairs(left_key, right_key)`` are joined whatever their score.
    """
    links = match_links(features(xref, config), config)
    if forced_pairs is not None:
        links = links.unionByName(forced_pairs.select(F.col("left_key").alias("src"), F.col("right_key").alias("dst")))
    alone = xref.select(F.col("entity_key").alias("src"), F.lit(None).cast("string").alias("dst")).distinct()
    return connected_components(links.unionByName(alone)).select(
        F.col("node").alias("entity_key"), F.col("component").alias("cluster_key")
    )


def merge_xref(xref: DataFrame, cluster: DataFrame) -> DataFrame:
    """Xref of the merged entities: counts of all members are added, sources are kept as a sorted list.

    A ``cluster`` with a column ``entity_type`` holds clusters of several types, whose keys may be the same.
    """
    return (
        xref.join(cluster, _own_key(cluster))
        .groupBy("entity_type", F.col("cluster_key").alias("entity_key"), "id_type", "id_value")
        .agg(F.sum("n").cast("bigint").alias("n"), F.array_sort(F.collect_set("source_db")).alias("sources"))
    )


def _own_key(cluster: DataFrame) -> list[str]:
    return [c for c in ("entity_type", "entity_key") if c in cluster.columns]


def rekey_edges(edge: DataFrame, cluster: DataFrame) -> DataFrame:
    """Links moved from members to their cluster, on both ends, once per source.

    Where ``cluster`` tells entity types, each end is looked up among the entities of its own type.
    """
    typed = "entity_type" in cluster.columns

    def end(key: str, to: str, side: int):
        m = cluster.select(F.col("entity_key").alias(key), F.col("cluster_key").alias(to), *([F.col("entity_type").alias(f"{to}_type")] if typed else []))
        return m, [key, *([f"{to}_type"] if typed else [])]

    src, on_src = end("src_key", "s", 0)
    dst, on_dst = end("dst_key", "d", 1)
    if typed:
        edge = edge.withColumns({"s_type": end_type("edge_type", 0), "d_type": end_type("edge_type", 1)})
    return (
        edge.join(src, on_src, "left").join(dst, on_dst, "left")
        .select("edge_type", F.coalesce("s", "src_key").alias("src_key"), F.coalesce("d", "dst_key").alias("dst_key"),
                "source_db")
        .distinct()
    )


def rekey_participants(participant: DataFrame, cluster: DataFrame, column: str = "compound_key") -> DataFrame:
    """Participants with ``column`` (compound or reaction) replaced by its cluster."""
    m = cluster.select(F.col("entity_key").alias(column), F.col("cluster_key").alias("m"))
    return participant.join(m, column, "left").withColumn(column, F.coalesce("m", column)).drop("m").select(
        *participant.columns
    )


def max_cluster_size(cluster: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Clusters up to ``limit`` members, and those beyond it (weak chains) for review; nothing is dropped."""
    size = cluster.groupBy("cluster_key").agg(F.count("*").alias("size"))
    sized = cluster.join(size, "cluster_key")
    return sized.filter(F.col("size") <= limit), sized.filter(F.col("size") > limit)


def ec_record_pairs(xref: DataFrame, left_db: str, right_db: str) -> DataFrame:
    """Forced pairs: protein records of two sources that are keyed by the same enzyme number.

    Linking every record to the smallest one of its enzyme number joins the same records as all pairs would.
    """
    ec = xref.filter(
        (F.col("entity_type") == "protein") & F.col("source_db").isin(left_db, right_db)
        & (F.col("id_type") == "enzyme_ec") & is_ec("id_value", 4)
    ).select("entity_key", "source_db", "id_value").distinct()
    hub = ec.groupBy("id_value").agg(
        F.min("entity_key").alias("left_key"), F.count_distinct("source_db").alias("n_db")
    ).filter(F.col("n_db") == 2)
    return ec.join(hub, "id_value").filter(F.col("entity_key") != F.col("left_key")).select(
        "left_key", F.col("entity_key").alias("right_key")
    ).distinct()


def resolve_all(
    xref: DataFrame,
    edge: DataFrame,
    participant: DataFrame,
    configs: dict[str, MatchConfig] | None = None,
    forced_pairs: DataFrame | None = None,
    reaction: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Resolve compounds, then reactions on re-keyed participants, then proteins and genes; merge everything.

    Keys are looked up within their entity type: a gene and a protein may share one. A merged reaction takes its
    participants, and from ``reaction`` its direction, from the same member.
    """
    cfg = {**DEFAULTS, **(configs or {})}
    of = lambda kind: xref.filter(F.col("entity_type") == kind)
    compound = clusters(of("compound"), cfg["compound"])
    parts = rekey_participants(participant, compound)
    cols = ["entity_type", "entity_key", "id_type", "id_value"]
    merged_reaction = clusters(of("reaction").select(*cols).unionByName(participant_signature(parts)), cfg["reaction"])
    protein = clusters(of("protein"), cfg["protein"], forced_pairs)
    gene = clusters(of("gene"), cfg["gene"])
    tag = lambda df, kind: df.withColumn("entity_type", F.lit(kind))
    everyone = cut(tag(compound, "compound").unionByName(tag(merged_reaction, "reaction")).unionByName(tag(protein, "protein")).unionByName(tag(gene, "gene")))
    # a merged reaction keeps the participants of its smallest member that has any
    members = everyone.filter("entity_type = 'reaction'").select(F.col("entity_key").alias("reaction_key"), "cluster_key")
    owned = parts.join(members, "reaction_key")
    giver = owned.groupBy("cluster_key").agg(F.min("reaction_key").alias("reaction_key"))
    merged = owned.join(giver, ["cluster_key", "reaction_key"]).withColumn("reaction_key", F.col("cluster_key"))
    out = {}
    if reaction is not None:
        # reactions without participants of any member keep what their smallest member says
        held = reaction.join(members, "reaction_key")
        first = held.groupBy("cluster_key").agg(F.min("reaction_key").alias("smallest"))
        source = first.join(giver, "cluster_key", "left").select("cluster_key", F.coalesce("reaction_key", "smallest").alias("reaction_key"))
        given = held.join(source, ["cluster_key", "reaction_key"]).withColumn("reaction_key", F.col("cluster_key"))
        out["reaction"] = given.select(*reaction.columns)
    return {
        **out,
        "cluster": everyone,
        "xref": merge_xref(xref, everyone),
        "edge": rekey_edges(edge, everyone),
        "participant": merged.select(*participant.columns),
    }


def resolve_participants(participant: DataFrame, xref: DataFrame, search: bool = True) -> DataFrame:
    """Give raw participants ``(reaction_key, side, pos, stoich, stoich_raw, name, source_db, source_id)`` a compound.

    By exact name, then by source id, then by name search, else a stub compound keyed by a hash of
    ``(source, id, name)``. ``how`` tells which way worked. With several hits the smallest compound wins.
    """
    c = xref.filter(F.col("entity_type") == "compound")
    by_name = (
        c.filter(F.col("id_type") == "synonyms").groupBy(F.lower("id_value").alias("lname"))
        .agg(F.min("entity_key").alias("by_name"))
    )
    by_id = c.groupBy(F.col("id_type").alias("source_db"), F.col("id_value").alias("source_id")).agg(
        F.min("entity_key").alias("by_id")
    )
    out = (
        participant.withColumn("lname", F.lower("name"))
        .join(by_name, "lname", "left").join(by_id, ["source_db", "source_id"], "left")
    )
    if search:
        open_names = out.filter(F.col("by_name").isNull() & F.col("by_id").isNull() & (F.col("name") != "")).select(
            F.col("name").alias("query")
        ).distinct()
        found = name_search(open_names, c.filter(F.col("id_type") == "synonyms").select("entity_key", F.col("id_value").alias("name")))
        best = found.groupBy("query").agg(F.min("entity_key").alias("by_search")).withColumnRenamed("query", "name")
        out = out.join(best, "name", "left")
    else:
        out = out.withColumn("by_search", F.lit(None).cast("string"))
    stub = F.concat(F.lit("stub:"), F.substring(F.sha2(F.concat_ws(
        "\u0001", F.coalesce("source_db", F.lit("")), F.coalesce("source_id", F.lit("")), F.coalesce("lname", F.lit(""))), 256), 1, 32))
    return out.select(
        "reaction_key", "side", "pos", "stoich", "stoich_raw", "name", "source_db", "source_id",
        F.coalesce("by_name", "by_id", "by_search", stub).alias("compound_key"),
        F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_id").isNotNull(), "id")
        .when(F.col("by_search").isNotNull(), "search").otherwise("stub").alias("how"),
    )


def stub_compounds(resolved: DataFrame) -> DataFrame:
    """Xref rows for stub compounds: the name and id they were made from."""
    s = resolved.filter(F.col("how") == "stub").select("compound_key", "name", "source_db", "source_id").distinct()
    rows = s.select(
        "compound_key", "source_db",
        F.explode(F.array(
            F.struct(F.lit("synonyms").alias("id_type"), F.col("name").alias("id_value")),
            F.struct(F.col("source_db").alias("id_type"), F.col("source_id").alias("id_value")),
        )).alias("x"),
    ).filter(F.col("x.id_value").isNotNull() & (F.col("x.id_value") != ""))
    return rows.select(F.lit("compound").alias("entity_type"), F.col("compound_key").alias("entity_key"), "source_db",
                       "x.id_type", "x.id_value", F.lit(1).cast("bigint").alias("n")).distinct()


def resolve_participants_by_id(participant: DataFrame, xref: DataFrame) -> DataFrame:
    """Participants whose ``source_id`` names a compound; ``compound_key`` stays null when it is unknown."""
    by_id = (
        xref.filter(F.col("entity_type") == "compound")
        .groupBy(F.col("id_type").alias("source_db"), F.col("id_value").alias("source_id"))
        .agg(F.min("entity_key").alias("compound_key"))
    )
    return participant.join(by_id, ["source_db", "source_id"], "left")


def id_closure(seeds: DataFrame, xref: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All ids learned when every new id is looked up in turn, starting from seeds ``(id_type, id_value)``.

    The closure of a seed is its component in the graph of records and ids. Returns the seeds with their
    component and the ids per component: seeds of one component share one answer instead of repeating it.
    """
    id_node = lambda t, v: F.concat(F.lit("i\u0001"), t, F.lit("\u0001"), v)
    links = xref.select(
        F.concat(F.lit("e\u0001"), F.col("entity_type"), F.lit("\u0001"), F.col("entity_key")).alias("src"),
        id_node(F.col("id_type"), F.col("id_value")).alias("dst"),
    )
    comp = connected_components(links)
    s = seeds.select("id_type", "id_value").distinct().withColumn("node", id_node(F.col("id_type"), F.col("id_value")))
    start = s.join(comp, "node").select(F.col("id_type").alias("seed_type"), F.col("id_value").alias("seed_value"), "component")
    members = comp.filter(F.col("node").startswith("i\u0001")).withColumn("p", F.split("node", "\u0001", 3)).select(
        "component", F.element_at("p", 2).alias("id_type"), F.element_at("p", 3).alias("id_value")
    )
    wanted = members.join(start.select("component").distinct(), "component", "left_semi")
    return start, wanted


def synonym_fallback(entities: DataFrame, found: DataFrame, names: DataFrame, index: DataFrame) -> DataFrame:
    """Per entity and still missing source, the compound hit by its longest name.

    ``entities(entity_key, source_db)`` lists what is wanted, ``found(entity_key, source_db)`` what is there,
    ``names(entity_key, name)`` the entities' names and ``index(source_db, hit_key, name)`` the searchable names.
    """
    missing = entities.join(found, ["entity_key", "source_db"], "left_anti")
    tries = missing.join(names, "entity_key").withColumn("lname", F.lower("name"))
    hits = tries.join(
        index.select("source_db", F.lower("name").alias("lname"), "hit_key").groupBy("source_db", "lname")
        .agg(F.min("hit_key").alias("hit_key")),
        ["source_db", "lname"],
    )
    best = F.min(F.struct((-F.length("lname")).alias("neg"), "lname", "hit_key")).alias("b")
    return hits.groupBy("entity_key", "source_db").agg(best).select(
        "entity_key", "source_db", F.col("b.lname").alias("name"), F.col("b.hit_key").alias("hit_key")
    )
