"""The long cross-reference table: counted id bags, main ids, provenance and set operations.

``xref(entity_type, entity_key, source_db, id_type, id_value, n)``
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions.text import is_available, is_ec

ENTITY = ["entity_type", "entity_key"]
BAG = ENTITY + ["id_type", "id_value"]


def id_bag(xref: DataFrame) -> DataFrame:
    """Counted distinct values per entity and id type."""
    return xref.groupBy(*BAG).agg(F.sum("n").cast("bigint").alias("n"))


def main_id(xref: DataFrame) -> DataFrame:
    """The most frequent value per entity and id type; the smaller value wins a tie.

    A max over a struct keeps one row per group during the map-side combine, so a hot entity never has to be
    sorted in one task.
    """
    best = F.min(F.struct((-F.col("n")).alias("neg"), "id_value")).alias("best")
    return (
        id_bag(xref)
        .groupBy("entity_type", "entity_key", "id_type")
        .agg(best)
        .select(*ENTITY, "id_type", F.col("best.id_value").alias("id_value"), (-F.col("best.neg")).alias("n"))
    )


def ranked_values(xref: DataFrame, n: int | None = None) -> DataFrame:
    """Values ordered by falling count; with ``n`` only the first ``n`` (Spark trims each partition first)."""
    w = W.partitionBy("entity_type", "entity_key", "id_type").orderBy(F.desc("n"), F.asc("id_value"))
    out = id_bag(xref).withColumn("rank", F.row_number().over(w))
    return out.filter(F.col("rank") <= n) if n else out


def collect_ids(xref: DataFrame) -> DataFrame:
    """Sorted distinct values per entity and id type."""
    return xref.groupBy("entity_type", "entity_key", "id_type").agg(
        F.array_sort(F.collect_set("id_value")).alias("id_values")
    )


def index_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Inverted index: sorted distinct ``value`` per ``key``."""
    return df.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(f"{value}s"))


def filter_sources(xref: DataFrame, dbs: list[str]) -> DataFrame:
    """Keep the rows of whitelisted sources; prunes folders when the table is partitioned by ``source_db``."""
    return xref.filter(F.col("source_db").isin(dbs))


def drop_unavailable(xref: DataFrame) -> DataFrame:
    return xref.filter(is_available("id_value"))


def derive_protein_ids(xref: DataFrame) -> DataFrame:
    """Enzyme numbers of proteins also serve as ids of two sources, and an id shaped like one becomes one.

    Only the smallest such id of a protein is promoted.
    """
    ids = ["uniprot", "metacyc", "kegg", "hmdb", "rhea", "pubchem"]
    protein = xref.filter(F.col("entity_type") == "protein")
    shaped = (
        protein.filter(F.col("id_type").isin(ids) & is_ec("id_value"))
        .groupBy("entity_type", "entity_key")
        .agg(F.min(F.struct("id_value", "source_db")).alias("m"))
        .select(*ENTITY, F.col("m.source_db").alias("source_db"), F.lit("enzyme_ec").alias("id_type"),
                F.col("m.id_value").alias("id_value"), F.lit(1).cast("bigint").alias("n"))
    )
    ecs = (
        protein.filter(F.col("id_type") == "enzyme_ec")
        .select(*ENTITY, "source_db", "id_type", "id_value", F.col("n").cast("bigint").alias("n"))
        .unionByName(shaped)
    )
    also = ecs.withColumn("id_type", F.explode(F.array(F.lit("metacyc"), F.lit("kegg")))).withColumn(
        "n", F.lit(1).cast("bigint")
    )
    keys = BAG + ["source_db"]
    old = xref.select(*keys, F.col("n").cast("bigint").alias("n"), F.lit(0).alias("added"))
    new = shaped.unionByName(also).select(*keys, "n", F.lit(1).alias("added"))
    # a derived row only counts where the entity did not have the value yet
    return (
        old.unionByName(new)
        .groupBy(*keys)
        .agg(
            F.coalesce(F.sum(F.when(F.col("added") == 0, F.col("n"))), F.max("n")).cast("bigint").alias("n")
        )
    )


def remove_values(xref: DataFrame, removals: DataFrame, keys: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Split ``xref`` into the rows that stay and the rows that were removed (these still name their source)."""
    on = keys or ["entity_key", "id_type", "id_value"]
    gone = removals.select(*on).distinct()
    return xref.join(gone, on, "left_anti"), xref.join(gone, on, "left_semi")


def link_sources(edge: DataFrame) -> DataFrame:
    """Which sources gave a link and when it was first seen (``ts`` is optional)."""
    aggs = [F.array_sort(F.collect_set("source_db")).alias("sources"), F.count_distinct("source_db").alias("n_sources")]
    if "ts" in edge.columns:
        aggs.append(F.min("ts").alias("first_seen"))
    return edge.groupBy("edge_type", "src_key", "dst_key").agg(*aggs)


def id_types(xref: DataFrame) -> DataFrame:
    """The id types an entity has."""
    return xref.groupBy(*ENTITY).agg(F.array_sort(F.collect_set("id_type")).alias("id_types"))


def pair_id_types(pairs: DataFrame, xref: DataFrame) -> DataFrame:
    """The id types present on either entity of a pair."""
    types = id_types(xref).select("entity_key", "id_types")
    left = types.select(F.col("entity_key").alias("left_key"), F.col("id_types").alias("l"))
    right = types.select(F.col("entity_key").alias("right_key"), F.col("id_types").alias("r"))
    none = F.array().cast("array<string>")
    return (
        pairs.join(left, "left_key", "left")
        .join(right, "right_key", "left")
        .select("left_key", "right_key",
                F.array_sort(F.array_union(F.coalesce("l", none), F.coalesce("r", none))).alias("id_types"))
    )
