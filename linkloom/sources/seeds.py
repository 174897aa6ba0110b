"""Seed lists, stop lists, metabolite lists and link dumps: small tab separated formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.text import is_ec, squeeze
from linkloom.operators.expand import ENTITY_TYPES, MODES


def tab(col: Column, i: int) -> Column:
    """Field ``i`` (from 0) of a tab separated line; null when the line is shorter."""
    return F.try_element_at(F.split(col, "\t", -1), F.lit(i + 1))


def read_lines(spark: SparkSession, path: str, header: bool = False) -> DataFrame:
    """Non-empty lines of a file or folder as ``(value)``; ``header`` drops each file's first line."""
    if header:
        df = spark.read.option("header", True).option("sep", "\u0001").option("quote", "").option("enforceSchema", True)
        return df.schema("value string").csv(path).filter(F.col("value") != "")
    return spark.read.text(path).filter(F.col("value") != "")


def parse_seeds(lines: DataFrame) -> DataFrame:
    """``id, id_type, entity_type[, modes[, organisms]]`` lines as typed columns; the whole line is kept."""
    v = F.regexp_replace("value", r"[\r\n]+$", "")
    id_type = tab(v, 1)
    return lines.filter(v != "").select(
        tab(v, 0).alias("id"),
        F.when(id_type.startswith("syn"), "synonyms").otherwise(id_type).alias("id_type"),
        F.lower(tab(v, 2)).alias("entity_type"),
        F.array_distinct(F.split(F.lower(F.coalesce(tab(v, 3), F.lit(""))), ",")).alias("modes"),
        F.filter(F.split(F.coalesce(tab(v, 4), F.lit("")), ","), lambda x: x != "").alias("organisms"),
        v.alias("line"),
    )


def read_seeds(spark: SparkSession, path: str) -> DataFrame:
    return parse_seeds(spark.read.text(path))


def validate_seeds(seeds: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split seeds into usable ones and rejected ones with a ``reason``."""
    valid_modes = F.array(*[F.lit(m) for m in MODES])
    loose_ec = (F.col("entity_type") == "protein") & is_ec("id", 3) & ~is_ec("id", 4)
    reason = (
        F.when(F.col("id_type").isNull() | F.col("entity_type").isNull(), "too few fields")
        .when(~F.col("entity_type").isin(ENTITY_TYPES), "unknown entity type")
        .when(F.size(F.array_except("modes", valid_modes)) > 0, "unknown search mode")
        .when(F.col("id").isNull() | (F.col("id") == ""), "empty id")
        .when(loose_ec, "unspecific enzyme number")
    )
    judged = seeds.withColumn("reason", reason)
    return judged.filter(F.col("reason").isNull()).drop("reason"), judged.filter(F.col("reason").isNotNull())


def seed_states(seeds: DataFrame, xref: DataFrame) -> DataFrame:
    """Valid seeds as expansion states: the entities that hold the seed id, with the key of their mode set."""
    key = F.array_join(F.array_sort("modes"), ",")
    held = xref.select("entity_type", "id_type", F.col("id_value").alias("id"), "entity_key").distinct()
    return seeds.select("id", "id_type", "entity_type", key.alias("mode_key")).distinct().join(
        held, ["entity_type", "id_type", "id"]
    ).select("mode_key", F.col("entity_type").alias("node_type"), F.col("entity_key").alias("node_key")).distinct()


def parse_stoplist(lines: DataFrame) -> DataFrame:
    """``id, id_type`` lines of ubiquitous compounds, trimmed, ids in lower case."""
    return lines.select(F.trim(tab(F.col("value"), 1)).alias("id_type"), F.lower(squeeze(tab(F.col("value"), 0))).alias("id_value")).filter(
        F.col("id_type").isNotNull() & (F.col("id_value") != "")).distinct()


def read_stoplist(spark: SparkSession, path: str) -> DataFrame:
    return parse_stoplist(read_lines(spark, path, header=True))


def parse_metabolites(lines: DataFrame) -> DataFrame:
    """``id, id_type`` lines of wanted metabolites."""
    v = F.col("value")
    return lines.select(tab(v, 0).alias("id"), tab(v, 1).alias("id_type")).filter(F.col("id") != "").distinct()


def read_metabolites(spark: SparkSession, path: str) -> DataFrame:
    return parse_metabolites(spark.read.text(path))


def parse_link_dump(lines: DataFrame, strip: bool = True) -> DataFrame:
    """``id, linked id`` lines; ``strip`` removes the source prefix up to ``:`` on both sides."""
    cut_off = (lambda c: F.substring_index(c, ":", -1)) if strip else (lambda c: c)
    v = F.col("value")
    return lines.select(F.trim(cut_off(tab(v, 0))).alias("id"), F.trim(cut_off(tab(v, 1))).alias("linked_id")).filter(
        F.col("linked_id") != "")


def parse_find_dump(lines: DataFrame) -> DataFrame:
    """``id, name; name`` lines as one row per name."""
    v = F.col("value")
    return lines.select(
        F.trim(F.substring_index(tab(v, 0), ":", -1)).alias("id"), F.explode(F.split(tab(v, 1), ";")).alias("name")
    ).select("id", F.trim("name").alias("name")).filter(F.col("name") != "")


def read_link_dump(spark: SparkSession, path: str, names: bool = False) -> DataFrame:
    lines = spark.read.text(path)
    return parse_find_dump(lines) if names else parse_link_dump(lines)


def find_by_name(names: DataFrame, dump: DataFrame) -> DataFrame:
    """Exact, case-free name filter on a find dump: ``(query, id)``."""
    q = names.select(F.col("name").alias("query"), F.lower("name").alias("k")).distinct()
    return q.join(dump.select("id", F.lower("name").alias("k")), "k").select("query", "id").distinct()


def parse_links(lines: DataFrame) -> DataFrame:
    """Gene to UniProt lines: ``#`` comments and rows without a second field are dropped."""
    v = F.col("value")
    return lines.filter(~v.startswith("#")).select(tab(v, 0).alias("gene"), tab(v, 1).alias("uniprot")).filter(
        F.coalesce(F.col("uniprot") != "", F.lit(False)))


def read_links(spark: SparkSession, path: str) -> DataFrame:
    return parse_links(spark.read.text(path))
