"""Functional annotation tables, entity tables and code hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.arrays import spread
from linkloom.sources.seeds import tab

FIRST = 7  # annotations start in this column


def _tokens(lines: DataFrame, keep: list[str], first: int = 1) -> DataFrame:
    cells = F.split("value", "\t")
    cells = F.slice(cells, first, F.size(cells))
    cell = spread(lines, cells, "cell", *keep).filter(F.contains(F.col("cell"), F.lit(":")))
    at = F.instr("cell", F.lit(":"))
    return cell.select(
        *keep, F.substring(F.col("cell"), F.lit(1), at - 1).alias("id_type"),
        F.substring(F.col("cell"), at + 1, F.length("cell")).alias("id_value"))


def parse_annotations(lines: DataFrame, wanted: tuple[str, ...] = ("enzyme_ec", "metacyc")) -> DataFrame:
    """``(sample, value)`` lines to distinct ``(sample, id_type, id_value)``, from the seventh column on."""
    return _tokens(lines, ["sample"], FIRST).filter(F.col("id_type").isin(list(wanted))).distinct()


def parse_kv_annotations(lines: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Any ``db:value`` cell of ``(sample, value)`` lines; ``description`` is left out, ``wanted`` limits the dbs."""
    t = _tokens(lines, ["sample"]).filter(F.col("id_type") != "description")
    return (t.filter(F.col("id_type").isin(wanted)) if wanted else t).distinct()


def _with_sample(df: DataFrame) -> DataFrame:
    """The folder that holds a file names its sample."""
    return df.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("sample"), "value")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """One folder per sample."""
    return parse_annotations(_with_sample(spark.read.text(path)))


def read_kv_annotations(spark: SparkSession, path: str, wanted: list[str] | None = None) -> DataFrame:
    """As :func:`read_annotations` for any column; the header line of each file is skipped."""
    lines = spark.read.schema("value string").option("header", True).option("sep", "\u0001").option("quote", "").csv(path)
    return parse_kv_annotations(_with_sample(lines), wanted)


def parse_entity_lines(lines: DataFrame) -> DataFrame:
    """``(entity_type, value)`` lines ``internal_id:<n>\\tkey:value…`` to ``(entity_type, internal_id, k, v)``."""
    head = F.substring_index(tab(F.col("value"), 0), ":", -1)
    base = lines.withColumn("internal_id", head)
    rows = _tokens(base.select("entity_type", "internal_id", "value"), ["entity_type", "internal_id"], 2)
    return rows.select("entity_type", "internal_id", F.col("id_type").alias("k"), F.col("id_value").alias("v"))


def read_entity_tsv(spark: SparkSession, path: str, entity_type: str) -> DataFrame:
    return parse_entity_lines(spark.read.text(path).withColumn("entity_type", F.lit(entity_type)))


def hierarchy_schema(depth: int) -> str:
    """DDL of ``{name, children}`` nested to ``depth`` levels below the root."""
    s = "struct<name string>"
    for _ in range(depth):
        s = f"struct<name string, children array<{s}>>"
    return s


def parse_hierarchy(trees: DataFrame, depth: int = 4, column: str = "tree", first_branch: bool = False) -> DataFrame:
    """Distinct leaf codes at ``depth`` below the root; codes ending in ``-`` are dropped.

    ``first_branch`` starts from the first child of the root, which then counts as the first level.
    """
    kids = trees.select(F.col(f"{column}.children").alias("c"))
    if first_branch:
        kids = kids.select(F.slice("c", 1, 1).alias("c"))
    for _ in range(depth - 1):
        kids = kids.select(F.explode("c").alias("x")).select(F.col("x.children").alias("c"))
    code = F.element_at(F.split(F.trim(F.col("x.name")), r"\s+"), 1)
    return kids.select(F.explode("c").alias("x")).select(code.alias("code")).filter(~F.col("code").endswith("-")).distinct()


def read_hierarchy(spark: SparkSession, path: str, depth: int = 4, first_branch: bool = False) -> DataFrame:
    tree = spark.read.schema(f"name string, children array<{hierarchy_schema(depth - 1)}>").option("multiLine", True).json(path)
    return parse_hierarchy(tree.select(F.struct("name", "children").alias("tree")), depth, "tree", first_branch)
