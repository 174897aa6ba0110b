"""The given tables in the roles of the data model, in Spark and as SQL text for the side-by-side check.

nation = gene, customer = protein, orders = reaction, lineitem = participant, part = compound, supplier = sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.operators.matching import MatchConfig, Rule


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def key(prefix, col) -> Column:
    """``prefix`` (text or column) followed by the number in ``col``."""
    head = prefix if isinstance(prefix, Column) else F.lit(prefix)
    return F.concat(head, (F.col(col) if isinstance(col, str) else col).cast("string"))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """``gp pg`` through the nation, ``pr rp`` through the customer, ``cr rc`` through the lines."""
    c = table(spark, sf, "customer").select(key("G", "c_nationkey").alias("a"), key("P", "c_custkey").alias("b"))
    o = table(spark, sf, "orders").select(key("P", "o_custkey").alias("a"), key("R", "o_orderkey").alias("b"))
    li = table(spark, sf, "lineitem").select(key("R", "l_orderkey").alias("a"), key("C", "l_partkey").alias("b")).distinct()

    def both(df: DataFrame, there: str, back: str, db: str) -> DataFrame:
        # plain literals per branch: a filter on edge_type removes the other branches at planning time
        row = lambda kind, src, dst: df.select(F.lit(kind).alias("edge_type"), F.col(src).alias("src_key"), F.col(dst).alias("dst_key"), F.lit(db).alias("source_db"))
        return row(there, "a", "b").unionByName(row(back, "b", "a"))

    return both(c, "gp", "pg", "customer").unionByName(both(o, "pr", "rp", "orders")).unionByName(both(li, "rc", "cr", "lineitem"))


EDGE = """
edge AS (
  SELECT 'gp' AS edge_type, 'G' || c_nationkey AS src_key, 'P' || c_custkey AS dst_key, 'customer' AS source_db FROM customer
  UNION ALL SELECT 'pg', 'P' || c_custkey, 'G' || c_nationkey, 'customer' FROM customer
  UNION ALL SELECT 'pr', 'P' || o_custkey, 'R' || o_orderkey, 'orders' FROM orders
  UNION ALL SELECT 'rp', 'R' || o_orderkey, 'P' || o_custkey, 'orders' FROM orders
  UNION ALL SELECT DISTINCT 'rc', 'R' || l_orderkey, 'C' || l_partkey, 'lineitem' FROM lineitem
  UNION ALL SELECT DISTINCT 'cr', 'C' || l_partkey, 'R' || l_orderkey, 'lineitem' FROM lineitem
)"""


def sides(spark: SparkSession, sf: str) -> DataFrame:
    """Participants without positions: ``(reaction_key, side, compound_key, stoich)``; odd line numbers are left."""
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    side = F.when(F.col("l_linenumber") % 2 == 1, "left").otherwise("right")
    return li.groupBy("l_orderkey", "l_partkey", side.alias("side")).agg(F.sum("l_quantity").cast("int").alias("stoich")).select(
        key("R", "l_orderkey").alias("reaction_key"), "side", key("C", "l_partkey").alias("compound_key"), "stoich", "l_partkey")


def participants(spark: SparkSession, sf: str) -> DataFrame:
    """Full participant rows; the position is the rank of the part within its side."""
    side = F.when(F.col("l_linenumber") % 2 == 1, "left").otherwise("right")
    # dealt by reaction once: parts are added up, ranked and put into equations where they are
    li = table(spark, sf, "lineitem").select(key("R", "l_orderkey").alias("reaction_key"), side.alias("side"), "l_partkey", "l_quantity").repartition("reaction_key")
    parts = li.groupBy("reaction_key", "l_partkey", "side").agg(F.sum("l_quantity").cast("int").alias("stoich"))
    w = W.partitionBy("reaction_key", "side").orderBy("l_partkey")
    return parts.select(
        "reaction_key", "side", (F.row_number().over(w) - 1).alias("pos"), "stoich", F.lit("").alias("stoich_raw"), key("C", "l_partkey").alias("compound_key"))


PARTICIPANT = """
participant AS (
  SELECT 'R' || l_orderkey AS reaction_key, side,
         CAST(row_number() OVER (PARTITION BY l_orderkey, side ORDER BY l_partkey) - 1 AS INTEGER) AS pos,
         stoich, 'C' || l_partkey AS compound_key
  FROM (SELECT l_orderkey, l_partkey, CASE WHEN l_linenumber % 2 = 1 THEN 'left' ELSE 'right' END AS side,
               CAST(sum(l_quantity) AS INTEGER) AS stoich
        FROM lineitem GROUP BY ALL)
)"""

DIRECTION = {"F": "<=>", "O": "=>", "P": "<="}


def reactions(spark: SparkSession, sf: str) -> DataFrame:
    """``(reaction_key, direction, status)``; the direction comes from the order status."""
    way = F.create_map(*[F.lit(x) for kv in DIRECTION.items() for x in kv])
    return table(spark, sf, "orders").select(
        key("R", "o_orderkey").alias("reaction_key"), F.element_at(way, F.col("o_orderstatus")).alias("direction"),
        F.col("o_orderstatus").alias("status"))


REACTION = """
reaction AS (
  SELECT 'R' || o_orderkey AS reaction_key, o_orderstatus AS status,
         CASE o_orderstatus WHEN 'F' THEN '<=>' WHEN 'O' THEN '=>' ELSE '<=' END AS direction
  FROM orders
)"""

# each side of an equation as text, for every reaction with lines: an empty side is an empty list
_SIDE = "coalesce(string_agg({what}, ' + ' ORDER BY pos) FILTER (side = '{side}'), '')"
_BOTH = lambda what: f"{_SIDE.format(what=what, side='left')} || ' ' || any_value(direction) || ' ' || {_SIDE.format(what=what, side='right')}"
EQUATION = PARTICIPANT + "," + REACTION + f""",
equation AS (
  SELECT p.reaction_key, any_value(direction) AS direction, any_value(status) AS status,
         {_BOTH("stoich || ' ' || compound_key")} AS equation, {_BOTH("compound_key")} AS reaction_compounds
  FROM participant p JOIN reaction USING (reaction_key) GROUP BY p.reaction_key
)"""


def equation_parts(spark: SparkSession, sf: str) -> DataFrame:
    """``(reaction_key, direction, status, parts)`` of every reaction with lines; one of its sides may be empty."""
    p = participants(spark, sf)
    parts = p.groupBy("reaction_key").agg(
        F.array_sort(F.collect_list(F.struct("side", "pos", "stoich", "stoich_raw", F.col("compound_key").alias("name")))).alias("parts"))
    return parts.join(reactions(spark, sf), "reaction_key")


def xref_rows(df: DataFrame, entity_type: str, entity_key, source_db: str, fields: dict) -> DataFrame:
    """Xref rows of a wide table; ``fields`` maps id types to columns, null values give no row."""
    cells = F.explode(F.array(*[F.struct(F.lit(t).alias("id_type"), c.cast("string").alias("id_value")) for t, c in fields.items()]))
    return df.select(F.lit(entity_type).alias("entity_type"), entity_key.alias("entity_key"), F.lit(source_db).alias("source_db"), cells.alias("x")).select(
        "entity_type", "entity_key", "source_db", "x.id_type", "x.id_value", F.lit(1).cast("bigint").alias("n")).filter(F.col("id_value").isNotNull())


def compound_xref(spark: SparkSession, sf: str, sparse: bool = False) -> DataFrame:
    """Parts with the id types name, brand, type and size; ``sparse`` leaves some of them out by content."""
    p = table(spark, sf, "part")
    brand, size = F.col("p_brand"), F.col("p_size")
    if sparse:
        brand, size = F.when(F.col("p_type") != "ECONOMY", brand), F.when(F.col("p_size") > 25, size)
    return xref_rows(p, "compound", key("C", "p_partkey"), "part",
                     {"name": F.col("p_name"), "brand": brand, "type": F.col("p_type"), "size": size})


PART_RULES = MatchConfig(tuple(Rule(t) for t in ("name", "brand", "type", "size")), threshold=3, hmdb_type=None)


def compound_sql(sparse: bool = False) -> str:
    brand, size = ("p_brand", "p_size")
    if sparse:
        brand, size = "CASE WHEN p_type <> 'ECONOMY' THEN p_brand END", "CASE WHEN p_size > 25 THEN p_size END"
    return f"""
cx AS (
  SELECT * FROM (
    SELECT 'C' || p_partkey AS entity_key, 'name' AS id_type, p_name AS id_value FROM part
    UNION ALL SELECT 'C' || p_partkey, 'brand', {brand} FROM part
    UNION ALL SELECT 'C' || p_partkey, 'type', p_type FROM part
    UNION ALL SELECT 'C' || p_partkey, 'size', CAST({size} AS VARCHAR) FROM part)
  WHERE id_value IS NOT NULL
)"""


def protein_xref(spark: SparkSession, sf: str) -> DataFrame:
    return xref_rows(table(spark, sf, "customer"), "protein", key("P", "c_custkey"), "customer",
                     {"nation": F.col("c_nationkey"), "segment": F.col("c_mktsegment"), "synonyms": F.col("c_name")})


def sample_annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Supplier = sample, annotated with its nation."""
    return table(spark, sf, "supplier").select(key("S", "s_suppkey").alias("sample"), F.lit("nation").alias("id_type"),
                                               F.col("s_nationkey").cast("string").alias("id_value"))


# min-label components of undirected links(a, b), every node also linked to itself
COMPONENTS = """
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
cc(node, component) USING KEY (node) AS (
  SELECT a, min(least(a, b)) FROM both_ways GROUP BY a
  UNION
  SELECT u.node, min(v.component)
  FROM cc v JOIN both_ways e ON e.a = v.node JOIN recurring.cc u ON u.node = e.b
  WHERE v.component < u.component GROUP BY u.node
)"""
