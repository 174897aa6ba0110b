"""Queries on typed expansion."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.catalog.registry import query
from linkloom.catalog.roles import EDGE, PARTICIPANT, edges, key, participants, sides, table
from linkloom.operators import expand as X
from linkloom.operators.lookup import filter_organisms
from linkloom.sinks.export import sif_edges

# the kind of entity each mode starts from
START = {"g": "gene", "p": "protein", "r": "reaction", "c": "compound"}


def seeds(spark, sf, kind):
    """Seeds picked by content: one region's nations, one segment's customers, urgent open orders, one brand's parts."""
    if kind == "gene":
        df = table(spark, sf, "nation").filter("n_regionkey = 2").select(key("G", "n_nationkey").alias("node_key"))
    elif kind == "protein":
        df = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(key("P", "c_custkey").alias("node_key"))
    elif kind == "reaction":
        df = table(spark, sf, "orders").filter("o_orderstatus = 'O' and o_orderpriority = '1-URGENT'").select(key("R", "o_orderkey").alias("node_key"))
    else:
        df = table(spark, sf, "part").filter("p_brand = 'Brand#2'").select(key("C", "p_partkey").alias("node_key"))
    return df.select(F.lit(kind).alias("node_type"), "node_key")


SEED_SQL = {
    "gene": "SELECT 'gene' AS node_type, 'G' || n_nationkey AS node_key FROM nation WHERE n_regionkey = 2",
    "protein": "SELECT 'protein' AS node_type, 'P' || c_custkey AS node_key FROM customer WHERE c_mktsegment = 'BUILDING'",
    "reaction": "SELECT 'reaction' AS node_type, 'R' || o_orderkey AS node_key FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'",
    "compound": "SELECT 'compound' AS node_type, 'C' || p_partkey AS node_key FROM part WHERE p_brand = 'Brand#2'",
}


def stop_compounds(spark, sf):
    """Compounds that must not be expanded: all parts of size 1."""
    return table(spark, sf, "part").filter("p_size = 1").select(key("C", "p_partkey").alias("entity_key"))


def reach_sql(mode: str, seed: str, extra: str = "") -> str:
    allowed = sorted(set().union(*[X.MODES[m] for m in mode.split(",")]))
    rows = ", ".join(f"('{e}', '{X.ends(e)[0]}', '{X.ends(e)[1]}')" for e in allowed if e != "cr") or "('-', '-', '-')"
    first = "SELECT node_type, node_key FROM seeds"
    if "cr" in allowed:
        first += f" UNION SELECT 'reaction', dst_key FROM seeds JOIN edge ON edge_type = 'cr' AND src_key = node_key AND node_type = 'compound'{extra}"
    return f"""WITH RECURSIVE {EDGE}, seeds AS ({seed}), allowed(edge_type, st, dt) AS (VALUES {rows}),
begin AS ({first}),
reach AS (
  SELECT node_type, node_key FROM begin
  UNION
  SELECT dt, dst_key FROM reach JOIN allowed ON st = node_type
  JOIN edge ON edge.edge_type = allowed.edge_type AND src_key = node_key
)"""


def _register(mode: str):
    kind = START.get(mode[:1], "protein") if mode != "global" else "reaction"
    name = f"expand_{mode or 'none'}"

    @query(name, reach_sql(mode, SEED_SQL[kind]) + " SELECT node_type, node_key FROM reach")
    def run(spark, sf):
        return X.expand_mode(seeds(spark, sf, kind), edges(spark, sf), mode).select("node_type", "node_key")


for _mode in X.MODES:
    _register(_mode)


@query(
    "reached_network",
    reach_sql("prc", SEED_SQL["protein"]) + """
SELECT src_key AS SOURCE, edge.edge_type AS INTERACTION, dst_key AS TARGET
FROM reach JOIN allowed ON st = node_type JOIN edge ON edge.edge_type = allowed.edge_type AND src_key = node_key""",
)
def reached_network(spark, sf):
    """From seed proteins under mode prc: the reached network as an edge list."""
    s, e = seeds(spark, sf, "protein"), edges(spark, sf)
    got = X.expand_mode(s, e, "prc")
    walked = X.reached_edges(got, s.withColumn("mode_key", F.lit("prc")), e, X.mode_edges(spark, ["prc"]))
    return walked.select(F.col("src_key").alias("SOURCE"), F.col("edge_type").alias("INTERACTION"), F.col("dst_key").alias("TARGET"))


@query(
    "expand_stoplist",
    reach_sql("crp", SEED_SQL["compound"], " AND node_key NOT IN (SELECT 'C' || p_partkey FROM part WHERE p_size = 1)")
    + " SELECT node_type, node_key FROM reach",
)
def expand_stoplist(spark, sf):
    """Stop-listed seed compounds are kept but not expanded."""
    return X.expand_mode(seeds(spark, sf, "compound"), edges(spark, sf), "crp", stop_compounds(spark, sf)).select("node_type", "node_key")


@query(
    "expand_mixed",
    f"""WITH RECURSIVE {EDGE},
seeds AS (SELECT 'gpr' AS mode_key, * FROM ({SEED_SQL['gene']}) UNION ALL SELECT 'crp' AS mode_key, * FROM ({SEED_SQL['compound']})
          UNION ALL SELECT 'pg,rp' AS mode_key, * FROM ({SEED_SQL['reaction']})),
allowed(mode_key, edge_type, st, dt) AS (VALUES ('gpr', 'gp', 'gene', 'protein'), ('gpr', 'pr', 'protein', 'reaction'),
  ('crp', 'rp', 'reaction', 'protein'), ('crp', 'rc', 'reaction', 'compound'),
  ('pg,rp', 'pg', 'protein', 'gene'), ('pg,rp', 'rp', 'reaction', 'protein')),
reach AS (
  SELECT mode_key, node_type, node_key FROM seeds
  UNION SELECT mode_key, 'reaction', dst_key FROM seeds JOIN edge ON edge_type = 'cr' AND src_key = node_key
        WHERE mode_key = 'crp' AND node_type = 'compound'
  UNION
  SELECT reach.mode_key, dt, dst_key FROM reach JOIN allowed ON st = node_type AND allowed.mode_key = reach.mode_key
  JOIN edge ON edge.edge_type = allowed.edge_type AND src_key = node_key
) SELECT mode_key, node_type, node_key FROM reach""",
)
def expand_mixed(spark, sf):
    """Seeds of three mode sets in one run; each keeps its own modes."""
    s = None
    for kind, modes in (("gene", ["gpr"]), ("compound", ["crp"]), ("reaction", ["rp", "pg"])):
        one = seeds(spark, sf, kind).withColumn("mode_key", F.lit(X.mode_key(modes)))
        s = one if s is None else s.unionByName(one)
    return X.expand(s, edges(spark, sf), X.mode_edges(spark, ["gpr", "crp", "pg,rp"]))


@query(
    "protein_family",
    """WITH RECURSIVE fam AS (
  SELECT DISTINCT 'P' || c_custkey AS a, 'P' || (c_custkey // 3) AS b FROM customer
), start AS (SELECT 'P' || c_custkey AS protein_key FROM customer WHERE c_mktsegment = 'BUILDING'),
reach AS (SELECT protein_key FROM start UNION SELECT b FROM reach JOIN fam ON a = protein_key)
SELECT DISTINCT protein_key FROM (SELECT protein_key FROM reach UNION ALL
  SELECT 'P' || q.c_custkey FROM reach JOIN customer p ON protein_key = 'P' || p.c_custkey
  JOIN customer q ON p.c_acctbal = q.c_acctbal)""",
)
def protein_family(spark, sf):
    """Customers as complexes (a customer is part of the one with a third of its number), peers by equal balance."""
    c = table(spark, sf, "customer")
    fam = c.select(F.lit("in_complex").alias("edge_type"), key("P", "c_custkey").alias("src_key"),
                   key("P", F.floor(F.col("c_custkey") / 3)).alias("dst_key"))
    p = c.select(key("P", "c_custkey").alias("src_key"), "c_acctbal")
    peers = p.join(p.select(F.col("src_key").alias("dst_key"), "c_acctbal"), "c_acctbal").select("src_key", "dst_key")
    start = c.filter("c_mktsegment = 'BUILDING'").select(key("P", "c_custkey").alias("protein_key"))
    return X.protein_family(start, fam, peers)


@query(
    "organism_filter",
    """SELECT 'pg' AS edge_type, 'P' || c_custkey AS src_key, lower(r_name) || ':' || n_name AS dst_key
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')""",
)
def organism_filter(spark, sf):
    """Gene links whose id carries a wanted organism (region) code."""
    g = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    e = table(spark, sf, "customer").join(g, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.lit("pg").alias("edge_type"), key("P", "c_custkey").alias("src_key"),
        F.concat(F.lower("r_name"), F.lit(":"), "n_name").alias("dst_key"))
    codes = table(spark, sf, "region").filter("r_name in ('ASIA', 'EUROPE')").select(F.col("r_name").alias("organism"))
    return filter_organisms(e, codes)


@query(
    "sif_edges",
    f"""WITH {EDGE}, {PARTICIPANT}
SELECT DISTINCT * FROM (
  SELECT CASE WHEN side = 'left' THEN compound_key ELSE reaction_key END AS SOURCE,
         CASE WHEN side = 'left' THEN 'cr' ELSE 'rc' END AS INTERACTION,
         CASE WHEN side = 'left' THEN reaction_key ELSE compound_key END AS TARGET FROM participant
  UNION ALL SELECT src_key, edge_type, dst_key FROM edge WHERE edge_type NOT IN ('cr', 'rc'))""",
)
def sif(spark, sf):
    return sif_edges(edges(spark, sf), sides(spark, sf))
