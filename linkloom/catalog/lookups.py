"""Queries on the cross-reference table, lookups, indexes and name search."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.catalog.registry import query
from linkloom.catalog.roles import (
    EDGE,
    EQUATION,
    PARTICIPANT,
    compound_sql,
    compound_xref,
    edges,
    equation_parts,
    key,
    participants,
    protein_xref,
    reactions,
    sides,
    table,
    xref_rows,
)
from linkloom.functions.equations import format_equation
from linkloom.operators import lookup as L
from linkloom.operators import xref as X

BAG_SQL = """
bag AS (SELECT 'user' AS entity_type, 'U' || user_id AS entity_key, 'event_type' AS id_type, event_type AS id_value, count(*) AS n FROM events GROUP BY ALL
        UNION ALL SELECT 'user', 'U' || user_id, 'day', CAST(CAST(ts AS DATE) AS VARCHAR), count(*) FROM events GROUP BY ALL)"""


def event_xref(spark, sf):
    """Users with a counted bag of event types and days."""
    e = table(spark, sf, "events")
    return xref_rows(e, "user", key("U", "user_id"), "events", {"event_type": F.col("event_type"), "day": F.to_date("ts")})


@query("id_bag", f"WITH {BAG_SQL} SELECT * FROM bag")
def id_bag(spark, sf):
    return X.id_bag(event_xref(spark, sf))


@query("main_id", f"WITH {BAG_SQL} SELECT * FROM bag QUALIFY row_number() OVER (PARTITION BY entity_key, id_type ORDER BY n DESC, id_value) = 1")
def main_id(spark, sf):
    return X.main_id(event_xref(spark, sf))


@query(
    "ranked_values",
    f"WITH {BAG_SQL} SELECT *, CAST(row_number() OVER (PARTITION BY entity_key, id_type ORDER BY n DESC, id_value) AS INTEGER) AS rank FROM bag QUALIFY rank <= 3",
)
def ranked_values(spark, sf):
    return X.ranked_values(event_xref(spark, sf), 3)


@query(
    "collect_ids",
    f"WITH {BAG_SQL} SELECT entity_type, entity_key, id_type, string_agg(id_value, ',' ORDER BY id_value) AS id_values FROM bag GROUP BY ALL",
)
def collect_ids(spark, sf):
    return X.collect_ids(event_xref(spark, sf)).withColumn("id_values", F.array_join("id_values", ","))


@query("id_types", f"WITH {compound_sql(True)} SELECT 'compound' AS entity_type, entity_key, string_agg(DISTINCT id_type, ',' ORDER BY id_type) AS id_types FROM cx GROUP BY entity_key")
def id_types(spark, sf):
    return X.id_types(compound_xref(spark, sf, True)).withColumn("id_types", F.array_join("id_types", ","))


@query(
    "pair_id_types",
    f"""WITH {compound_sql(True)}, b AS (SELECT p_brand, min('C' || p_partkey) AS k FROM part GROUP BY ALL),
pairs AS (SELECT 'C' || p_partkey AS left_key, k AS right_key FROM part JOIN b USING (p_brand))
SELECT left_key, right_key, string_agg(DISTINCT id_type, ',' ORDER BY id_type) AS id_types FROM pairs JOIN cx ON entity_key IN (left_key, right_key) GROUP BY ALL""",
)
def pair_id_types(spark, sf):
    p = table(spark, sf, "part").select(key("C", "p_partkey").alias("left_key"), "p_brand")
    pairs = p.join(p.groupBy("p_brand").agg(F.min("left_key").alias("right_key")), "p_brand").select("left_key", "right_key")
    return X.pair_id_types(pairs, compound_xref(spark, sf, True)).withColumn("id_types", F.array_join("id_types", ","))


@query("source_whitelist", "SELECT 'P' || c_custkey AS entity_key, 'name' AS id_type, c_name AS id_value FROM customer")
def source_whitelist(spark, sf):
    c = xref_rows(table(spark, sf, "customer"), "protein", key("P", "c_custkey"), "customer", {"name": F.col("c_name")})
    s = xref_rows(table(spark, sf, "supplier"), "protein", key("S", "s_suppkey"), "supplier", {"name": F.col("s_name")})
    return X.filter_sources(c.unionByName(s), ["customer", "hmdb"]).select("entity_key", "id_type", "id_value")


@query("available_values", "SELECT 'C' || p_partkey AS entity_key, p_name AS id_value FROM part WHERE p_type <> 'PROMO' AND p_name <> ''")
def available_values(spark, sf):
    x = xref_rows(table(spark, sf, "part"), "compound", key("C", "p_partkey"), "part",
                  {"name": F.when(F.col("p_type") == "PROMO", F.lit("Not Available")).otherwise(F.col("p_name"))})
    return X.drop_unavailable(x).select("entity_key", "id_value")


@query(
    "protein_ids",
    """WITH k AS (SELECT 'P' || c_custkey AS entity_key, '1.2.' || c_nationkey || '.' || c_custkey AS ec, c_custkey FROM customer)
SELECT entity_key, 'enzyme_ec' AS id_type, ec AS id_value, CAST(1 AS BIGINT) AS n FROM k
UNION ALL SELECT entity_key, 'metacyc', ec, 1 FROM k UNION ALL SELECT entity_key, 'kegg', ec, 1 FROM k
UNION ALL SELECT entity_key, 'uniprot', ec, 1 FROM k WHERE c_custkey % 2 = 0""",
)
def protein_ids(spark, sf):
    """Half of the customers carry an enzyme number as such, half only as a UniProt id that has its shape."""
    ec = F.concat_ws(".", F.lit("1.2"), F.col("c_nationkey").cast("string"), F.col("c_custkey").cast("string"))
    odd = F.col("c_custkey") % 2 == 1
    x = xref_rows(table(spark, sf, "customer"), "protein", key("P", "c_custkey"), "customer", {"enzyme_ec": F.when(odd, ec), "uniprot": F.when(~odd, ec)})
    return X.derive_protein_ids(x).select("entity_key", "id_type", "id_value", "n")


@query(
    "remove_values",
    f"WITH {compound_sql()} SELECT entity_key, id_type, id_value FROM cx WHERE NOT (id_type = 'brand' AND substr(entity_key, 2) IN (SELECT CAST(l_partkey AS VARCHAR) FROM lineitem WHERE l_returnflag = 'R'))",
)
def remove_values(spark, sf):
    """Brands are removed from parts that were ever returned."""
    back = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(key("C", "l_partkey").alias("entity_key")).distinct()
    x = compound_xref(spark, sf)
    removals = x.filter("id_type = 'brand'").join(back, "entity_key", "left_semi")
    return X.remove_values(x, removals)[0].select("entity_key", "id_type", "id_value")


@query(
    "removed_sources",
    f"WITH {EDGE} SELECT DISTINCT src_key, dst_key, source_db FROM edge WHERE edge_type = 'gp' AND dst_key IN (SELECT 'P' || c_custkey FROM customer WHERE c_acctbal < 0)",
)
def removed_sources(spark, sf):
    """Links to customers in debt are removed; the removed rows tell which source had given them."""
    e = edges(spark, sf).filter("edge_type = 'gp'")
    poor = table(spark, sf, "customer").filter("c_acctbal < 0").select(key("P", "c_custkey").alias("dst_key"))
    return X.remove_values(e, poor, ["dst_key"])[1].select("src_key", "dst_key", "source_db").distinct()


@query(
    "link_sources",
    """WITH l AS (SELECT 'R' || l_orderkey AS src_key, 'C' || l_partkey AS dst_key, 'S' || l_suppkey AS db, CAST(l_shipdate AS DATE) AS ts FROM lineitem)
SELECT src_key, dst_key, string_agg(DISTINCT db, ',' ORDER BY db) AS sources, count(DISTINCT db) AS n_sources, min(ts) AS first_seen FROM l GROUP BY ALL""",
)
def link_sources(spark, sf):
    """The supplier as the source of a reaction-compound link."""
    e = table(spark, sf, "lineitem").select(
        F.lit("rc").alias("edge_type"), key("R", "l_orderkey").alias("src_key"), key("C", "l_partkey").alias("dst_key"),
        key("S", "l_suppkey").alias("source_db"), F.to_date("l_shipdate").alias("ts"))
    return X.link_sources(e).drop("edge_type").withColumn("sources", F.array_join("sources", ","))


@query(
    "lookup",
    f"""WITH {compound_sql()} SELECT s.id_type AS seed_type, s.id_value AS seed_value, c.entity_key, c.id_type, c.id_value
FROM (SELECT DISTINCT 'brand' AS id_type, 'Brand#' || r_regionkey * 7 AS id_value FROM region) s
LEFT JOIN cx h USING (id_type, id_value) LEFT JOIN cx c ON c.entity_key = h.entity_key""",
)
def lookup(spark, sf):
    """All details of the parts of some brands; unknown brands stay as misses."""
    s = table(spark, sf, "region").select(F.lit("brand").alias("id_type"), F.concat(F.lit("Brand#"), (F.col("r_regionkey") * 7).cast("string")).alias("id_value"))
    return L.lookup(s, compound_xref(spark, sf), misses=True).select("seed_type", "seed_value", "entity_key", "id_type", "id_value")


@query(
    "index_compound_reaction",
    f"WITH {PARTICIPANT} SELECT compound_key, string_agg(DISTINCT reaction_key, ',' ORDER BY reaction_key) AS reaction_keys FROM participant GROUP BY ALL",
)
def index_compound_reaction(spark, sf):
    return L.index_compound_reaction(sides(spark, sf)).withColumn("reaction_keys", F.array_join("reaction_keys", ","))


@query(
    "index_ec_reaction",
    "SELECT '1.1.1.' || o_custkey % 50 AS enzyme_ec, string_agg(DISTINCT 'R' || o_orderkey, ',' ORDER BY 'R' || o_orderkey) AS reaction_keys FROM orders GROUP BY ALL",
)
def index_ec_reaction(spark, sf):
    return L.index_ec_reaction(_reaction_ids(spark, sf)).withColumn("reaction_keys", F.array_join("reaction_keys", ","))


def _reaction_ids(spark, sf):
    ec = F.concat(F.lit("1.1.1."), (F.col("o_custkey") % 50).cast("string"))
    return xref_rows(table(spark, sf, "orders"), "reaction", key("R", "o_orderkey"), "orders",
                     {"enzyme_ec": ec, "kegg": F.col("o_custkey"), "intermediate": F.col("o_custkey") % 400})


@query(
    "index_uniprot_protein",
    "SELECT c_mktsegment || c_nationkey AS uniprot, string_agg('P' || c_custkey, ',' ORDER BY 'P' || c_custkey) AS protein_keys FROM customer GROUP BY ALL",
)
def index_uniprot_protein(spark, sf):
    up = F.concat("c_mktsegment", F.col("c_nationkey").cast("string"))
    x = xref_rows(table(spark, sf, "customer"), "protein", key("P", "c_custkey"), "customer", {"uniprot": up})
    return L.index_uniprot_protein(x).withColumn("protein_keys", F.array_join("protein_keys", ","))


BRIDGE_SQL = """
pb AS (SELECT CAST(c_custkey % 600 AS VARCHAR) AS bridge_id, 'P' || c_custkey AS protein_key FROM customer WHERE c_custkey % 600 >= 100),
rb AS (SELECT CAST(o_custkey % 400 AS VARCHAR) AS bridge_id, 'R' || o_orderkey AS reaction_key FROM orders)"""


def _bridges(spark, sf):
    p = table(spark, sf, "customer").filter("c_custkey % 600 >= 100").select(
        (F.col("c_custkey") % 600).cast("string").alias("bridge_id"), key("P", "c_custkey").alias("protein_key"))
    r = table(spark, sf, "orders").select((F.col("o_custkey") % 400).cast("string").alias("bridge_id"), key("R", "o_orderkey").alias("reaction_key"))
    return p, r


@query(
    "bridge_links",
    f"""WITH {BRIDGE_SQL} SELECT bridge_id, coalesce(p, '-') AS protein_keys, coalesce(r, '-') AS reaction_keys
FROM (SELECT bridge_id, string_agg(protein_key, ',' ORDER BY protein_key) AS p FROM pb GROUP BY ALL)
FULL JOIN (SELECT bridge_id, string_agg(reaction_key, ',' ORDER BY reaction_key) AS r FROM rb GROUP BY ALL) USING (bridge_id)""",
)
def bridge_links(spark, sf):
    p, r = _bridges(spark, sf)
    txt = lambda c: F.coalesce(F.array_join(c, ","), F.lit("-")).alias(c)
    return L.bridge(p, r).select("bridge_id", txt("protein_keys"), txt("reaction_keys"))


@query(
    "ec_to_protein",
    f"""WITH {BRIDGE_SQL}, ec AS (SELECT '1.1.1.' || o_custkey % 50 AS enzyme_ec, 'R' || o_orderkey AS reaction_key FROM orders)
SELECT DISTINCT enzyme_ec, protein_key, CASE c_nationkey % 3 WHEN 0 THEN 'subunit' WHEN 1 THEN 'complex' ELSE 'plain' END AS role
FROM ec JOIN rb USING (reaction_key) JOIN pb USING (bridge_id) JOIN customer ON protein_key = 'P' || c_custkey
WHERE enzyme_ec IN (SELECT '1.1.1.' || r_regionkey FROM region)""",
)
def ec_to_protein(spark, sf):
    p, r = _bridges(spark, sf)
    ec = _reaction_ids(spark, sf).filter("id_type = 'enzyme_ec'").select(F.col("id_value").alias("enzyme_ec"), F.col("entity_key").alias("reaction_key"))
    kind = F.when(F.col("c_nationkey") % 3 == 0, "complex_ids").when(F.col("c_nationkey") % 3 == 1, "subunit_ids").otherwise("gene_ids")
    links = table(spark, sf, "customer").select(key("P", "c_custkey").alias("protein_key"), kind.alias("kind"), F.lit("x").alias("other_key"))
    ecs = table(spark, sf, "region").select(F.concat(F.lit("1.1.1."), F.col("r_regionkey").cast("string")).alias("enzyme_ec"))
    return L.ec_to_protein(ecs, ec, r, p, links)


@query(
    "protein_links",
    f"""WITH {BRIDGE_SQL}, want AS (SELECT 'P' || c_custkey AS protein_key, c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'BUILDING'),
pr AS (SELECT DISTINCT protein_key, reaction_key FROM want JOIN rb ON bridge_id = CAST(c_custkey % 400 AS VARCHAR))
SELECT protein_key, 'gene' AS link, CAST(c_nationkey AS VARCHAR) AS target FROM want
UNION ALL SELECT protein_key, 'in_complex', CAST(c_custkey // 10 AS VARCHAR) FROM want
UNION ALL SELECT protein_key, 'reaction', reaction_key FROM pr
UNION ALL SELECT DISTINCT protein_key, 'enzyme_ec', '1.1.1.' || o_custkey % 50 FROM pr JOIN orders ON reaction_key = 'R' || o_orderkey""",
)
def protein_links(spark, sf):
    c = table(spark, sf, "customer")
    x = xref_rows(c, "protein", key("P", "c_custkey"), "customer", {
        "gene_ids": F.col("c_nationkey"), "complex_ids": F.floor(F.col("c_custkey") / 10), "intermediate_reaction_ids": F.col("c_custkey") % 400})
    want = c.filter("c_mktsegment = 'BUILDING'").select(key("P", "c_custkey").alias("protein_key"))
    return L.protein_links(want, x, _bridges(spark, sf)[1], _reaction_ids(spark, sf))


def _alt(spark, sf):
    p = table(spark, sf, "part")
    return p.filter("p_size > 25").select(F.concat(F.lit("A"), F.col("p_partkey").cast("string")).alias("alt_id"), key("C", "p_size").alias("master_id"))


@query("alt_id_fallback", "SELECT 'A' || p_partkey AS id, CASE WHEN p_size > 25 THEN 'C' || p_size ELSE 'A' || p_partkey END AS master_id FROM part")
def alt_id_fallback(spark, sf):
    return L.resolve_alt(table(spark, sf, "part").select(key("A", "p_partkey").alias("id")), _alt(spark, sf))


@query(
    "reactions_by_id",
    "SELECT DISTINCT 'kegg' AS id_type, CAST(o_custkey AS VARCHAR) AS id_value, 'R' || o_orderkey AS reaction_key FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'",
)
def reactions_by_id(spark, sf):
    ids = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.lit("kegg").alias("id_type"), F.col("c_custkey").cast("string").alias("id_value"))
    return L.reactions_by_id(ids, _reaction_ids(spark, sf))


@query(
    "reactions_by_participant",
    f"WITH {EQUATION} SELECT DISTINCT p_partkey AS id, reaction_key FROM participant JOIN part ON compound_key = 'C' || p_partkey WHERE p_brand = 'Brand#2' AND reaction_key IN (SELECT reaction_key FROM equation)",
)
def reactions_by_participant(spark, sf):
    """Reactions whose id equation holds a compound number; 12 never matches 123."""
    eq = equation_parts(spark, sf).select("reaction_key", format_equation("parts", "direction", False).alias("equation"))
    ids = table(spark, sf, "part").filter("p_brand = 'Brand#2'").select(F.col("p_partkey").cast("string").alias("id"))
    return L.reactions_by_participant(ids, eq).select(F.col("id").cast("bigint").alias("id"), "reaction_key")


CHEBI_SQL = """
chebi AS (SELECT CAST(p_partkey AS VARCHAR) AS chebi, 'name' AS id_type, p_name AS id_value FROM part WHERE p_size <= 25
  UNION ALL SELECT CAST(a.p_partkey AS VARCHAR), 'chebi', CAST(b.p_partkey AS VARCHAR) FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1 WHERE a.p_size <= 25 AND b.p_size > 25
  UNION ALL SELECT CAST(a.p_partkey AS VARCHAR), 'chebi', CAST(b.p_partkey AS VARCHAR) FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 2 WHERE a.p_size <= 25 AND b.p_size > 40),
asked AS (SELECT CAST(p_partkey AS VARCHAR) AS asked FROM part),
mains AS (SELECT id_value, min(chebi) AS lo, max(chebi) AS hi FROM chebi WHERE id_type = 'chebi' GROUP BY ALL)"""


def _chebi(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size", "p_name")
    main = p.filter("p_size <= 25")
    s = lambda c: F.col(c).cast("string")
    rows = main.select(s("p_partkey").alias("chebi"), F.lit("name").alias("id_type"), F.col("p_name").alias("id_value"))
    for step, least in ((1, 25), (2, 40)):
        alt = p.filter(F.col("p_size") > least).select((F.col("p_partkey") - step).alias("p_partkey"), s("p_partkey").alias("id_value"))
        rows = rows.unionByName(main.join(alt, "p_partkey").select(s("p_partkey").alias("chebi"), F.lit("chebi").alias("id_type"), "id_value"))
    return rows


@query(
    "chebi_fallback",
    f"""WITH {CHEBI_SQL}, via AS (
  SELECT asked, asked AS chebi FROM asked WHERE asked IN (SELECT chebi FROM chebi)
  UNION ALL SELECT asked, lo FROM asked LEFT JOIN mains ON asked = id_value WHERE asked NOT IN (SELECT chebi FROM chebi) AND lo IS NOT DISTINCT FROM hi)
SELECT asked, coalesce(via.chebi, '-') AS chebi, coalesce(id_type, '-') AS id_type, coalesce(c.id_value, '-') AS id_value FROM via LEFT JOIN chebi c ON c.chebi = via.chebi""",
)
def chebi_fallback(spark, sf):
    """Ontology cross-references, through the main id when the asked one is secondary."""
    ids = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"))
    got, _ = L.chebi_xref(ids, _chebi(spark, sf))
    return got.na.fill("-")


@query("chebi_ambiguous", f"WITH {CHEBI_SQL} SELECT asked FROM asked JOIN mains ON asked = id_value WHERE asked NOT IN (SELECT chebi FROM chebi) AND lo <> hi")
def chebi_ambiguous(spark, sf):
    """Secondary ids with more than one main id."""
    ids = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("id"))
    return L.chebi_xref(ids, _chebi(spark, sf))[1]


@query(
    "enrich_compounds",
    f"""WITH {CHEBI_SQL}, via AS (
  SELECT asked, asked AS chebi FROM asked WHERE asked IN (SELECT chebi FROM chebi)
  UNION ALL SELECT asked, lo FROM asked JOIN mains ON asked = id_value WHERE asked NOT IN (SELECT chebi FROM chebi) AND lo = hi),
rows_ AS (SELECT asked, 'part' AS source_db, 'chebi' AS id_type, asked AS id_value FROM asked
  UNION ALL (SELECT DISTINCT * FROM (SELECT asked, 'chebi', id_type, id_value FROM via JOIN chebi USING (chebi) UNION ALL SELECT asked, 'chebi', 'chebi', chebi FROM via)))
SELECT 'C' || asked AS entity_key, source_db, id_type, id_value, count(*) AS n FROM rows_ GROUP BY ALL""",
)
def enrich_compounds(spark, sf):
    x = xref_rows(table(spark, sf, "part"), "compound", key("C", "p_partkey"), "part", {"chebi": F.col("p_partkey")})
    return L.enrich_chebi(x, _chebi(spark, sf)).drop("entity_type")


NAME_SQL = """
q AS (SELECT DISTINCT query FROM (SELECT text AS query FROM benchmark UNION ALL SELECT p_name FROM part UNION ALL SELECT text FROM documents)),
n AS (SELECT 'D' || doc_id AS entity_key, lower(text) AS name FROM documents UNION ALL SELECT 'C' || p_partkey, lower(p_name) FROM part),
exact AS (SELECT query, min(entity_key) AS entity_key FROM q JOIN n ON lower(query) = name GROUP BY query)"""


@query(
    "name_search",
    f"""WITH {NAME_SQL} SELECT query, entity_key, 'exact' AS how FROM exact
UNION ALL SELECT DISTINCT query, entity_key, 'contains' FROM q JOIN n ON contains(name, lower(query)) WHERE query NOT IN (SELECT query FROM exact)""",
)
def name_search(spark, sf):
    """Benchmark passages, part names and whole documents looked up in whole documents and part names."""
    d, p = table(spark, sf, "documents"), table(spark, sf, "part")
    q = table(spark, sf, "benchmark").select(F.col("text").alias("query")).unionByName(p.select(F.col("p_name").alias("query"))).unionByName(
        d.select(F.col("text").alias("query")))
    names = d.select(key("D", "doc_id").alias("entity_key"), F.col("text").alias("name")).unionByName(
        p.select(key("C", "p_partkey").alias("entity_key"), F.col("p_name").alias("name")))
    return L.name_search(q, names)


@query(
    "uniprot_fanout",
    """SELECT DISTINCT c_mktsegment AS uniprot, unnest(['kegg', 'hmdb']) AS id_type, unnest(['N' || c_nationkey, 'P' || c_custkey]) AS id_value
FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')""",
)
def uniprot_fanout(spark, sf):
    c = table(spark, sf, "customer")
    links = {"kegg": c.select(F.col("c_mktsegment").alias("uniprot"), key("N", "c_nationkey").alias("id_value")),
             "hmdb": c.select(F.col("c_mktsegment").alias("uniprot"), key("P", "c_custkey").alias("id_value"))}
    seeds = c.filter("c_mktsegment in ('BUILDING', 'MACHINERY')").select(F.col("c_mktsegment").alias("uniprot"))
    return L.uniprot_fanout(seeds, links)


@query("ko_to_ec", "SELECT 'K' || p_partkey AS ko, unnest(['1.1.1.' || p_size, p_size || '.2.-.-']) AS enzyme_ec FROM part WHERE p_type <> 'SMALL'")
def ko_to_ec(spark, sf):
    ec = F.concat(F.lit(" [EC:1.1.1."), F.col("p_size").cast("string"), F.lit(" "), F.col("p_size").cast("string"), F.lit(".2.-.-]"))
    d = F.concat("p_name", F.when(F.col("p_type") != "SMALL", ec).otherwise(""))
    return L.ko_to_ec(table(spark, sf, "part").select(key("K", "p_partkey").alias("ko"), d.alias("description")))


@query(
    "uniprot_to_ec",
    """SELECT DISTINCT 'U' || c_custkey AS uniprot, '1.1.1.' || c_nationkey AS enzyme_ec, 'gene' AS via FROM customer WHERE c_nationkey % 2 = 0
UNION ALL SELECT DISTINCT 'U' || c_custkey, '2.' || n_regionkey || '.1.1', 'ko' FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey % 2 = 1""",
)
def uniprot_to_ec(spark, sf):
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    gene_of = c.select(key("U", "c_custkey").alias("uniprot"), key("G", "c_nationkey").alias("gene"))
    ec_of = n.filter("n_nationkey % 2 = 0").select(key("G", "n_nationkey").alias("gene"), key("1.1.1.", "n_nationkey").alias("enzyme_ec"))
    ko_of = n.select(key("G", "n_nationkey").alias("gene"), key("K", "n_regionkey").alias("ko"))
    ko_ec = table(spark, sf, "region").select(key("K", "r_regionkey").alias("ko"), F.concat(key("2.", "r_regionkey"), F.lit(".1.1")).alias("enzyme_ec"))
    return L.uniprot_to_ec(c.select(key("U", "c_custkey").alias("uniprot")), gene_of, ec_of, ko_of, ko_ec)


@query(
    "reactions_mentioning",
    f"""WITH {PARTICIPANT}, txt AS (SELECT reaction_key, string_agg(p_name, ' + ' ORDER BY pos, side) AS t FROM participant JOIN part ON compound_key = 'C' || p_partkey WHERE p_type <> 'PROMO' GROUP BY ALL)
SELECT DISTINCT compound_key, reaction_key FROM participant JOIN part ON compound_key = 'C' || p_partkey JOIN txt USING (reaction_key) WHERE contains(t, p_name)""",
)
def reactions_mentioning(spark, sf):
    """Reaction texts leave out promotional parts; a link stays if the text still names the compound."""
    names = table(spark, sf, "part").select(key("C", "p_partkey").alias("compound_key"), F.col("p_name").alias("name"), "p_type")
    pt = participants(spark, sf)
    word = pt.join(names.filter("p_type <> 'PROMO'"), "compound_key")
    text = word.groupBy("reaction_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "side", "name"))), lambda x: x["name"]), " + ").alias("equation"))
    return L.reactions_mentioning(pt, text, names)


@query(
    "stoplist_flag",
    "SELECT DISTINCT 'C' || p_partkey AS entity_key FROM part WHERE p_brand IN (SELECT 'Brand#' || (doc_id % 5) FROM labels WHERE toxic = 1)",
)
def stoplist_flag(spark, sf):
    """Stop-list ids carry blanks and odd case and still match."""
    stop = table(spark, sf, "labels").filter("toxic = 1").select(
        F.lit("brand").alias("id_type"), F.concat(F.lit(" BRAND#"), (F.col("doc_id") % 5).cast("string"), F.lit("  ")).alias("id_value"))
    return L.flag_ubiquitous(compound_xref(spark, sf), stop)


@query("unseen", "SELECT DISTINCT 'orders' AS db, CAST(o_custkey AS VARCHAR) AS id FROM orders WHERE o_custkey NOT IN (SELECT user_id FROM events)")
def unseen(spark, sf):
    """Search keys that were not searched before; empty keys count as seen."""
    f = table(spark, sf, "orders").select(F.lit("orders").alias("db"), F.when(F.col("o_custkey") >= 0, F.col("o_custkey").cast("string")).otherwise("").alias("id")).distinct()
    v = table(spark, sf, "events").select(F.lit("orders").alias("db"), F.col("user_id").cast("string").alias("id"))
    return L.unseen(f, v, ["db", "id"])


@query(
    "assemble",
    f"""WITH {EDGE}, {PARTICIPANT}, s AS (SELECT 'R' || o_orderkey AS k, o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F')
SELECT k AS entity_key, 'id' AS part, 'customer' AS k, CAST(o_custkey AS VARCHAR) AS v FROM s
UNION ALL SELECT DISTINCT src_key, 'link', edge_type, dst_key FROM edge JOIN s ON src_key = k
UNION ALL SELECT DISTINCT reaction_key, 'participant', side, stoich || ' ' || compound_key FROM participant JOIN s ON reaction_key = k""",
)
def assemble(spark, sf):
    """Everything stored on finished orders: ids, links and participants."""
    o = table(spark, sf, "orders")
    x = xref_rows(o, "reaction", key("R", "o_orderkey"), "orders", {"customer": F.col("o_custkey")})
    s = o.filter("o_orderstatus = 'F'").select(F.lit("reaction").alias("entity_type"), key("R", "o_orderkey").alias("entity_key"))
    return L.assemble(s, x, edges(spark, sf), participants(spark, sf)).drop("entity_type")


@query(
    "reaction_master",
    f"""WITH {EQUATION} SELECT e.reaction_key AS master_id, e.equation,
  (SELECT string_agg(DISTINCT 'A' || l_suppkey, ',' ORDER BY 'A' || l_suppkey) FROM lineitem WHERE 'R' || l_orderkey = e.reaction_key) AS alt_ids,
  CAST(o_custkey AS VARCHAR) AS kegg, coalesce(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderpriority END, '-') AS uniprot
FROM equation e JOIN orders ON e.reaction_key = 'R' || o_orderkey WHERE o_orderstatus <> 'P'""",
)
def reaction_master(spark, sf):
    o = table(spark, sf, "orders")
    k = key("R", "o_orderkey").alias("master_id")
    eq = equation_parts(spark, sf).select("reaction_key", format_equation("parts", "direction").alias("equation"))
    dirs = table(spark, sf, "lineitem").join(o.filter("o_orderstatus <> 'P'"), F.col("l_orderkey") == F.col("o_orderkey")).select(k, key("A", "l_suppkey").alias("alt_id"))
    xr = o.select(k, F.lit("kegg").alias("id_type"), F.col("o_custkey").cast("string").alias("id_value"))
    up = o.filter("o_orderpriority = '1-URGENT'").select(k, F.col("o_orderpriority").alias("id_value"))
    txt = lambda c: F.array_join(c, ",").alias(c)
    return L.reaction_master(eq, dirs, xr, up).select("master_id", "equation", txt("alt_ids"), txt("kegg"), F.coalesce(F.array_join("uniprot", ","), F.lit("-")).alias("uniprot"))


@query("explode_accessions", "SELECT p_name AS name, unnest(['C' || p_partkey, p_brand]) AS accession FROM part")
def explode_accessions(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_name").alias("name"), F.array(key("C", "p_partkey"), F.col("p_brand")).alias("accessions"))
    return L.explode_accessions(p)
