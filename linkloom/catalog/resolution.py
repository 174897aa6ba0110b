"""Queries on matching, entity resolution and id closure."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.catalog.registry import query
from linkloom.catalog.roles import (
    COMPONENTS,
    EDGE,
    PART_RULES,
    PARTICIPANT,
    compound_sql,
    compound_xref,
    edges,
    key,
    participants,
    sides,
    table,
    xref_rows,
)
from linkloom.operators import incremental as I
from linkloom.operators import matching as M
from linkloom.operators import resolve as R
from linkloom.operators.matching import MatchConfig, Rule


def pair_score_sql(rules, xref: str = "cx", pairs: str = "pairs") -> str:
    """Brute force score of pairs: per id type the overlap and the presence on both sides."""
    cases = " + ".join(
        f"CASE WHEN list_contains(shared, '{r.id_type}') THEN {r.gain} WHEN list_contains(l.types, '{r.id_type}') AND list_contains(r.types, '{r.id_type}') THEN -{r.penalty} ELSE 0 END"
        for r in rules)
    absolute = ", ".join(f"'{r.id_type}'" for r in rules if r.absolute)
    return f"""
has AS (SELECT entity_key, list(DISTINCT id_type) AS types FROM {xref} GROUP BY entity_key),
met AS (SELECT left_key, right_key, list(DISTINCT a.id_type) AS shared FROM {pairs}
        JOIN {xref} a ON a.entity_key = left_key JOIN {xref} b ON b.entity_key = right_key AND a.id_type = b.id_type AND a.id_value = b.id_value
        GROUP BY ALL),
full_pairs AS (SELECT left_key, right_key, coalesce(shared, []) AS shared FROM {pairs} LEFT JOIN met USING (left_key, right_key)),
judged AS (
  SELECT left_key, right_key, CAST({cases} AS DOUBLE) AS score,
         len(list_filter(list_intersect(l.types, r.types), lambda x: x IN ({absolute}))) > 0
         AND len(list_filter(list_intersect(l.types, r.types), lambda x: x IN ({absolute}))) = len(list_filter(shared, lambda x: x IN ({absolute}))) AS absolute
  FROM full_pairs JOIN has l ON l.entity_key = left_key JOIN has r ON r.entity_key = right_key
)"""


# one partner per compound: the smallest compound with the same name
PAIRS_SQL = """
pairs AS (SELECT 'C' || a.p_partkey AS left_key, b.k AS right_key FROM part a
          JOIN (SELECT p_name, min('C' || p_partkey) AS k FROM part GROUP BY p_name) b USING (p_name) WHERE 'C' || a.p_partkey <> b.k)"""


def name_pairs(spark, sf):
    p = table(spark, sf, "part").select(key("C", "p_partkey").alias("left_key"), "p_name")
    first = p.groupBy("p_name").agg(F.min("left_key").alias("right_key"))
    return p.join(first, "p_name").filter("left_key <> right_key").select("left_key", "right_key")


@query(
    "score_pairs_compound",
    f"WITH {compound_sql(True)}, {PAIRS_SQL}, {pair_score_sql(PART_RULES.rules)} SELECT left_key, right_key, score, absolute, score >= 3 OR absolute AS matched FROM judged",
)
def score_pairs_compound(spark, sf):
    """Every compound against the smallest one of the same name."""
    feats = M.features(compound_xref(spark, sf, True), PART_RULES)
    return M.score_pairs(name_pairs(spark, sf), feats, PART_RULES)


@query(
    "match_ceiling",
    f"WITH {compound_sql(True)}, {PAIRS_SQL}, {pair_score_sql(PART_RULES.rules)} SELECT left_key, right_key FROM judged WHERE ceil(score) >= 3",
)
def match_ceiling(spark, sf):
    """The same with scores rounded up and without the absolute rule."""
    rules = MatchConfig(PART_RULES.rules, 3, use_absolute=False, ceil=True, hmdb_type=None)
    feats = M.features(compound_xref(spark, sf, True), rules)
    return M.score_pairs(name_pairs(spark, sf), feats, rules).filter("matched").select("left_key", "right_key")


GENE_SQL = """
gx AS (SELECT 'G' || n_nationkey AS entity_key, 'uniprot' AS id_type, CAST(n_regionkey AS VARCHAR) AS id_value FROM nation
       UNION ALL SELECT 'G' || n_nationkey, 'kegg', n_name FROM nation UNION ALL SELECT 'G' || n_nationkey, 'hmdb', CAST(n_nationkey % 3 AS VARCHAR) FROM nation),
pairs AS (SELECT a.entity_key AS left_key, min(b.entity_key) AS right_key FROM gx a JOIN gx b USING (id_type, id_value) WHERE id_type = 'uniprot' AND a.entity_key <> b.entity_key GROUP BY ALL)"""


@query(
    "score_pairs_gene",
    f"WITH {GENE_SQL}, {pair_score_sql(M.GENE.rules, 'gx')} SELECT left_key, right_key, score, absolute, score >= 2 OR absolute AS matched FROM judged",
)
def score_pairs_gene(spark, sf):
    """Nations as genes: region as UniProt id, name as KEGG id."""
    n = table(spark, sf, "nation")
    x = xref_rows(n, "gene", key("G", "n_nationkey"), "nation",
                  {"uniprot": F.col("n_regionkey"), "kegg": F.col("n_name"), "hmdb": F.col("n_nationkey") % 3})
    g = n.select(key("G", "n_nationkey").alias("left_key"), "n_regionkey")
    low = F.array_sort(F.collect_set("left_key"))  # at most the nations of one region
    two = g.groupBy("n_regionkey").agg(F.min("left_key").alias("lo"), F.element_at(low, 2).alias("next"))
    pairs = g.join(two, "n_regionkey").select("left_key", F.when(F.col("left_key") == F.col("lo"), F.col("next")).otherwise(F.col("lo")).alias("right_key"))
    return M.score_pairs(pairs, M.features(x, M.GENE), M.GENE)


PROTEIN_SQL = """
px0 AS (SELECT 'P' || c_custkey AS entity_key, c_custkey, c_nationkey, c_mktsegment FROM customer),
px AS (SELECT entity_key, 'kegg' AS id_type, CAST(c_nationkey AS VARCHAR) AS id_value FROM px0
       UNION ALL SELECT entity_key, 'metacyc', CAST(c_custkey % 7 AS VARCHAR) FROM px0 WHERE c_custkey % 2 = 0
       UNION ALL SELECT entity_key, 'synonyms', lower(c_mktsegment) FROM px0
       UNION ALL SELECT entity_key, 'single_ec', '1.1.1.' || (c_custkey % 5) FROM px0 WHERE c_custkey % 3 <> 0),
pairs AS (SELECT a.entity_key AS left_key, b.k AS right_key FROM px0 a
          JOIN (SELECT c_nationkey, min(entity_key) AS k FROM px0 GROUP BY ALL) b USING (c_nationkey) WHERE a.entity_key <> b.k)"""


def _protein_records(spark, sf):
    c = table(spark, sf, "customer")
    k = F.col("c_custkey")
    ec = lambda n: F.concat(F.lit("1.1.1."), (n % 5).cast("string"))
    return xref_rows(c, "protein", key("P", "c_custkey"), "customer", {
        "kegg": F.col("c_nationkey"), "metacyc": F.when(k % 2 == 0, k % 7), "synonyms": F.upper("c_mktsegment"), "enzyme_ec": ec(k),
    }).unionByName(xref_rows(c, "protein", key("P", "c_custkey"), "customer", {"enzyme_ec": F.when(k % 3 == 0, ec(k + 1))}))


@query(
    "score_pairs_protein",
    f"WITH {PROTEIN_SQL}, {pair_score_sql(M.PROTEIN.rules, 'px')} SELECT left_key, right_key, score, absolute, score >= 2 OR absolute AS matched FROM judged",
)
def score_pairs_protein(spark, sf):
    """Customers as proteins; every third one has two enzyme numbers, so the single number bonus is off."""
    p = table(spark, sf, "customer").select(key("P", "c_custkey").alias("left_key"), "c_nationkey")
    pairs = p.join(p.groupBy("c_nationkey").agg(F.min("left_key").alias("right_key")), "c_nationkey").filter("left_key <> right_key")
    return M.score_pairs(pairs, M.features(_protein_records(spark, sf), M.PROTEIN), M.PROTEIN)


REACTION_SQL = f"""
{PARTICIPANT},
sig AS (SELECT reaction_key, string_agg(compound_key, ',' ORDER BY compound_key) AS sig FROM participant GROUP BY ALL),
rx AS (SELECT reaction_key AS entity_key, 'participants' AS id_type, sig AS id_value FROM sig
       UNION ALL SELECT 'R' || o_orderkey, 'reaction_str', lower(o_orderpriority) FROM orders
       UNION ALL SELECT 'R' || o_orderkey, 'kegg', CAST(o_custkey AS VARCHAR) FROM orders),
pairs AS (SELECT a.k AS left_key, b.k AS right_key FROM (SELECT 'R' || o_orderkey AS k, o_custkey FROM orders) a
          JOIN (SELECT min('R' || o_orderkey) AS k, o_custkey FROM orders GROUP BY ALL) b USING (o_custkey) WHERE a.k <> b.k)"""


@query(
    "score_pairs_reaction",
    f"""WITH {REACTION_SQL}, {pair_score_sql(M.REACTION.rules, 'rx')}
SELECT left_key, right_key, score, absolute AND coalesce(s1.sig, '') = coalesce(s2.sig, '') AS absolute,
  score >= 2 OR (absolute AND coalesce(s1.sig, '') = coalesce(s2.sig, '')) AS matched
FROM judged LEFT JOIN sig s1 ON s1.reaction_key = left_key LEFT JOIN sig s2 ON s2.reaction_key = right_key""",
)
def score_pairs_reaction(spark, sf):
    """Orders as reactions: participants, equation text (priority) and one id (customer)."""
    o = table(spark, sf, "orders")
    x = xref_rows(o, "reaction", key("R", "o_orderkey"), "orders", {"reaction_str": F.col("o_orderpriority"), "kegg": F.col("o_custkey")})
    x = x.select("entity_type", "entity_key", "id_type", "id_value").unionByName(M.participant_signature(sides(spark, sf)))
    r = o.select(key("R", "o_orderkey").alias("left_key"), "o_custkey")
    pairs = r.join(r.groupBy("o_custkey").agg(F.min("left_key").alias("right_key")), "o_custkey").filter("left_key <> right_key")
    return M.score_pairs(pairs, M.features(x, M.REACTION), M.REACTION)


@query(
    "same_participants",
    f"""WITH {PARTICIPANT}, sig AS (SELECT reaction_key, string_agg(compound_key, ',' ORDER BY compound_key) AS sig FROM participant GROUP BY ALL)
SELECT sig.reaction_key AS left_key, b.k AS right_key, true AS same_participants FROM sig
JOIN (SELECT sig, min(reaction_key) AS k FROM sig GROUP BY sig) b USING (sig) WHERE sig.reaction_key <> b.k""",
)
def same_participants(spark, sf):
    """Reactions with the participants of an earlier one."""
    parts = sides(spark, sf)
    sig = M.participant_signature(parts).select(F.col("entity_key").alias("left_key"), "id_value")
    pairs = sig.join(sig.groupBy("id_value").agg(F.min("left_key").alias("right_key")), "id_value").filter("left_key <> right_key")
    return M.same_participants(pairs.select("left_key", "right_key"), parts)


# brute force over all pairs, then components
ALL_PAIRS = "pairs AS (SELECT DISTINCT a.entity_key AS left_key, b.entity_key AS right_key FROM cx a JOIN cx b USING (id_type, id_value) WHERE a.entity_key < b.entity_key)"


def cluster_sql(sparse: bool, tail: str, accept: str = "score >= 3 OR absolute") -> str:
    return f"""WITH RECURSIVE {compound_sql(sparse)}, {ALL_PAIRS}, {pair_score_sql(PART_RULES.rules)},
links AS (SELECT left_key AS a, right_key AS b FROM judged WHERE {accept} UNION ALL SELECT entity_key, entity_key FROM cx),
{COMPONENTS} {tail}"""


@query("resolve_clusters", cluster_sql(False, "SELECT node AS entity_key, component AS cluster_key FROM cc"))
def resolve_clusters(spark, sf):
    """Compounds resolved on name, brand, type and size."""
    return R.clusters(compound_xref(spark, sf), PART_RULES)


@query("resolve_sparse", cluster_sql(True, "SELECT node AS entity_key, component AS cluster_key FROM cc"))
def resolve_sparse(spark, sf):
    """The same when some compounds lack an id type, so the absolute rule and penalties matter."""
    return R.clusters(compound_xref(spark, sf, True), PART_RULES)


@query("resolve_score_only", cluster_sql(True, "SELECT node AS entity_key, component AS cluster_key FROM cc", "score >= 1.5"))
def resolve_score_only(spark, sf):
    """By score alone, with a lower threshold."""
    rules = MatchConfig(PART_RULES.rules, 1.5, use_absolute=False, hmdb_type=None)
    return R.clusters(compound_xref(spark, sf, True), rules)


@query("resolve_incremental", cluster_sql(True, "SELECT node AS entity_key, component AS cluster_key FROM cc"))
def resolve_incremental(spark, sf):
    """Half of the compounds are stored, the others arrive in two batches; the same as resolving all at once."""
    x = compound_xref(spark, sf, True)
    n = F.substring("entity_key", 2, 20).cast("long")
    store = I.insert(I.empty(spark), x.filter(n % 2 == 0), PART_RULES)
    for part in (1, 3):
        store = I.insert(store, x.filter(n % 4 == part), PART_RULES)
    return store.cluster


# names of two colours are withdrawn after resolution
WITHDRAWN = "id_type = 'name' AND (id_value LIKE 'red %' OR id_value LIKE 'blue %')"


@query(
    "resolve_after_removal",
    cluster_sql(True, "SELECT node AS entity_key, component AS cluster_key FROM cc").replace(
        "WHERE id_value IS NOT NULL", f"WHERE id_value IS NOT NULL AND NOT ({WITHDRAWN})"),
)
def resolve_after_removal(spark, sf):
    """Clusters once some names are gone: the same as resolving anew what is left."""
    x = compound_xref(spark, sf, True)
    store = I.insert(I.empty(spark), x, PART_RULES)
    return I.remove(store, x, x.filter(WITHDRAWN), PART_RULES)[0].cluster


@query(
    "merged_xref",
    cluster_sql(True, """SELECT 'compound' AS entity_type, component AS entity_key, id_type, id_value, count(*) AS n,
'part' AS sources FROM cx JOIN cc ON node = entity_key GROUP BY ALL"""),
)
def merged_xref(spark, sf):
    x = compound_xref(spark, sf, True)
    return R.merge_xref(x, R.clusters(x, PART_RULES)).withColumn("sources", F.array_join("sources", ","))


@query(
    "rekeyed_edges",
    cluster_sql(True, """SELECT DISTINCT 'rc' AS edge_type, 'R' || l_orderkey AS src_key, component AS dst_key, 'lineitem' AS source_db
FROM lineitem JOIN cc ON node = 'C' || l_partkey"""),
)
def rekeyed_edges(spark, sf):
    x = compound_xref(spark, sf, True)
    return R.rekey_edges(edges(spark, sf).filter("edge_type = 'rc'"), R.clusters(x, PART_RULES))


@query(
    "forced_union",
    cluster_sql(True, "SELECT node AS entity_key, component AS cluster_key FROM cc").replace(
        "UNION ALL SELECT entity_key, entity_key FROM cx)",
        "UNION ALL SELECT entity_key, entity_key FROM cx UNION ALL SELECT 'C' || p_partkey, (SELECT min('C' || p_partkey) FROM part q WHERE q.p_retailprice = p.p_retailprice) FROM part p)"),
)
def forced_union(spark, sf):
    """Compounds of the same price are joined whatever their score."""
    p = table(spark, sf, "part").select(key("C", "p_partkey").alias("left_key"), "p_retailprice")
    forced = p.join(p.groupBy("p_retailprice").agg(F.min("left_key").alias("right_key")), "p_retailprice")
    return R.clusters(compound_xref(spark, sf, True), PART_RULES, forced.select("left_key", "right_key"))


@query(
    "cluster_review",
    cluster_sql(True, ", size AS (SELECT component, count(*) AS size FROM cc GROUP BY ALL) SELECT node AS entity_key, component AS cluster_key, size FROM cc JOIN size USING (component) WHERE size > 3"),
)
def cluster_review(spark, sf):
    """Clusters of more than three members, for review."""
    return R.max_cluster_size(R.clusters(compound_xref(spark, sf, True), PART_RULES), 3)[1].select("entity_key", "cluster_key", "size")


@query(
    "candidate_search",
    f"""WITH {compound_sql(True)}, q AS (SELECT entity_key FROM cx WHERE id_type = 'type' AND id_value IN ('PROMO', 'ECONOMY')),
pairs AS (SELECT DISTINCT a.entity_key AS left_key, b.entity_key AS right_key FROM cx a JOIN cx b USING (id_type, id_value)
          WHERE a.entity_key IN (FROM q) AND b.entity_key NOT IN (FROM q)),
{pair_score_sql(PART_RULES.rules)} SELECT left_key AS record_key, min(right_key) AS candidate_key FROM judged WHERE score >= 1.5 OR absolute GROUP BY ALL""",
)
def candidate_search(spark, sf):
    """For records of two part types, the first of the other parts that matches."""
    rules = PART_RULES.with_threshold(1.5)
    x = compound_xref(spark, sf, True)
    mine = x.filter("id_type = 'type' and id_value in ('PROMO', 'ECONOMY')").select("entity_key").distinct()
    feats = lambda df: M.features(df, rules)
    return M.candidates(feats(x.join(mine, "entity_key", "left_semi")), feats(x.join(mine, "entity_key", "left_anti")), rules)


@query(
    "candidate_by_id",
    f"""WITH {compound_sql(True)}, q AS (SELECT DISTINCT id_value FROM cx WHERE id_type = 'name')
SELECT 'q' || id_value AS record_key, min(entity_key) AS candidate_key FROM q JOIN cx USING (id_value) WHERE id_type = 'name' GROUP BY ALL""",
)
def candidate_by_id(spark, sf):
    """Lookups by a single id: a one-value record with a threshold of one."""
    rules = PART_RULES.with_threshold(1)
    x = compound_xref(spark, sf, True)
    q = x.filter("id_type = 'name'").select(F.concat(F.lit("q"), "id_value").alias("entity_key"), "id_type", "id_value").distinct()
    return M.candidates(M.features(q, rules), M.features(x, rules), rules)


@query(
    "any_match",
    f"WITH {compound_sql(True)}, {PAIRS_SQL}, {pair_score_sql(PART_RULES.rules)} SELECT DISTINCT unnest([left_key, right_key]) AS entity_key FROM judged WHERE score >= 3 OR absolute",
)
def any_match(spark, sf):
    """Compounds that match at least one listed partner."""
    x = compound_xref(spark, sf, True)
    scored = M.score_pairs(name_pairs(spark, sf), M.features(x, PART_RULES), PART_RULES)
    return M.any_match(x.select("entity_key").distinct(), scored)


RAW_PARTS = f"""{PARTICIPANT},
raw AS (SELECT reaction_key, side, pos, CASE p_type WHEN 'SMALL' THEN upper(p_name) ELSE 'substance ' || p_partkey END AS name,
               CASE WHEN p_size <= 25 THEN 'C' || p_partkey ELSE 'X' || p_partkey END AS source_id
        FROM participant JOIN part ON compound_key = 'C' || p_partkey)"""


def _raw_parts(spark, sf):
    p = table(spark, sf, "part")
    names = p.select(
        key("C", "p_partkey").alias("compound_key"),
        F.when(F.col("p_type") == "SMALL", F.upper("p_name")).otherwise(F.concat(F.lit("substance "), F.col("p_partkey").cast("string"))).alias("name"),
        F.lit("part").alias("source_db"), key(F.when(F.col("p_size") <= 25, "C").otherwise("X"), "p_partkey").alias("source_id"))
    return participants(spark, sf).join(names, "compound_key").drop("compound_key")


def _part_ids(spark, sf):
    p = table(spark, sf, "part")
    return xref_rows(p, "compound", key("C", "p_partkey"), "part", {"synonyms": F.col("p_name"), "part": key("C", "p_partkey")})


@query(
    "participant_resolution",
    f"""WITH {RAW_PARTS}, nm AS (SELECT lower(p_name) AS lname, min('C' || p_partkey) AS k FROM part GROUP BY ALL)
SELECT reaction_key, side, CAST(pos AS INTEGER) AS pos, CASE WHEN nm.k IS NOT NULL THEN 'name' WHEN source_id LIKE 'C%' THEN 'id' ELSE 'stub' END AS how,
  CASE WHEN nm.k IS NOT NULL THEN nm.k WHEN source_id LIKE 'C%' THEN source_id
       ELSE 'stub:' || substr(sha256('part' || chr(1) || source_id || chr(1) || lower(name)), 1, 32) END AS compound_key
FROM raw LEFT JOIN nm ON lower(name) = lname""",
)
def participant_resolution(spark, sf):
    """Participants to compounds by name, then id, then search, else a stub."""
    return R.resolve_participants(_raw_parts(spark, sf), _part_ids(spark, sf)).select("reaction_key", "side", "pos", "how", "compound_key")


@query(
    "participant_resolution_by_id",
    f"""WITH {RAW_PARTS} SELECT reaction_key, side, CAST(pos AS INTEGER) AS pos, CASE WHEN source_id LIKE 'C%' THEN source_id ELSE '-' END AS compound_key FROM raw""",
)
def participant_resolution_by_id(spark, sf):
    return R.resolve_participants_by_id(_raw_parts(spark, sf), _part_ids(spark, sf)).select(
        "reaction_key", "side", "pos", F.coalesce("compound_key", F.lit("-")).alias("compound_key"))


@query(
    "stub_compounds",
    """SELECT 'compound' AS entity_type, 'stub:' || substr(sha256('part' || chr(1) || 'X' || p_partkey || chr(1) || 'substance ' || p_partkey), 1, 32) AS entity_key,
  'part' AS source_db, unnest(['synonyms', 'part']) AS id_type, unnest(['substance ' || p_partkey, 'X' || p_partkey]) AS id_value, CAST(1 AS BIGINT) AS n
FROM part WHERE p_type <> 'SMALL' AND p_size > 25 AND p_partkey IN (SELECT l_partkey FROM lineitem)""",
)
def stub_compounds(spark, sf):
    return R.stub_compounds(R.resolve_participants(_raw_parts(spark, sf), _part_ids(spark, sf), search=False))


@query(
    "id_closure",
    """WITH RECURSIVE x AS (SELECT c_custkey AS e, 'balance' AS t, CAST(c_acctbal AS VARCHAR) AS v FROM customer UNION ALL SELECT c_custkey, 'name', c_name FROM customer
  UNION ALL SELECT 100000000 + s_suppkey, 'balance', CAST(s_acctbal AS VARCHAR) FROM supplier UNION ALL SELECT 100000000 + s_suppkey, 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier),
links AS (SELECT DISTINCT 'e' || e AS a, 'i' || t || ':' || v AS b FROM x),
""" + COMPONENTS + """,
seeds AS (SELECT DISTINCT c_name AS v FROM customer WHERE c_mktsegment = 'BUILDING'),
sc AS (SELECT v, component FROM seeds JOIN cc ON node = 'iname:' || v)
SELECT v AS seed_value, count(*) AS n_ids FROM sc JOIN cc USING (component) WHERE node LIKE 'i%' GROUP BY v""",
)
def id_closure(spark, sf):
    """How many ids each seed customer learns when ids are followed through customers and suppliers."""
    x = xref_rows(table(spark, sf, "customer"), "protein", key("P", "c_custkey"), "customer", {"balance": F.col("c_acctbal"), "name": F.col("c_name")})
    x = x.unionByName(xref_rows(table(spark, sf, "supplier"), "protein", key("S", "s_suppkey"), "supplier", {"balance": F.col("s_acctbal"), "nation": F.col("s_nationkey")}))
    seeds = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(F.lit("name").alias("id_type"), F.col("c_name").alias("id_value"))
    start, ids = R.id_closure(seeds, x)
    sizes = ids.groupBy("component").agg(F.count("*").alias("n_ids"))
    return start.join(sizes, "component").select("seed_value", "n_ids")


@query(
    "synonym_fallback",
    """WITH nm AS (SELECT 'C' || p_partkey AS e, p_name AS name FROM part UNION ALL SELECT 'C' || p_partkey, split_part(p_name, ' ', 2) FROM part),
idx AS (SELECT 'b' || p_brand AS db, lower(p_name) AS name, min('C' || p_partkey) AS hit FROM part GROUP BY ALL
        UNION ALL SELECT DISTINCT 'word', split_part(lower(p_name), ' ', 2), 'W' || split_part(lower(p_name), ' ', 2) FROM part),
want AS (SELECT 'C' || p_partkey AS e, unnest(['bBrand#1', 'bBrand#2', 'word']) AS db FROM part),
miss AS (SELECT e, db FROM want EXCEPT SELECT 'C' || p_partkey, 'b' || p_brand FROM part)
SELECT e AS entity_key, db AS source_db, idx.name, hit AS hit_key FROM miss JOIN nm USING (e) JOIN idx USING (db) WHERE lower(nm.name) = idx.name
QUALIFY row_number() OVER (PARTITION BY e, db ORDER BY length(idx.name) DESC, idx.name, hit) = 1""",
)
def synonym_fallback(spark, sf):
    """Sources a compound still lacks, searched by its longest name first."""
    p = table(spark, sf, "part")
    word = F.element_at(F.split("p_name", " "), 2)
    k = key("C", "p_partkey")
    want = p.select(k.alias("entity_key"), F.explode(F.array(F.lit("bBrand#1"), F.lit("bBrand#2"), F.lit("word"))).alias("source_db"))
    found = p.select(k.alias("entity_key"), F.concat(F.lit("b"), "p_brand").alias("source_db"))
    names = p.select(k.alias("entity_key"), F.col("p_name").alias("name")).unionByName(p.select(k.alias("entity_key"), word.alias("name")))
    index = p.select(F.concat(F.lit("b"), "p_brand").alias("source_db"), k.alias("hit_key"), F.col("p_name").alias("name")).unionByName(
        p.select(F.lit("word").alias("source_db"), F.concat(F.lit("W"), F.lower(word)).alias("hit_key"), word.alias("name")).distinct())
    return R.synonym_fallback(want, found, names, index)


@query(
    "ec_record_union",
    """WITH r AS (SELECT 'P' || c_custkey AS e, 'customer' AS db, '1.1.' || c_nationkey || '.' || (c_custkey % 4) AS ec FROM customer
  UNION ALL SELECT 'S' || s_suppkey, 'supplier', '1.1.' || s_nationkey || '.' || (s_suppkey % 4) FROM supplier),
hub AS (SELECT ec, min(e) AS k FROM r GROUP BY ec HAVING count(DISTINCT db) = 2)
SELECT DISTINCT k AS left_key, e AS right_key FROM r JOIN hub USING (ec) WHERE e <> k""",
)
def ec_record_union(spark, sf):
    """Protein records of two sources that share an enzyme number, as forced pairs."""
    ec = lambda n, k: F.concat_ws(".", F.lit("1.1"), F.col(n).cast("string"), (F.col(k) % 4).cast("string"))
    x = xref_rows(table(spark, sf, "customer"), "protein", key("P", "c_custkey"), "customer", {"enzyme_ec": ec("c_nationkey", "c_custkey")})
    x = x.unionByName(xref_rows(table(spark, sf, "supplier"), "protein", key("S", "s_suppkey"), "supplier", {"enzyme_ec": ec("s_nationkey", "s_suppkey")}))
    return R.ec_record_pairs(x, "customer", "supplier")
