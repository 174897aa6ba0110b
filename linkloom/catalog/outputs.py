"""Queries on outputs and on the property graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.catalog.registry import query
from linkloom.catalog.roles import EDGE, EQUATION, edges, key, participants, reactions, table, xref_rows
from linkloom.operators import property_graph as G
from linkloom.operators.resolve import resolve_all
from linkloom.session import cut
from linkloom.sinks import export as B
from linkloom.sources.annotations import parse_entity_lines

# entity key/value rows: customers (proteins) with ids, orders (reactions) with equation and links
KV_SQL = f"""{EDGE}, {EQUATION},
pkv AS (SELECT 'protein' AS entity_type, 'P' || c_custkey AS internal_id, unnest(['enzyme_ec', 'synonyms']) AS k, unnest(['1.1.1.' || c_nationkey, c_name]) AS v FROM customer),
lkv AS (SELECT CASE edge_type WHEN 'gp' THEN 'gene' WHEN 'rp' THEN 'reaction' ELSE 'protein' END AS entity_type, src_key AS internal_id,
  CASE edge_type WHEN 'gp' THEN 'proteins_connected' WHEN 'rp' THEN 'proteins_connected' WHEN 'pg' THEN 'genes_connected' ELSE 'reactions_connected' END AS k, dst_key AS v
  FROM edge WHERE edge_type IN ('gp', 'pg', 'pr', 'rp')),
sides_ AS (SELECT p.reaction_key,
    coalesce(string_agg(compound_key, ' + ' ORDER BY pos) FILTER (side = 'left'), '') || ' ' || any_value(direction) || ' ' || coalesce(string_agg(compound_key, ' + ' ORDER BY pos) FILTER (side = 'right'), '') AS e,
    string_agg(stoich, ',' ORDER BY side, pos) AS st FROM participant p JOIN reaction USING (reaction_key) GROUP BY p.reaction_key),
kv AS (SELECT * FROM pkv UNION ALL SELECT * FROM lkv UNION ALL SELECT 'reaction', reaction_key, unnest(['reaction_compounds', 'stoichiometry']), unnest([e, st]) FROM sides_)"""


def kv(spark, sf):
    c = table(spark, sf, "customer")
    ec = key("1.1.1.", "c_nationkey")
    x = xref_rows(c, "protein", key("P", "c_custkey"), "customer", {"enzyme_ec": ec, "synonyms": F.col("c_name"), "metacyc": ec})
    e = edges(spark, sf).filter("edge_type in ('gp', 'pg', 'pr', 'rp')")
    return B.entity_kv(x, e, participants(spark, sf), reactions(spark, sf))


@query("entity_fields", f"WITH {KV_SQL} SELECT * FROM kv")
def entity_fields(spark, sf):
    """Key/value fields of all entities; the enzyme number under ``metacyc`` is not written."""
    return kv(spark, sf)


@query(
    "entity_lines",
    f"WITH {KV_SQL} SELECT entity_type, 'internal_id:' || internal_id || chr(9) || string_agg(k || ':' || v, chr(9) ORDER BY k || ':' || v) AS value FROM kv GROUP BY entity_type, internal_id",
)
def entity_lines(spark, sf):
    return B.entity_lines(kv(spark, sf))


@query("entity_round_trip", f"WITH {KV_SQL} SELECT * FROM kv")
def entity_round_trip(spark, sf):
    """Entity lines read back give the fields they were made from."""
    return parse_entity_lines(B.entity_lines(kv(spark, sf)))


def _shared(spark, sf):
    """Nations (genes) and customers (proteins) under the same keys; nations of a region are one gene."""
    n, c = table(spark, sf, "nation"), table(spark, sf, "customer")
    x = xref_rows(n, "gene", key("K", "n_nationkey"), "nation", {"uniprot": key("R", "n_regionkey")}).unionByName(
        xref_rows(c, "protein", key("K", "c_custkey"), "customer", {"uniprot": key("U", "c_custkey")}))
    e = c.select(F.lit("pg").alias("edge_type"), key("K", "c_custkey").alias("src_key"), key("K", "c_nationkey").alias("dst_key"), F.lit("customer").alias("source_db"))
    got = resolve_all(x, e, participants(spark, sf).limit(0), reaction=reactions(spark, sf).limit(0))
    ids = cut(B.dense_ids(got["xref"]))
    return B.entity_kv(got["xref"], got["edge"], got["participant"], got["reaction"], ids)


SHARED_SQL = """g AS (SELECT n_nationkey, n_regionkey, min('K' || n_nationkey) OVER (PARTITION BY n_regionkey) AS k FROM nation),
i AS (SELECT entity_type, entity_key, CAST(row_number() OVER (ORDER BY o, entity_key) - 1 AS VARCHAR) AS internal_id
  FROM (SELECT DISTINCT 0 AS o, 'gene' AS entity_type, k AS entity_key FROM g UNION ALL SELECT 1, 'protein', 'K' || c_custkey FROM customer)),
kv AS (SELECT DISTINCT 'gene' AS entity_type, internal_id, 'uniprot' AS k, 'R' || n_regionkey AS v FROM g JOIN i ON entity_type = 'gene' AND entity_key = g.k
UNION ALL SELECT 'protein', internal_id, 'uniprot', 'U' || c_custkey FROM customer JOIN i ON entity_type = 'protein' AND entity_key = 'K' || c_custkey
UNION ALL SELECT 'protein', p.internal_id, 'genes_connected', x.internal_id FROM customer JOIN i p ON p.entity_type = 'protein' AND p.entity_key = 'K' || c_custkey
  JOIN g ON n_nationkey = c_nationkey JOIN i x ON x.entity_type = 'gene' AND x.entity_key = g.k)"""


@query("shared_keys", f"WITH {SHARED_SQL} SELECT * FROM kv")
def shared_keys(spark, sf):
    """Resolution, dense ids and fields where entities of different types have the same key."""
    return _shared(spark, sf)


@query(
    "shared_key_nodes",
    f"WITH {SHARED_SQL} SELECT internal_id AS id, CASE entity_type WHEN 'gene' THEN 'Gene' ELSE 'Protein' END AS label FROM kv GROUP BY ALL",
)
def shared_key_nodes(spark, sf):
    return G.property_nodes(_shared(spark, sf)).select("id", "label")


@query(
    "dense_ids",
    """WITH e AS (SELECT 0 AS o, 'gene' AS entity_type, 'G' || n_nationkey AS entity_key FROM nation UNION ALL SELECT 1, 'protein', 'P' || c_custkey FROM customer
  UNION ALL SELECT 2, 'compound', 'C' || p_partkey FROM part UNION ALL SELECT 3, 'reaction', 'R' || o_orderkey FROM orders)
SELECT entity_type, entity_key, CAST(row_number() OVER (ORDER BY o, entity_key) - 1 AS VARCHAR) AS internal_id FROM e""",
)
def dense_ids(spark, sf):
    row = lambda t, kind, p, c: table(spark, sf, t).select(F.lit(kind).alias("entity_type"), key(p, c).alias("entity_key"))
    all_ = row("nation", "gene", "G", "n_nationkey").unionByName(row("customer", "protein", "P", "c_custkey")).unionByName(
        row("part", "compound", "C", "p_partkey")).unionByName(row("orders", "reaction", "R", "o_orderkey"))
    return B.dense_ids(all_)


@query(
    "written_seeds",
    "SELECT DISTINCT '1.1.1.' || s_nationkey AS id, 'enzyme_ec' AS id_type, 'protein' AS entity_type, 'prc' AS mode FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)",
)
def written_seeds(spark, sf):
    """Sample annotations the model lacks, as seeds."""
    known = table(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    new = table(spark, sf, "supplier").join(known, "s_nationkey", "left_anti")
    return B.seed_rows(new.select(key("1.1.1.", "s_nationkey").alias("id"), F.lit("enzyme_ec").alias("id_type")), "protein", "prc")


@query("pending_seeds", "SELECT 'P' || c_custkey AS line FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events WHERE event_type = 'purchase')")
def pending_seeds(spark, sf):
    """Seeds without an entry in the ledger (purchases)."""
    done = table(spark, sf, "events").filter("event_type = 'purchase'").select(key("P", "user_id").alias("line"))
    return B.pending(table(spark, sf, "customer").select(key("P", "c_custkey").alias("line")), done)


@query(
    "property_nodes",
    f"""WITH {KV_SQL} SELECT internal_id AS id, upper(left(min(entity_type), 1)) || substr(min(entity_type), 2) AS label,
  CASE WHEN min(entity_type) = 'reaction' THEN coalesce(CAST(bool_or(k = 'reaction_compounds' AND contains(v, '<=>')) AS VARCHAR), '-') ELSE '-' END AS reversible
FROM kv WHERE internal_id NOT IN (SELECT internal_id FROM kv WHERE entity_type = 'reaction') OR internal_id IN (SELECT internal_id FROM kv WHERE k = 'reaction_compounds') GROUP BY internal_id
UNION ALL SELECT DISTINCT internal_id, 'Reaction', '-' FROM kv WHERE entity_type = 'reaction' AND internal_id NOT IN (SELECT internal_id FROM kv WHERE k = 'reaction_compounds')""",
)
def property_nodes(spark, sf):
    return G.property_nodes(kv(spark, sf)).select("id", "label", F.coalesce(F.col("reversible").cast("string"), F.lit("-")).alias("reversible"))


@query("property_id_nodes", f"WITH {KV_SQL} SELECT DISTINCT CASE k WHEN 'enzyme_ec' THEN 'Enzyme_Ec' ELSE 'Synonyms' END AS label, v AS node_info FROM pkv")
def property_id_nodes(spark, sf):
    return G.property_id_nodes(kv(spark, sf))[0]


RELS_SQL = f"""{KV_SQL},
rels AS (SELECT internal_id AS src, 'CONNECTED_TO' AS rel_type, v AS dst, '-' AS stoichiometry FROM lkv
  UNION ALL SELECT reaction_key, CASE side WHEN 'left' THEN 'IS_SUBSTRATE' ELSE 'IS_PRODUCT' END, compound_key, CAST(stoich AS VARCHAR) FROM participant
    WHERE reaction_key IN (SELECT reaction_key FROM equation))"""


def _graph(spark, sf):
    """Nodes, relations to ids, relations between entities; compounds join as nodes of their own."""
    fields = kv(spark, sf)
    fields = fields.select("entity_type", "internal_id", "k", "v")
    comp = xref_rows(table(spark, sf, "part"), "compound", key("C", "p_partkey"), "part", {"synonyms": F.col("p_name")}).select(
        "entity_type", F.col("entity_key").alias("internal_id"), F.col("id_type").alias("k"), F.col("id_value").alias("v"))
    gene = xref_rows(table(spark, sf, "nation"), "gene", key("G", "n_nationkey"), "nation", {"synonyms": F.col("n_name")}).select(
        "entity_type", F.col("entity_key").alias("internal_id"), F.col("id_type").alias("k"), F.col("id_value").alias("v"))
    # the property graph is a set of stored tables; the extraction queries read those
    fields = cut(fields.unionByName(comp).unionByName(gene))
    nodes, rels = G.property_id_nodes(fields)
    return cut(G.property_nodes(fields)), (nodes, cut(rels)), cut(G.property_rels(fields))


@query("property_rels", f"WITH {RELS_SQL} SELECT * FROM rels")
def property_rels(spark, sf):
    return _graph(spark, sf)[2].drop("pos").na.fill("-", ["stoichiometry"])


@query(
    "without_na_nodes",
    "SELECT 'P' || c_custkey AS src, 'HAS_SYNONYMS' AS rel_type, 'Synonyms:' || c_name AS dst FROM customer WHERE c_mktsegment <> 'BUILDING'",
)
def without_na_nodes(spark, sf):
    """Names of one segment are written NA; these id nodes and their relations go away."""
    name = F.when(F.col("c_mktsegment") == "BUILDING", "NA").otherwise(F.col("c_name"))
    rows = table(spark, sf, "customer").select(F.lit("protein").alias("entity_type"), key("P", "c_custkey").alias("internal_id"), F.lit("synonyms").alias("k"), name.alias("v"))
    return G.drop_na_nodes(*G.property_id_nodes(rows))[1].select("src", "rel_type", "dst")


NETWORK_SQL = f"""{RELS_SQL},
np AS (SELECT 'P' || c_custkey AS id FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier)),
nr AS (SELECT DISTINCT 'R' || o_orderkey AS id FROM orders WHERE 'P' || o_custkey IN (FROM np)),
ng AS (SELECT DISTINCT 'G' || c_nationkey AS id FROM customer WHERE 'P' || c_custkey IN (FROM np)),
nc AS (SELECT DISTINCT dst AS id FROM rels WHERE rel_type LIKE 'IS%' AND src IN (FROM nr)),
net AS (SELECT id, 'Protein' AS label FROM np UNION ALL SELECT id, 'Reaction' FROM nr UNION ALL SELECT id, 'Gene' FROM ng UNION ALL SELECT id, 'Compound' FROM nc)"""


def _annotations(spark, sf):
    return table(spark, sf, "supplier").select(F.lit("enzyme_ec").alias("id_type"), key("1.1.1.", "s_nationkey").alias("id_value"))


@query("network_from_annotations", f"WITH {NETWORK_SQL} SELECT id, label FROM net")
def network_from_annotations(spark, sf):
    nodes, (_, id_rels), rels = _graph(spark, sf)
    return G.network_from_annotations(_annotations(spark, sf), nodes, id_rels, rels)


@query(
    "network_fields",
    f"""WITH {NETWORK_SQL}
SELECT entity_type, internal_id, k, v FROM kv WHERE internal_id IN (SELECT id FROM net) AND (k NOT LIKE '%connected' OR v IN (SELECT id FROM net))
  AND (k NOT IN ('reaction_compounds', 'stoichiometry') OR internal_id IN (SELECT reaction_key FROM equation))
UNION ALL SELECT 'compound', 'C' || p_partkey, 'synonyms', p_name FROM part WHERE 'C' || p_partkey IN (FROM nc)
UNION ALL SELECT 'gene', 'G' || n_nationkey, 'synonyms', n_name FROM nation WHERE 'G' || n_nationkey IN (FROM ng)""",
)
def network_fields(spark, sf):
    """The extracted network back in key/value form, equations rebuilt."""
    nodes, (_, id_rels), rels = _graph(spark, sf)
    chosen = G.network_from_annotations(_annotations(spark, sf), nodes, id_rels, rels)
    return G.rels_to_kv(chosen, id_rels, rels, nodes)


@query(
    "network_sif",
    f"""WITH {NETWORK_SQL} SELECT DISTINCT CASE rel_type WHEN 'IS_SUBSTRATE' THEN dst ELSE src END AS SOURCE,
  CASE rel_type WHEN 'IS_SUBSTRATE' THEN 'cr' WHEN 'IS_PRODUCT' THEN 'rc' ELSE lower(left(src, 1) || left(dst, 1)) END AS INTERACTION,
  CASE rel_type WHEN 'IS_SUBSTRATE' THEN src ELSE dst END AS TARGET FROM rels WHERE src IN (SELECT id FROM net) AND dst IN (SELECT id FROM net)""",
)
def network_sif(spark, sf):
    nodes, (_, id_rels), rels = _graph(spark, sf)
    chosen = G.network_from_annotations(_annotations(spark, sf), nodes, id_rels, rels)
    return G.network_sif(chosen, rels)
