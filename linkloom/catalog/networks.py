"""Queries on networks, model filters, samples and reports.

Finished orders (status F) are the model, open ones (status O) the annotated reactions. Species are named after parts,
with a compartment suffix from the part type.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.catalog.registry import query
from linkloom.catalog.roles import COMPONENTS, edges, key, sides, table, xref_rows
from linkloom.session import cut
from linkloom.operators import network as N
from linkloom.operators import samples as S
from linkloom.sinks.export import sif_organisms

SUFFIX_SQL = "CASE p_type WHEN 'PROMO' THEN '_e' WHEN 'SMALL' THEN '_p' ELSE '_c' END"


def _suffix():
    return F.when(F.col("p_type") == "PROMO", "_e").when(F.col("p_type") == "SMALL", "_p").otherwise("_c")


def _lines(spark, sf, status):
    """Lines of orders of one status as ``(l_orderkey, side, l_partkey)``."""
    o = table(spark, sf, "orders").filter(F.col("o_orderstatus") == status).select(F.col("o_orderkey").alias("l_orderkey"))
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", F.when(F.col("l_linenumber") % 2 == 1, "left").otherwise("right").alias("side"))
    return li.join(o, "l_orderkey").distinct()


def model_participants(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), _suffix().alias("sfx"))
    return _lines(spark, sf, "F").join(p, "l_partkey").select(
        key("R_", "l_orderkey").alias("reaction_key"), "side", F.concat(key("M_", "l_partkey"), "sfx").alias("compound_key"))


def annotated(spark, sf):
    return _lines(spark, sf, "O").select(key("R", "l_orderkey").alias("reaction_key"), "side", key("C", "l_partkey").alias("compound_key"))


def species_map(spark, sf):
    p = table(spark, sf, "part")
    ours = xref_rows(p, "compound", key("C", "p_partkey"), "part", {"kegg": F.col("p_partkey")})
    s = p.filter("p_size <= 25").select(F.concat(key("M_", "p_partkey"), _suffix()).alias("entity_key"), F.lit("kegg").alias("id_type"),
                                        F.col("p_partkey").cast("string").alias("id_value"))
    return N.match_species(ours, s)


def stop(spark, sf):
    """Ubiquitous compounds: two sizes, under their own key and their species key."""
    p = table(spark, sf, "part").filter("p_size in (1, 30)")
    return p.select(F.explode(F.array(key("C", "p_partkey"), F.concat(key("M_", "p_partkey"), _suffix()))).alias("compound_key"))


def base(spark, sf):
    return N.model_network(model_participants(spark, sf))


def grown(spark, sf, only_connected=False):
    return N.expanded_network(base(spark, sf), annotated(spark, sf), species_map(spark, sf), stop(spark, sf), only_connected)


NET = f"""
mp AS (SELECT DISTINCT 'R_' || l_orderkey AS reaction_key, CASE WHEN l_linenumber % 2 = 1 THEN 'left' ELSE 'right' END AS side,
         'M_' || l_partkey || {SUFFIX_SQL} AS compound_key
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F'),
ap AS (SELECT DISTINCT 'RD_R' || l_orderkey AS reaction_key, CASE WHEN l_linenumber % 2 = 1 THEN 'left' ELSE 'right' END AS side,
         CASE WHEN p_size <= 25 THEN 'M_' || l_partkey || {SUFFIX_SQL} ELSE 'C' || l_partkey END AS compound_key, p_size <= 25 AS mapped, p_size
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'O'),
base AS (SELECT DISTINCT CASE side WHEN 'left' THEN compound_key ELSE reaction_key END AS src, CASE side WHEN 'left' THEN reaction_key ELSE compound_key END AS dst FROM mp),
anno AS (SELECT DISTINCT CASE side WHEN 'left' THEN compound_key ELSE reaction_key END AS src, CASE side WHEN 'left' THEN reaction_key ELSE compound_key END AS dst, p_size, reaction_key FROM ap),
grown AS (SELECT src, dst FROM base UNION SELECT src, dst FROM anno WHERE p_size NOT IN (1, 30))"""


@query("base_network", f"WITH {NET} SELECT src, dst FROM base")
def base_network(spark, sf):
    return base(spark, sf)


@query("annotated_network", f"WITH {NET} SELECT src, dst FROM anno")
def annotated_network(spark, sf):
    return N.annotated_network(annotated(spark, sf), species_map(spark, sf))


@query("expanded_network", f"WITH {NET} SELECT src, dst FROM grown")
def expanded_network(spark, sf):
    return grown(spark, sf)[0]


@query(
    "expanded_connected",
    f"""WITH {NET}, touch AS (SELECT reaction_key FROM ap GROUP BY ALL HAVING bool_or(mapped))
SELECT src, dst FROM base UNION SELECT src, dst FROM anno WHERE p_size NOT IN (1, 30) AND reaction_key IN (FROM touch)""",
)
def expanded_connected(spark, sf):
    """Only annotated reactions that touch a mapped compound."""
    return grown(spark, sf, True)[0]


@query("rejected_reactions", f"WITH {NET} SELECT reaction_key FROM ap GROUP BY ALL HAVING NOT bool_or(mapped)")
def rejected_reactions(spark, sf):
    return grown(spark, sf, True)[1]


@query(
    "species_map",
    f"""WITH s AS (SELECT 'M_' || p_partkey || {SUFFIX_SQL} AS species_key, p_name, p_brand FROM part WHERE p_size <= 25)
SELECT min(k) AS compound_key, species_key FROM (
  SELECT species_key, 'C' || p.p_partkey AS k FROM s JOIN part p ON p.p_name = s.p_name AND p.p_size > 25
  UNION ALL SELECT species_key, 'C' || p.p_partkey FROM s JOIN part p ON p.p_brand = s.p_brand AND p.p_size > 25 AND p.p_type = 'SMALL') GROUP BY species_key""",
)
def species_map_query(spark, sf):
    """Species to compounds on a shared name or brand; the smallest compound takes the species."""
    p = table(spark, sf, "part")
    ours = xref_rows(p.filter("p_size > 25"), "compound", key("C", "p_partkey"), "part",
                     {"name": F.col("p_name"), "brand": F.when(F.col("p_type") == "SMALL", F.col("p_brand"))})
    s = xref_rows(p.filter("p_size <= 25"), "species", F.concat(key("M_", "p_partkey"), _suffix()), "part", {"name": F.col("p_name"), "brand": F.col("p_brand")})
    return N.match_species(ours, s)


DEAD = """
{name} AS (SELECT node, CASE WHEN bool_or(made) THEN 'produced' ELSE 'consumed' END AS role FROM (
    SELECT dst AS node, true AS made FROM {net} WHERE src LIKE 'R\\_%' ESCAPE '\\' OR src LIKE 'RD\\_%' ESCAPE '\\'
    UNION ALL SELECT src, false FROM {net} WHERE dst LIKE 'R\\_%' ESCAPE '\\' OR dst LIKE 'RD\\_%' ESCAPE '\\')
  WHERE NOT ends_with(node, '_e') GROUP BY node HAVING count(DISTINCT made) = 1)"""


@query("dead_ends", f"WITH {NET}, {DEAD.format(name='d', net='grown')} SELECT node, role FROM d")
def dead_ends(spark, sf):
    return N.dead_ends(grown(spark, sf)[0])


@query(
    "dead_end_diff",
    f"""WITH {NET}, {DEAD.format(name='d1', net='base')}, {DEAD.format(name='d2', net='grown')},
c AS (SELECT (SELECT count(*) FROM d1) AS d1, (SELECT count(*) FROM d2) AS d2, (SELECT count(*) FROM d1 WHERE node NOT IN (SELECT node FROM d2)) AS fixed,
  (SELECT count(*) FROM (SELECT src FROM base UNION SELECT dst FROM base)) AS n1, (SELECT count(*) FROM (SELECT src FROM grown UNION SELECT dst FROM grown)) AS n2)
SELECT d1 AS base_dead_ends, round(100 * d1 / n1, 3) AS base_pct, d2 AS expanded_dead_ends, round(100 * d2 / n2, 3) AS expanded_pct,
  fixed AS newly_connected, round(100 * fixed / n1, 3) AS newly_connected_pct FROM c""",
)
def dead_end_diff(spark, sf):
    return N.compare_dead_ends(base(spark, sf), grown(spark, sf)[0])


@query(
    "metabolite_count",
    f"""WITH {NET} SELECT count(*) AS n_metabolites FROM (SELECT src AS n FROM grown UNION SELECT dst FROM grown)
WHERE NOT (n LIKE 'R\\_%' ESCAPE '\\' OR n LIKE 'RD\\_%' ESCAPE '\\' OR ends_with(n, '_e'))""",
)
def metabolite_count(spark, sf):
    return N.n_metabolites(grown(spark, sf)[0])


# the full link set: every line, in one giant component with long chains and hubs
FULL = """
links AS (SELECT 'R_' || l_orderkey AS a, 'M_' || l_partkey || '_c' AS b FROM lineitem)"""


def full_net(spark, sf):
    return table(spark, sf, "lineitem").select(key("R_", "l_orderkey").alias("src"), F.concat(key("M_", "l_partkey"), F.lit("_c")).alias("dst"))


@query("components", f"WITH RECURSIVE {FULL}, {COMPONENTS} SELECT node, component FROM cc")
def components(spark, sf):
    """Components over every line."""
    return N.connected_components(full_net(spark, sf))


@query("components_dense", f"WITH RECURSIVE {NET}, links AS (SELECT src AS a, dst AS b FROM grown), {COMPONENTS} SELECT node, component FROM cc")
def components_dense(spark, sf):
    """Components of the expanded network: one giant component and some leftovers."""
    return N.connected_components(grown(spark, sf)[0])


SIZES = "sizes AS (SELECT component, count(*) FILTER (node NOT LIKE 'R%') AS n_compounds, count(*) FILTER (node LIKE 'R%') AS n_reactions FROM cc GROUP BY component)"


@query(
    "component_histogram",
    f"""WITH RECURSIVE {FULL}, {COMPONENTS}, {SIZES} SELECT 'compounds' AS kind, n_compounds AS size, count(*) AS n_components FROM sizes GROUP BY ALL
UNION ALL SELECT 'reactions', n_reactions, count(*) FROM sizes GROUP BY ALL""",
)
def component_histogram(spark, sf):
    return N.size_histogram(N.component_sizes(full_net(spark, sf)))


@query("components_all_lines", f"WITH RECURSIVE {FULL}, {COMPONENTS} SELECT node, component FROM cc")
def components_all_lines(spark, sf):
    return N.connected_components(full_net(spark, sf))


@query(
    "component_histogram_all_lines",
    f"""WITH RECURSIVE {FULL}, {COMPONENTS}, {SIZES} SELECT 'compounds' AS kind, n_compounds AS size, count(*) AS n_components FROM sizes GROUP BY ALL
UNION ALL SELECT 'reactions', n_reactions, count(*) FROM sizes GROUP BY ALL""",
)
def component_histogram_all_lines(spark, sf):
    return N.size_histogram(N.component_sizes(full_net(spark, sf)))


@query(
    "network_report",
    f"""WITH RECURSIVE {NET}, links AS (SELECT src AS a, dst AS b FROM grown), {COMPONENTS}, {SIZES}
SELECT * FROM (SELECT count(*) AS n_components, CAST(sum(n_reactions) AS BIGINT) AS n_reactions, round(100 * max(n_reactions) / sum(n_reactions), 3) AS pct_reactions_largest FROM sizes),
(SELECT count(*) FILTER (ends_with(node, '_c')) AS n_c, count(*) FILTER (ends_with(node, '_e')) AS n_e, count(*) FILTER (ends_with(node, '_p')) AS n_p FROM cc)""",
)
def network_report(spark, sf):
    return N.network_report(grown(spark, sf)[0])


SAME = """
bl AS (SELECT DISTINCT l_orderkey AS o, o_orderstatus AS st, CASE WHEN l_linenumber % 2 = 1 THEN 'left' ELSE 'right' END AS side, p_brand AS b
       FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
bs AS (SELECT o, st, string_agg(b, ',' ORDER BY b) FILTER (side = 'left') AS l, string_agg(b, ',' ORDER BY b) FILTER (side = 'right') AS r,
         bool_and(b <> 'Brand#5') AS mapped FROM bl GROUP BY ALL HAVING l IS NOT NULL AND r IS NOT NULL),
same AS (SELECT 'R' || x.o AS reaction_key, min('R_' || y.o) AS model_reaction FROM bs x JOIN bs y ON y.st = 'F' AND ((x.l = y.l AND x.r = y.r) OR (x.l = y.r AND x.r = y.l))
         WHERE x.st = 'O' AND x.mapped GROUP BY ALL)"""


def _same_inputs(spark, sf):
    """Reactions over brands, so that equal reactions exist; one brand has no species."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    ours = _lines(spark, sf, "O").join(p, "l_partkey").select(key("R", "l_orderkey").alias("reaction_key"), "side", F.col("p_brand").alias("compound_key"))
    model = _lines(spark, sf, "F").join(p, "l_partkey").select(key("R_", "l_orderkey").alias("reaction_key"), "side", F.concat(F.lit("M_"), "p_brand").alias("compound_key"))
    m = p.filter("p_brand <> 'Brand#5'").select(F.col("p_brand").alias("compound_key"), F.concat(F.lit("M_"), "p_brand").alias("species_key")).distinct()
    return ours, m, model


@query("same_reaction", f"WITH {SAME} SELECT * FROM same")
def same_reaction(spark, sf):
    return N.same_reaction(*_same_inputs(spark, sf))


@query("new_by_participants", f"WITH {SAME} SELECT 'R' || o_orderkey AS reaction_key FROM orders WHERE o_orderstatus = 'O' AND 'R' || o_orderkey NOT IN (SELECT reaction_key FROM same)")
def new_by_participants(spark, sf):
    ours, m, model = _same_inputs(spark, sf)
    r = table(spark, sf, "orders").filter("o_orderstatus = 'O'").select(key("R", "o_orderkey").alias("reaction_key"))
    return N.reactions_not_in_model_by_participants(r, ours, m, model)


FILTERS = """
pid AS (SELECT 'P' || c_custkey AS protein_key, '1.1.1.' || c_nationkey AS ec, c_custkey, c_nationkey FROM customer WHERE c_mktsegment <> 'FURNITURE'
        UNION ALL SELECT 'P' || c_custkey, NULL, c_custkey, c_nationkey FROM customer WHERE c_mktsegment = 'FURNITURE'),
ann AS (SELECT 'S' || s_suppkey AS sample, '1.1.1.' || s_nationkey AS ec FROM supplier 
        UNION SELECT 'S' || s_suppkey, 'M' || s_suppkey FROM supplier),
h1 AS (SELECT DISTINCT sample, protein_key, c_custkey, p.ec FROM ann JOIN pid p ON ann.ec = p.ec
       UNION SELECT DISTINCT sample, protein_key, c_custkey, p.ec FROM ann JOIN pid p ON ann.ec = 'M' || c_custkey),
h2 AS (SELECT * FROM h1 WHERE c_custkey IN (SELECT o_custkey FROM orders)),
h3 AS (SELECT * FROM h2 WHERE ec IS NOT NULL AND ec NOT IN (SELECT '1.1.1.' || n_nationkey FROM nation WHERE n_regionkey = 1)),
h4 AS (SELECT DISTINCT 'R' || o_orderkey AS reaction_key, o_orderkey, o_orderpriority, o_custkey FROM h3 JOIN orders ON o_custkey = c_custkey),
h5 AS (SELECT reaction_key FROM h4 WHERE o_orderpriority <> '5-LOW' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'))"""


def _stages(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    ec = F.when(F.col("c_mktsegment") != "FURNITURE", key("1.1.1.", "c_nationkey"))
    ids = xref_rows(c, "protein", key("P", "c_custkey"), "customer", {"enzyme_ec": ec, "metacyc": key("M", "c_custkey")}).withColumnRenamed("entity_key", "protein_key")
    s = table(spark, sf, "supplier")
    row = lambda df, t, v: df.select(key("S", "s_suppkey").alias("sample"), F.lit(t).alias("id_type"), v.alias("id_value"))
    ann = row(s, "enzyme_ec", key("1.1.1.", "s_nationkey")).unionByName(row(s, "metacyc", key("M", "s_suppkey")))
    e = edges(spark, sf)
    known = table(spark, sf, "nation").filter("n_regionkey = 1").select(F.lit("enzyme_ec").alias("id_type"), key("1.1.1.", "n_nationkey").alias("id_value"))
    # pairs of samples and proteins stay folded into sets: their number is that of samples times proteins
    h1 = N.proteins_in_sample(ids, ann, expand=False)
    h2 = N.with_reaction(h1, e)
    h3 = N.proteins_not_in_model(h2, ids, known)
    # counted and built upon: written once
    h4 = cut(N.reactions_of(h3, e))
    rid = o.filter("o_orderpriority <> '5-LOW'").select(key("R", "o_orderkey").alias("reaction_key"), F.lit("kegg").alias("id_type"), F.col("o_custkey").cast("string").alias("id_value"))
    model = o.filter("o_orderstatus = 'F' and o_orderpriority = '1-URGENT'").select(F.lit("kegg").alias("id_type"), F.col("o_custkey").cast("string").alias("id_value"))
    h5 = N.reactions_not_in_model_by_id(rid.join(h4, "reaction_key", "left_semi"), model)
    return {"in_sample": h1, "with_reaction": h2, "not_in_model": h3, "reactions": h4, "new_by_id": h5}


@query("model_filters", f"WITH {FILTERS} SELECT sample, protein_key FROM h3")
def model_filters(spark, sf):
    """Sample proteins with a reaction whose enzyme number the model lacks."""
    return _stages(spark, sf)["not_in_model"].rows("sample", "protein_key")


@query("new_reactions", f"WITH {FILTERS} SELECT DISTINCT reaction_key FROM h5")
def new_reactions(spark, sf):
    return _stages(spark, sf)["new_by_id"]


@query(
    "funnel",
    f"""WITH {FILTERS} SELECT 0 AS pos, 'in_sample' AS stage, count(*) AS n FROM (SELECT DISTINCT sample, protein_key FROM h1)
UNION ALL SELECT 1, 'with_reaction', count(*) FROM (SELECT DISTINCT sample, protein_key FROM h2) UNION ALL SELECT 2, 'not_in_model', count(*) FROM (SELECT DISTINCT sample, protein_key FROM h3)
UNION ALL SELECT 3, 'reactions', count(*) FROM h4 UNION ALL SELECT 4, 'new_by_id', count(DISTINCT reaction_key) FROM h5""",
)
def funnel(spark, sf):
    return N.funnel(_stages(spark, sf))


@query(
    "sif_expansion",
    f"""WITH {NET} SELECT src AS SOURCE, CASE WHEN src LIKE 'R%' THEN 'rc' ELSE 'cr' END AS INTERACTION, dst AS TARGET,
CASE WHEN (src, dst) IN (SELECT (src, dst) FROM base) THEN 0 ELSE 1 END AS EXPANSION FROM grown""",
)
def sif_expansion(spark, sf):
    return N.sif_expansion(base(spark, sf), grown(spark, sf)[0])


@query(
    "top_participants",
    """SELECT 'C' || l_partkey AS compound_key, p_name AS name, n FROM (
SELECT l_partkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey, l_linenumber % 2 FROM lineitem) GROUP BY l_partkey ORDER BY n DESC, 'C' || l_partkey LIMIT 100) JOIN part ON l_partkey = p_partkey""",
)
def top_participants(spark, sf):
    names = table(spark, sf, "part").select(key("C", "p_partkey").alias("compound_key"), F.col("p_name").alias("name"))
    return S.top_participants(sides(spark, sf), names, 100)


SAMPLE_SQL = """
ann AS (SELECT 'S' || s_suppkey AS sample, 'enzyme_ec' AS id_type, '1.1.1.' || s_nationkey AS id_value FROM supplier
        UNION ALL SELECT 'S' || s_suppkey, 'metacyc', 'SEG' || s_suppkey % 7 FROM supplier),
pa AS (SELECT 'P' || c_custkey AS protein_key, 'enzyme_ec' AS id_type, '1.1.1.' || c_nationkey AS id_value FROM customer
       UNION ALL SELECT 'P' || c_custkey, 'metacyc', 'SEG' || c_custkey % 50 FROM customer),
met AS (SELECT DISTINCT upper(p_name) AS metabolite FROM part UNION SELECT 'unknown ' || r_name FROM region),
mapping AS (SELECT metabolite, 'C' || p_partkey AS compound_key FROM met JOIN part ON lower(metabolite) = p_name),
linked AS (SELECT DISTINCT 'R' || l_orderkey AS reaction_key, 'C' || l_partkey AS compound_key FROM lineitem WHERE 'C' || l_partkey IN (SELECT compound_key FROM mapping)),
rp AS (SELECT 'R' || o_orderkey AS reaction_key, 'P' || o_custkey AS protein_key FROM orders WHERE 'R' || o_orderkey IN (SELECT reaction_key FROM linked)),
sp AS (SELECT DISTINCT sample, protein_key FROM ann JOIN pa USING (id_type, id_value) WHERE protein_key IN (SELECT protein_key FROM rp)),
om AS (SELECT sample, metabolite, count(DISTINCT (reaction_key, compound_key)) AS n FROM sp JOIN rp USING (protein_key) JOIN linked USING (reaction_key) JOIN mapping USING (compound_key) GROUP BY ALL)"""


def _sample_frames(spark, sf):
    s, c, p = table(spark, sf, "supplier"), table(spark, sf, "customer"), table(spark, sf, "part")
    ann = xref_rows(s, "sample", key("S", "s_suppkey"), "supplier", {"enzyme_ec": key("1.1.1.", "s_nationkey"), "metacyc": key("SEG", F.col("s_suppkey") % 7)}).withColumnRenamed("entity_key", "sample")
    pid = xref_rows(c, "protein", key("P", "c_custkey"), "customer", {"enzyme_ec": key("1.1.1.", "c_nationkey"), "metacyc": key("SEG", F.col("c_custkey") % 50)}).withColumnRenamed("entity_key", "protein_key")
    wanted = p.select(F.upper("p_name").alias("id")).distinct().unionByName(
        table(spark, sf, "region").select(F.concat(F.lit("unknown "), "r_name").alias("id")))
    x = xref_rows(p, "compound", key("C", "p_partkey"), "part", {"synonyms": F.col("p_name")})
    mapping, unmapped = S.map_metabolites(wanted, x)
    linked = S.reactions_with(mapping, sides(spark, sf))
    e = edges(spark, sf).filter("edge_type = 'rp'")
    rp, lonely = S.proteins_of(linked, e)
    pa = S.annotations_of(rp, pid)
    return {"ann": ann, "mapping": mapping, "unmapped": unmapped, "linked": linked, "rp": rp, "lonely": lonely, "pa": pa}


@query("map_metabolites", f"WITH {SAMPLE_SQL} SELECT metabolite, compound_key FROM mapping")
def map_metabolites(spark, sf):
    return _sample_frames(spark, sf)["mapping"]


@query("unmapped_metabolites", f"WITH {SAMPLE_SQL} SELECT metabolite FROM met WHERE metabolite NOT IN (SELECT metabolite FROM mapping)")
def unmapped_metabolites(spark, sf):
    return _sample_frames(spark, sf)["unmapped"]


@query("linked_reactions", f"WITH {SAMPLE_SQL} SELECT reaction_key, protein_key, (SELECT count(*) FROM linked l WHERE l.reaction_key = rp.reaction_key) AS n_compounds FROM rp")
def linked_reactions(spark, sf):
    f = _sample_frames(spark, sf)
    return f["rp"].join(f["linked"].groupBy("reaction_key").agg(F.count("*").alias("n_compounds")), "reaction_key")


@query("unconnected_reactions", f"WITH {SAMPLE_SQL} SELECT DISTINCT reaction_key FROM linked WHERE reaction_key NOT IN (SELECT reaction_key FROM rp JOIN customer ON protein_key = 'P' || c_custkey WHERE c_mktsegment <> 'BUILDING')")
def unconnected_reactions(spark, sf):
    """Linked reactions left without a protein once one segment's links are gone."""
    c = table(spark, sf, "customer").filter("c_mktsegment = 'BUILDING'").select(key("P", "c_custkey").alias("dst_key"))
    e = edges(spark, sf).filter("edge_type = 'rp'").join(c, "dst_key", "left_anti")
    return S.proteins_of(_sample_frames(spark, sf)["linked"], e)[1]


@query("protein_annotations", f"WITH {SAMPLE_SQL} SELECT DISTINCT protein_key, id_type, id_value FROM pa WHERE protein_key IN (SELECT protein_key FROM rp)")
def protein_annotations(spark, sf):
    return _sample_frames(spark, sf)["pa"]


@query("organism_proteins", f"WITH {SAMPLE_SQL} SELECT sample, protein_key FROM sp")
def organism_proteins(spark, sf):
    f = _sample_frames(spark, sf)
    return S.organism_proteins(f["pa"], f["ann"])


@query("organism_metabolites", f"WITH {SAMPLE_SQL} SELECT * FROM om")
def organism_metabolites(spark, sf):
    f = _sample_frames(spark, sf)
    return S.organism_metabolites(f["pa"], f["ann"], f["rp"], f["linked"], f["mapping"])


NAMES = [f"{colour} {thing}" for colour in ("BLUE", "COLD", "HOT", "LARGE", "NEW", "OLD", "RED", "SMALL")
         for thing in ("ANVIL", "BOLT", "GEAR", "GIZMO", "PLATE", "RING", "ROD", "WIDGET")]


@query(
    "report_matrix",
    f"WITH {SAMPLE_SQL} SELECT sample, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (metabolite = '{m}'), 0) AS BIGINT) AS \"{m}\"" for m in NAMES) + " FROM om GROUP BY sample",
)
def report_matrix(spark, sf):
    f = _sample_frames(spark, sf)
    return S.report_matrix(S.organism_metabolites(f["pa"], f["ann"], f["rp"], f["linked"], f["mapping"]), NAMES)


@query("map_metabolites_all_names", f"WITH {SAMPLE_SQL} SELECT metabolite, compound_key FROM mapping")
def map_metabolites_all_names(spark, sf):
    return _sample_frames(spark, sf)["mapping"]


@query("linked_reactions_all_names", f"WITH {SAMPLE_SQL} SELECT reaction_key, protein_key, (SELECT count(*) FROM linked l WHERE l.reaction_key = rp.reaction_key) AS n_compounds FROM rp")
def linked_reactions_all_names(spark, sf):
    f = _sample_frames(spark, sf)
    return f["rp"].join(f["linked"].groupBy("reaction_key").agg(F.count("*").alias("n_compounds")), "reaction_key")


@query("organism_proteins_all_names", f"WITH {SAMPLE_SQL} SELECT sample, protein_key FROM sp")
def organism_proteins_all_names(spark, sf):
    f = _sample_frames(spark, sf)
    return S.organism_proteins(f["pa"], f["ann"])


@query(
    "report_long_all_names",
    f"""WITH {SAMPLE_SQL} SELECT sample, metabolite, coalesce(om.n, 0) AS n
FROM (SELECT DISTINCT sample FROM om) CROSS JOIN (SELECT unnest({NAMES}) AS metabolite) LEFT JOIN om USING (sample, metabolite)""",
)
def report_long_all_names(spark, sf):
    """Every metabolite, with zeros."""
    f = _sample_frames(spark, sf)
    return S.report_long(S.organism_metabolites(f["pa"], f["ann"], f["rp"], f["linked"], f["mapping"]), NAMES)


@query(
    "sif_organisms",
    f"""WITH {SAMPLE_SQL} SELECT compound_key AS SOURCE, 'cr' AS INTERACTION, reaction_key AS TARGET FROM linked
UNION ALL SELECT DISTINCT reaction_key, 'rp', protein_key FROM rp UNION ALL SELECT protein_key, 'ps', sample FROM sp""",
)
def sif_organisms_query(spark, sf):
    f = _sample_frames(spark, sf)
    return sif_organisms(f["linked"], f["rp"], S.organism_proteins(f["pa"], f["ann"], expand=False))


UNSEEN_SQL = f"""WITH {SAMPLE_SQL}, model AS (SELECT 'S' || s_suppkey AS sample, '1.1.1.' || n_nationkey AS id_value FROM supplier JOIN nation ON n_regionkey = s_suppkey % 5),
un AS (SELECT DISTINCT sample, id_type, id_value FROM ann WHERE NOT (id_type = 'enzyme_ec' AND (sample, id_value) IN (SELECT (sample, id_value) FROM model)))"""


def _unseen(spark, sf):
    m = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("n_regionkey") == F.col("s_suppkey") % 5).select(
        key("S", "s_suppkey").alias("sample"), F.lit("enzyme_ec").alias("id_type"), key("1.1.1.", "n_nationkey").alias("id_value"))
    return S.unseen_annotations(_sample_frames(spark, sf)["ann"], m)


@query("unseen_annotations", UNSEEN_SQL + " SELECT sample, id_type, id_value FROM un")
def unseen_annotations(spark, sf):
    """Annotations of a sample that its own model lacks."""
    return _unseen(spark, sf)


@query("unseen_counts", UNSEEN_SQL + " SELECT sample, id_type, count(*) AS n FROM un GROUP BY ALL")
def unseen_counts(spark, sf):
    return S.unseen_counts(_unseen(spark, sf))


@query(
    "annotation_sharing",
    """SELECT count(*) FILTER (k = 1) AS n_unique, count(*) FILTER (k > 1) AS n_shared
FROM (SELECT floor(s_acctbal / 10) AS v, count(DISTINCT s_suppkey) AS k FROM supplier GROUP BY ALL)""",
)
def annotation_sharing(spark, sf):
    a = table(spark, sf, "supplier").select(key("S", "s_suppkey").alias("sample"), F.lit("metacyc").alias("id_type"),
                                            F.floor(F.col("s_acctbal") / 10).cast("string").alias("id_value"))
    return S.annotation_sharing(a)


@query(
    "id_sets",
    """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders), b AS (SELECT DISTINCT user_id AS k FROM events)
SELECT 'user' AS id_type, CAST(coalesce(a.k, b.k) AS VARCHAR) AS id_value, CASE WHEN a.k IS NULL THEN 'right' WHEN b.k IS NULL THEN 'left' ELSE 'both' END AS side FROM a FULL JOIN b ON a.k = b.k""",
)
def id_sets(spark, sf):
    row = lambda t, c: table(spark, sf, t).select(F.lit("user").alias("id_type"), F.col(c).cast("string").alias("id_value"))
    return S.id_sets(row("orders", "o_custkey"), row("events", "user_id"))


_KINDS = ["enzyme_ec", "kegg", "rhea", "metacyc", "reactome"]


@query(
    "model_report",
    """WITH r AS (SELECT 'N' || c_nationkey AS model, o_orderkey, o_orderstatus = 'F' AS enzyme_ec, o_orderpriority = '1-URGENT' AS kegg, o_orderpriority = '2-HIGH' AS rhea,
  o_orderpriority = '3-MEDIUM' AS metacyc, o_orderkey % 2 = 0 AS reactome FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT model, count(*) AS n_reactions, """ + ", ".join(f"count(*) FILTER ({k}) AS n_{k}, round(100 * count(*) FILTER ({k}) / count(*), 3) AS pct_{k}" for k in _KINDS) + """,
count(*) FILTER (reactome AND NOT (enzyme_ec OR kegg OR rhea OR metacyc)) AS n_only_reactome FROM r WHERE enzyme_ec OR kegg OR rhea OR metacyc OR reactome GROUP BY model""",
)
def model_report(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pri = F.col("o_orderpriority")
    flags = {"enzyme_ec": F.col("o_orderstatus") == "F", "kegg": pri == "1-URGENT", "rhea": pri == "2-HIGH", "metacyc": pri == "3-MEDIUM", "reactome": F.col("o_orderkey") % 2 == 0}
    types = F.filter(F.array(*[F.when(v, F.lit(k)) for k, v in flags.items()]), lambda x: x.isNotNull())
    return S.model_report(o.select(key("N", "c_nationkey").alias("model"), key("R", "o_orderkey").alias("reaction_key"), F.explode(types).alias("id_type")))


@query(
    "universal_seeds",
    """SELECT DISTINCT * FROM (SELECT 'R' || o_orderkey AS id, 'rhea' AS id_type, 'reaction' AS entity_type, 'crp' AS mode FROM orders
UNION ALL SELECT 'P' || c_custkey, 'metacyc', 'protein', 'prc' FROM customer UNION ALL SELECT '1.1.1.' || c_nationkey, 'enzyme_ec', 'protein', 'prc' FROM customer
UNION ALL SELECT 'K' || p_size, 'kegg_ko', 'protein', 'prc' FROM part)""",
)
def universal_seeds(spark, sf):
    c = table(spark, sf, "customer")
    r = table(spark, sf, "orders").select(key("R", "o_orderkey").alias("id"), F.lit("rhea").alias("id_type"))
    p = c.select(key("P", "c_custkey").alias("id"), F.lit("metacyc").alias("id_type"))
    return S.universal_seeds(r, p, c.select(key("1.1.1.", "c_nationkey").alias("id")), table(spark, sf, "part").select(key("K", "p_size").alias("id")))


@query("universal_seeds_ko", "SELECT DISTINCT 'K' || p_size AS id, 'kegg_ko' AS id_type, 'protein' AS entity_type, 'prc' AS mode FROM part")
def universal_seeds_ko(spark, sf):
    return S.universal_seeds(None, None, None, table(spark, sf, "part").select(key("K", "p_size").alias("id")), ko_only=True)
