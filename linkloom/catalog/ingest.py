"""Queries on sources: the given tables are written out in each source format inside Spark and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.catalog.registry import query
from linkloom.catalog.roles import EQUATION, PARTICIPANT, equation_parts, key, participants, sides, table
from linkloom.functions.arrays import spread
from linkloom.functions.equations import format_equation
from linkloom.session import scratch
from linkloom.sinks.export import read_ledger
from linkloom.sources import annotations as A
from linkloom.sources import models as MD
from linkloom.sources import pages as P
from linkloom.sources import records as R
from linkloom.sources import seeds as S
from linkloom.sources import tables as T
from linkloom.streaming.ledger import follow_seeds

s = lambda c: F.col(c).cast("string")
cat = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
line = lambda *xs: F.concat_ws("\t", *[F.lit(x) if isinstance(x, str) else x for x in xs])


# seeds and small lists


def seed_lines(spark, sf):
    """One seed line per customer; some have an unknown mode or type, some only three fields."""
    c = table(spark, sf, "customer")
    mode = F.when(F.col("c_nationkey") == 3, "PRC,gp").when(F.col("c_nationkey") == 4, "up").otherwise("crp")
    kind = F.when(F.col("c_nationkey") == 5, "Enzyme").otherwise("Protein")
    full = line(key("P", "c_custkey"), F.when(F.col("c_mktsegment") == "BUILDING", "syn").otherwise("kegg"), kind, mode, F.lower("c_mktsegment"))
    short = line(key("P", "c_custkey"), "kegg", kind)
    return c.select(F.when(F.col("c_mktsegment") == "FURNITURE", short).otherwise(full).alias("value"))


SEED_SQL = """
seed AS (SELECT 'P' || c_custkey AS id, CASE WHEN c_mktsegment = 'BUILDING' THEN 'synonyms' ELSE 'kegg' END AS id_type,
  CASE WHEN c_nationkey = 5 THEN 'enzyme' ELSE 'protein' END AS entity_type,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN '' WHEN c_nationkey = 3 THEN 'prc,gp' WHEN c_nationkey = 4 THEN 'up' ELSE 'crp' END AS modes,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN '' ELSE lower(c_mktsegment) END AS organisms FROM customer),
bad AS (SELECT *, CASE WHEN entity_type = 'enzyme' THEN 'unknown entity type' WHEN modes = 'up' THEN 'unknown search mode' END AS reason FROM seed)"""


@query("seed_list", f"WITH {SEED_SQL} SELECT * FROM seed")
def seed_list(spark, sf):
    got = S.parse_seeds(seed_lines(spark, sf))
    return got.select("id", "id_type", "entity_type", F.array_join("modes", ",").alias("modes"), F.array_join("organisms", ",").alias("organisms"))


@query("seeds_over_time", "SELECT 'P' || user_id AS id, event_type AS entity_type, 1::BIGINT AS n, 1::BIGINT AS n_logged FROM events WHERE user_id IS NOT NULL GROUP BY ALL")
def seeds_over_time(spark, sf):
    """Every event names a seed. They arrive in three folders of files; the stream is started anew, from its checkpoint, after each."""
    e = table(spark, sf, "events").filter("user_id is not null")
    arrivals = e.select(line(key("P", "user_id"), "kegg", F.coalesce("event_type", F.lit(""))).alias("value"), F.pmod(F.xxhash64("event_id"), F.lit(3)).alias("part"))
    base = scratch(spark, "seeds")
    for part in range(3):
        arrivals.filter(F.col("part") == part).select("value").write.mode("append").text(f"{base}/in")
        follow_seeds(spark, f"{base}/in", f"{base}/ledger", f"{base}/stream", lambda df: df.select("id", "entity_type", "line").write.mode("append").parquet(f"{base}/done")).awaitTermination()
    done = spark.read.schema("id string, entity_type string, line string").parquet(f"{base}/done").groupBy("id", "entity_type", "line").agg(F.count("*").alias("n"))
    logged = read_ledger(spark, f"{base}/ledger").groupBy("line").agg(F.count("*").alias("n_logged"))
    return done.join(logged, "line", "full").select("id", "entity_type", "n", "n_logged")


@query("seed_validation", f"WITH {SEED_SQL} SELECT id, coalesce(reason, 'ok') AS reason FROM bad")
def seed_validation(spark, sf):
    ok, bad = S.validate_seeds(S.parse_seeds(seed_lines(spark, sf)))
    return ok.select("id", F.lit("ok").alias("reason")).unionByName(bad.select("id", "reason"))


@query(
    "seed_states",
    """SELECT CASE WHEN c_mktsegment = 'FURNITURE' THEN '' WHEN c_nationkey = 3 THEN 'gp,prc' ELSE 'crp' END AS mode_key, 'protein' AS node_type, 'P' || c_custkey AS node_key
FROM customer WHERE c_nationkey NOT IN (4, 5) AND c_mktsegment <> 'BUILDING' OR c_mktsegment = 'FURNITURE' AND c_nationkey = 4""",
)
def seed_states(spark, sf):
    """Valid seeds that meet a known id, with the key of their mode set."""
    ok, _ = S.validate_seeds(S.parse_seeds(seed_lines(spark, sf)))
    x = table(spark, sf, "customer").select(
        F.lit("protein").alias("entity_type"), key("P", "c_custkey").alias("entity_key"), F.lit("kegg").alias("id_type"), key("P", "c_custkey").alias("id_value"))
    return S.seed_states(ok, x)


@query("stoplist", "SELECT DISTINCT 'brand' AS id_type, lower(p_brand) AS id_value FROM part")
def stoplist(spark, sf):
    return S.parse_stoplist(table(spark, sf, "part").select(line(F.rpad("p_brand", 30, " "), "brand").alias("value")))


@query("metabolite_list", "SELECT DISTINCT p_name AS id, 'synonyms' AS id_type FROM part")
def metabolite_list(spark, sf):
    return S.parse_metabolites(table(spark, sf, "part").select(line(F.col("p_name"), "synonyms").alias("value")))


@query("link_dump", "SELECT CAST(o_custkey AS VARCHAR) AS id, CAST(o_orderkey AS VARCHAR) AS linked_id FROM orders")
def link_dump(spark, sf):
    return S.parse_link_dump(table(spark, sf, "orders").select(line(key("cust:", "o_custkey"), key("ord:", "o_orderkey")).alias("value")))


@query("find_dump", "SELECT upper(b.p_name) AS query, 'C' || a.p_partkey AS id FROM part a JOIN (SELECT DISTINCT p_name FROM part WHERE p_size = 7) b ON a.p_name = b.p_name")
def find_dump(spark, sf):
    """Names found, whatever their case, in a dump that lists several names per id."""
    p = table(spark, sf, "part")
    dump = S.parse_find_dump(p.select(line(key("cpd:C", "p_partkey"), F.concat_ws("; ", "p_brand", "p_name")).alias("value")))
    return S.find_by_name(p.filter("p_size = 7").select(F.upper("p_name").alias("name")), dump)


@query("gene_links", "SELECT n_name AS gene, 'U' || n_regionkey AS uniprot FROM nation WHERE n_regionkey <> 2 AND n_regionkey <> 3")
def gene_links(spark, sf):
    v = F.when(F.col("n_regionkey") == 2, line(F.col("n_name"), "")).otherwise(line(F.col("n_name"), key("U", "n_regionkey"), "more"))
    return S.parse_links(table(spark, sf, "nation").select(F.when(F.col("n_regionkey") == 3, cat("# ", v)).otherwise(v).alias("value")))


# record files


def _record(*lines):
    return F.concat_ws("\n", *lines, F.lit("//\n"))


def compound_records(spark, sf):
    k = s("p_partkey")
    return table(spark, sf, "part").select(_record(
        key("CPD-", "p_partkey"), cat("TYPES - ", F.col("p_type")), cat("COMMON-NAME - <i>", F.col("p_name"), "</i> &alpha;"),
        cat("SYNONYMS - ", F.col("p_brand")), cat("CHEMICAL-FORMULA - (C ", s("p_size"), ")"), cat("CHEMICAL-FORMULA - (H ", k, ")"),
        cat("INCHI-KEY - InChIKey=K", k), cat('DBLINKS - (CHEBI "', k, '" NIL |x| 3 NIL NIL)'), cat('DBLINKS - (NOSUCH "', k, '" NIL)'),
        cat('DBLINKS - (LIGAND-CPD "C', k, '" NIL)')).alias("record"))


@query(
    "compound_records",
    """SELECT 'compound' AS entity_type, 'CPD-' || p_partkey AS entity_key, 'metacyc' AS source_db, CAST(1 AS BIGINT) AS n,
  unnest(['metacyc', 'synonyms', 'synonyms', 'chemical_formula', 'inchi_key', 'chebi', 'kegg']) AS id_type,
  unnest(['CPD-' || p_partkey, p_name || ' α', p_brand, 'C' || p_size || 'H' || p_partkey, 'K' || p_partkey, CAST(p_partkey AS VARCHAR), 'C' || p_partkey]) AS id_value FROM part""",
)
def compound_records_query(spark, sf):
    return R.records_to_xref(compound_records(spark, sf), "compound")


@query(
    "gene_records",
    """SELECT 'G-' || n_nationkey AS entity_key, unnest(['metacyc', 'metacyc', 'synonyms', 'protein_ids', 'uniprot', 'ncbi_genbank_gene']) AS id_type,
  unnest(['G-' || n_nationkey, 'ACC-' || n_nationkey, n_name, 'MONOMER-' || n_nationkey, 'U' || n_nationkey, CAST(n_regionkey AS VARCHAR)]) AS id_value FROM nation""",
)
def gene_records(spark, sf):
    k = s("n_nationkey")
    rec = table(spark, sf, "nation").select(_record(
        cat("G-", k), cat("ACCESSION-1 - ACC-", k), cat("COMMON-NAME - ", F.col("n_name")), cat("PRODUCT - MONOMER-", k),
        cat('DBLINKS - (UNIPROT "U', k, '" NIL)'), cat('DBLINKS - (NCBI-GENE "', s("n_regionkey"), '" NIL)')).alias("record"))
    return R.records_to_xref(rec, "gene").select("entity_key", "id_type", "id_value")


@query(
    "protein_records",
    """SELECT 'MON-' || c_custkey AS entity_key, unnest(['metacyc', 'synonyms', 'complex_ids', 'gene_ids', 'intermediate_reaction_ids', 'protein_class', 'uniprot']) AS id_type,
  unnest(['MON-' || c_custkey, c_name, 'CPLX-' || c_custkey // 10, 'G-' || c_nationkey, 'ENZRXN-' || c_custkey, c_mktsegment, 'U' || c_custkey]) AS id_value FROM customer""",
)
def protein_records(spark, sf):
    k = s("c_custkey")
    rec = table(spark, sf, "customer").select(_record(
        cat("MON-", k), cat("COMMON-NAME - ", F.col("c_name")), cat("COMPONENT-OF - CPLX-", F.floor(F.col("c_custkey") / 10).cast("string")),
        cat("GENE - G-", s("c_nationkey")), cat("CATALYZES - ENZRXN-", k), cat("TYPES - ", F.col("c_mktsegment")), cat('DBLINKS - (UNIPROT "U', k, '" NIL)')).alias("record"))
    return R.records_to_xref(rec, "protein").select("entity_key", "id_type", "id_value")


def reaction_records(spark, sf):
    """Orders as reaction records; each participant line is followed by its coefficient unless that is one."""
    eq = equation_parts(spark, sf)

    def one(p):
        head = F.concat(F.when(p["side"] == "left", "LEFT - ").otherwise("RIGHT - "), p["name"])
        return F.when(p["stoich"] == 1, head).otherwise(F.concat(head, F.lit("\n^COEFFICIENT - "), p["stoich"].cast("string"), F.lit("\n^COMPARTMENT - CCO-IN")))

    way = F.when(F.col("status") == "F", "REVERSIBLE").when(F.col("status") == "O", "PHYSIOL-LEFT-TO-RIGHT").otherwise("RIGHT-TO-LEFT")
    return eq.select(_record(F.col("reaction_key"), cat("REACTION-DIRECTION - ", way), F.array_join(F.transform("parts", one), "\n"), F.lit("EC-NUMBER - EC-1.1.1.1")).alias("record"))


@query("reaction_records", f"WITH {EQUATION} SELECT reaction_key, equation, trim(direction) AS direction, direction = '<=>' AS reversible FROM equation")
def reaction_records_query(spark, sf):
    return R.records_to_reactions(reaction_records(spark, sf)).select(
        "reaction_key", "equation", "direction", "reversible")


@query("reaction_record_participants", f"WITH {EQUATION} SELECT reaction_key, side, pos, stoich, compound_key FROM participant WHERE reaction_key IN (SELECT reaction_key FROM equation)")
def reaction_record_participants(spark, sf):
    return R.reactions_to_participant(R.records_to_reactions(reaction_records(spark, sf))).drop("stoich_raw")


@query(
    "reaction_record_ids",
    f"WITH {EQUATION} SELECT reaction_key AS entity_key, 'metacyc' AS id_type, reaction_key AS id_value FROM equation UNION ALL SELECT reaction_key, 'enzyme_ec', '1.1.1.1' FROM equation",
)
def reaction_record_ids(spark, sf):
    return R.records_to_xref(reaction_records(spark, sf), "reaction").select("entity_key", "id_type", "id_value")


# reaction and ontology dumps


@query(
    "rhea_xrefs",
    """SELECT DISTINCT 'R' || o_orderkey AS master_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'enzyme_ec' WHEN '2-HIGH' THEN 'metacyc' ELSE 'kegg' END AS id_type, CAST(o_custkey AS VARCHAR) AS id_value
FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM')""",
)
def rhea_xrefs(spark, sf):
    names = {"1-URGENT": "EC", "2-HIGH": "ECOCYC", "3-MEDIUM": "KEGG_REACTION", "4-NOT SPECIFIED": "REACTOME", "5-LOW": "GO"}
    db = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("o_orderpriority"))
    k = key("R", "o_orderkey")
    return T.parse_rhea_xrefs(table(spark, sf, "orders").select(k.alias("rhea_id"), F.lit("UN").alias("direction"), k.alias("master_id"), s("o_custkey").alias("db_id"), db.alias("db")))


@query("rhea_uniprot", "SELECT DISTINCT 'R' || l_orderkey AS master_id, 'U' || l_suppkey AS id_value FROM lineitem")
def rhea_uniprot(spark, sf):
    return T.parse_rhea_uniprot(table(spark, sf, "lineitem").select(key("R", "l_orderkey").alias("master_id"), key("U", "l_suppkey").alias("uniprot")))


@query("alt_ids", "SELECT unnest([o_orderkey * 4 + 1, o_orderkey * 4 + 2, o_orderkey * 4 + 3]) AS alt_id, o_orderkey * 4 AS master_id FROM orders")
def alt_ids(spark, sf):
    k = F.col("o_orderkey") * 4
    return T.parse_alt_ids(table(spark, sf, "orders").select(k.alias("master_id"), (k + 1).alias("left_id"), (k + 2).alias("right_id"), (k + 3).alias("both_id")))


@query(
    "rhea_text",
    f"""WITH {EQUATION} SELECT e.reaction_key, side, pos, stoich, trim(direction) AS direction, substr(compound_key, 2) AS name
FROM equation e JOIN participant USING (reaction_key)""",
)
def rhea_text(spark, sf):
    """Text records of reactions, written with commas on the right and an equals sign for both ways."""
    eq = equation_parts(spark, sf).select("reaction_key", format_equation("parts", "direction").alias("e"))
    chebi = F.regexp_replace(F.regexp_replace("e", " <=> ", " = "), "C(\\d+)", "CHEBI:$1")
    rec = eq.select(_record(F.lit(""), cat("ENTRY       RHEA:", F.col("reaction_key")), cat("DEFINITION  ", F.col("e")), cat("EQUATION    ", chebi)).alias("record"))
    return spread(T.parse_rhea_text(rec), "parts", "p", "reaction_key", "direction").select(
        "reaction_key", "direction", "p.side", "p.pos", "p.stoich", "p.name")


@query(
    "ontology_terms",
    """SELECT CAST(p_partkey AS VARCHAR) AS chebi, unnest(['chebi', 'chemical_formula', 'inchi_key']) AS id_type,
unnest([CAST(p_partkey + 1000000 AS VARCHAR), 'C' || p_size, 'K' || p_partkey]) AS id_value FROM part""",
)
def ontology_terms(spark, sf):
    k = s("p_partkey")
    term = table(spark, sf, "part").select(F.concat_ws(
        "\n", F.lit(""), cat("id: CHEBI:", k), cat("name: ", F.col("p_name")), cat("alt_id: CHEBI:", (F.col("p_partkey") + 1000000).cast("string")),
        cat('property_value: http://x/formula "C', s("p_size"), '" xsd:string'), cat('property_value: http://x/mass "', s("p_retailprice"), '" xsd:string'),
        cat('property_value: http://x/inchikey "K', k, '" xsd:string'), F.lit("")).alias("term"))
    return T.parse_obo(term)


@query(
    "accessions",
    """SELECT CAST(p_partkey AS VARCHAR) AS chebi, CASE p_type WHEN 'SMALL' THEN 'kegg' WHEN 'LARGE' THEN 'metacyc' ELSE 'hmdb' END AS id_type, p_name AS id_value
FROM part WHERE p_type IN ('SMALL', 'LARGE', 'PROMO')""",
)
def accessions(spark, sf):
    names = {"SMALL": "KEGG COMPOUND accession", "LARGE": "MetaCyc accession", "PROMO": "HMDB accession", "MEDIUM": "CAS", "STANDARD": "PubMed", "ECONOMY": "x"}
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), F.col("p_type"))
    return T.parse_accessions(table(spark, sf, "part").select(s("p_partkey").alias("chebi"), kind.alias("type"), F.col("p_name").alias("accession")))


# models, annotations, hierarchies


def _rdf(*uris):
    li = F.array_join(F.array(*[cat('<rdf:li rdf:resource="https://identifiers.org/', u, '"/>') for u in uris]), "")
    return cat('<annotation><rdf:RDF xmlns:rdf="r" xmlns:bqbiol="b"><rdf:Description rdf:about="#x"><bqbiol:is><rdf:Bag>', li,
               "</rdf:Bag></bqbiol:is></rdf:Description></rdf:RDF></annotation>")


def _reaction_xml(spark, sf):
    p = sides(spark, sf)
    ref = F.concat(F.lit('<speciesReference species="M_'), F.col("compound_key"), F.lit('" stoichiometry="'), F.col("stoich").cast("string"), F.lit('"/>'))
    side = lambda w: F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == w, ref))), "")
    sides_ = p.groupBy("reaction_key").agg(side("left").alias("l"), side("right").alias("r"))
    o = table(spark, sf, "orders").select(key("R", "o_orderkey").alias("reaction_key"), "o_custkey", "o_orderpriority")
    rdf = _rdf(cat("ec-code/1.1.1.", s("o_custkey")), cat("rhea/", s("o_custkey"), "#1"), cat("kegg.reaction/", F.col("o_orderpriority")), cat("sabiork/", s("o_custkey")))
    return o.join(sides_, "reaction_key").select(
        F.lit("m1").alias("model"),
        cat('<reaction metaid="R_', F.col("reaction_key"), '" reversible="true">', rdf, "<listOfReactants>", F.col("l"), "</listOfReactants><listOfProducts>", F.col("r"),
            "</listOfProducts></reaction>").alias("xml"))


@query("model_participants", f"WITH {PARTICIPANT} SELECT 'R_' || reaction_key AS reaction_key, side, stoich, 'M_' || compound_key AS compound_key FROM participant")
def model_participants(spark, sf):
    rows = MD.parse_model_rows(_reaction_xml(spark, sf), "reaction")
    return MD.model_participant(rows).select("reaction_key", "side", "stoich", "compound_key")


@query(
    "model_reaction_ids",
    """SELECT 'm1' AS model, 'R_R' || o_orderkey AS reaction_key, unnest(['enzyme_ec', 'rhea', 'kegg']) AS id_type, unnest(['1.1.1.' || o_custkey, CAST(o_custkey AS VARCHAR), o_orderpriority]) AS id_value
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""",
)
def model_reaction_ids(spark, sf):
    return MD.model_reaction_ids(MD.parse_model_rows(_reaction_xml(spark, sf), "reaction"))


@query(
    "model_compound_ids",
    """SELECT DISTINCT 'm1' AS model, 'M_C' || p_partkey AS entity_key, unnest(['kegg', 'inchi_key', 'seed', 'chebi']) AS id_type,
unnest(['C' || p_partkey, 'K' || p_partkey, 'cpd' || p_size, 'CHEBI:' || p_partkey]) AS id_value FROM part WHERE p_type <> 'PROMO'""",
)
def model_compound_ids(spark, sf):
    k = s("p_partkey")
    rdf = _rdf(cat("kegg.compound/C", k), cat("inchikey/K", k), cat("seed.compound/cpd", s("p_size")), cat("CHEBI/CHEBI:", k))
    xml = cat('<species metaid="M_C', k, '" compartment="c">', F.when(F.col("p_type") == "PROMO", "").otherwise(rdf), "</species>")
    return MD.model_compound_ids(MD.parse_model_rows(table(spark, sf, "part").select(F.lit("m1").alias("model"), xml.alias("xml")), "species"))


def _annotation_lines(spark, sf):
    k = s("c_custkey")
    return table(spark, sf, "customer").select(
        key("S", "c_nationkey").alias("sample"),
        line(k, "a", "b", "c", "d", "enzyme_ec:9.9.9.9", cat("enzyme_ec:1.1.1.", F.col("c_mktsegment")), cat("metacyc:RXN:", k), cat("description:made: up ", k), cat("pfam:PF", k)).alias("value"))


@query(
    "annotations",
    "SELECT DISTINCT 'S' || c_nationkey AS sample, unnest(['enzyme_ec', 'metacyc']) AS id_type, unnest(['1.1.1.' || c_mktsegment, 'RXN:' || c_custkey]) AS id_value FROM customer",
)
def annotations(spark, sf):
    return A.parse_annotations(_annotation_lines(spark, sf))


@query(
    "kv_annotations",
    "SELECT DISTINCT 'S' || c_nationkey AS sample, unnest(['enzyme_ec', 'enzyme_ec', 'metacyc', 'pfam']) AS id_type, unnest(['9.9.9.9', '1.1.1.' || c_mktsegment, 'RXN:' || c_custkey, 'PF' || c_custkey]) AS id_value FROM customer",
)
def kv_annotations(spark, sf):
    return A.parse_kv_annotations(_annotation_lines(spark, sf))


@query("kv_annotations_wanted", "SELECT DISTINCT 'S' || c_nationkey AS sample, 'pfam' AS id_type, 'PF' || c_custkey AS id_value FROM customer")
def kv_annotations_wanted(spark, sf):
    return A.parse_kv_annotations(_annotation_lines(spark, sf), ["pfam"])


@query("hierarchy", "SELECT DISTINCT p_size || '.1.' || p_partkey AS code FROM part WHERE p_type <> 'SMALL'")
def hierarchy(spark, sf):
    """One code tree per brand and part type, four levels deep; codes of small parts end in a dash."""
    p = table(spark, sf, "part")
    code = cat(s("p_size"), ".1.", F.when(F.col("p_type") == "SMALL", "-").otherwise(s("p_partkey")), " ", F.col("p_name"))
    leaf = F.struct(code.alias("name"))
    up = lambda inner, name: F.struct(name.alias("name"), F.array(inner).alias("children"))
    tree = up(up(up(up(leaf, F.col("p_type")), F.col("p_type")), F.col("p_brand")), F.lit("root"))
    return A.parse_hierarchy(p.select(tree.alias("tree")), 4)


# pages


_TEXT_SQL = r"""trim(regexp_replace(replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<(/p|br|/li|/h1|/title|/div|/tr|/td)[^>]*>', ' ', 'gi'), '<!--.*?-->', '', 'gs'), '</?[a-zA-Z!?][^>]*>', '', 'gs'),
  '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query("page_text", f"SELECT page_id, md5({_TEXT_SQL}) AS digest FROM pages")
def page_text(spark, sf):
    return P.page_text(table(spark, sf, "pages")).select("page_id", F.md5("text").alias("digest"))


@query("page_links", r"""SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, h[i] AS href FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (
  SELECT page_id, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1) AS h FROM pages))""")
def page_links(spark, sf):
    return P.page_links(table(spark, sf, "pages"))


_CLEAN = r"regexp_replace(replace(replace(replace(replace(regexp_replace(h[i], '</?[a-zA-Z!?][^>]*>', '', 'gs'), '&quot;', '\"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&'), '^[\s]+|[\s]+$', '', 'g')"


@query("page_cells", rf"""SELECT page_id, CAST(i - 1 AS INTEGER) AS pos, {_CLEAN} AS value FROM (SELECT page_id, h, unnest(range(1, len(h) + 1)) AS i FROM (
  SELECT page_id, regexp_extract_all(html, '<li(?:\s[^>]*)?>(.*?)</li>', 1, 'is') AS h FROM pages))""")
def page_cells(spark, sf):
    return P.page_cells(table(spark, sf, "pages"), "li")


@query("page_keys", r"SELECT page_id, regexp_extract(url, '([^:/=?#]+)/?$', 1) AS k FROM pages")
def page_keys(spark, sf):
    return table(spark, sf, "pages").select("page_id", P.page_key().alias("k"))


@query(
    "classify_links",
    """SELECT page_id, CASE WHEN contains(url, '/fr/') THEN 'chebi' WHEN contains(url, '/en/') THEN 'kegg' END AS id_type,
replace(CASE WHEN contains(url, '/fr/') THEN split_part(url, '/fr/', 2) ELSE split_part(url, '/en/', 2) END, '.html', '') AS id_value FROM pages WHERE contains(url, '/fr/') OR contains(url, '/en/')""",
)
def classify_links(spark, sf):
    """Page addresses by language folder: the first pattern that occurs wins."""
    return P.classify_links(table(spark, sf, "pages"), [("/fr/", "chebi"), ("/en/", "kegg")]).select("page_id", "id_type", "id_value")


@query("classify_outbound", "SELECT p_partkey, CASE WHEN p_type = 'SMALL' THEN 'hmdb' ELSE 'chebi' END AS id_type, CASE WHEN p_type = 'SMALL' THEN 'HMDB' || p_partkey ELSE CAST(p_partkey AS VARCHAR) END AS id_value FROM part WHERE p_type <> 'PROMO'")
def classify_outbound(spark, sf):
    k = s("p_partkey")
    url = F.when(F.col("p_type") == "SMALL", cat("http://www.hmdb.ca/metabolites/HMDB", k, ".html")).when(
        F.col("p_type") == "PROMO", cat("http://nowhere.org/", k)).otherwise(cat("http://x.org/s.do?chebiID=CHEBI:", k, "%0A"))
    return P.classify_links(table(spark, sf, "part").select("p_partkey", url.alias("url"))).select("p_partkey", "id_type", "id_value")


def _served(spark, sf):
    """Pages as served by one of two mirrors; some hold a failure notice instead of their text."""
    host = F.when(F.col("page_id") % 2 == 0, "www.kegg.jp").otherwise("www.genome.jp")
    path = F.floor(F.col("page_id") / 2).cast("string")
    notice = F.when(F.col("page_id") % 5 == 0, "<pre>No such data was found.\n</pre>").when(F.col("page_id") % 11 == 0, "<h1>400 Bad Request</h1>")
    return table(spark, sf, "pages").select("page_id", cat("https://", host, "/x/", path).alias("url"), F.coalesce(notice, F.col("html")).alias("html"))


_PAGE_STATE = """
st AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'No such data was found.' WHEN page_id % 11 = 0 THEN '400 Bad Request' WHEN contains(html, 'File not found') THEN 'File not found' END AS notice FROM pages)"""


@query("screen_pages", f"WITH {_PAGE_STATE} SELECT page_id, coalesce(notice, '-') AS notice FROM st")
def screen_pages(spark, sf):
    ok, bad = P.screen_pages(_served(spark, sf))
    return ok.select("page_id", F.lit("-").alias("notice")).unionByName(bad.select("page_id", "notice"))


@query(
    "mirror_pages",
    f"""WITH {_PAGE_STATE} SELECT page_id, false AS mirrored, (SELECT md5(html) FROM pages p WHERE p.page_id = st.page_id) AS digest FROM st WHERE notice IS NULL
UNION ALL SELECT a.page_id, true, (SELECT md5(html) FROM pages p WHERE p.page_id = b.page_id) FROM st a JOIN st b ON b.page_id = CASE WHEN a.page_id % 2 = 0 THEN a.page_id + 1 ELSE a.page_id - 1 END
WHERE a.notice IS NOT NULL AND b.notice IS NULL""",
)
def mirror_pages(spark, sf):
    """A page that failed at one host is taken from the other."""
    return P.with_mirror(_served(spark, sf)).select("page_id", "mirrored", F.md5("html").alias("digest"))


def _search_pages(spark, sf):
    """Search results per brand and size: a count line and one card per part."""
    card = cat('<a class="btn-card" href="/metabolites/HMDB', s("p_partkey"), '">HMDB</a>')
    g = table(spark, sf, "part").groupBy("p_brand", (F.col("p_size") % 10).alias("z")).agg(
        F.count("*").alias("c"), F.array_join(F.array_sort(F.collect_list(card)), "").alias("cards"))
    return g.select(F.concat_ws("/", "p_brand", s("z")).alias("page_id"), F.lit("http://x").alias("url"),
                    cat('<div class="page_info">Displaying all <b>', s("c"), "</b> results</div>", F.col("cards")).alias("html"))


@query(
    "search_hits",
    """WITH g AS (SELECT p_brand || '/' || p_size % 10 AS page_id FROM part GROUP BY ALL)
SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY '<a class="btn-card" href="/metabolites/HMDB' || p_partkey || '">HMDB</a>') - 1 AS INTEGER) AS pos, 'HMDB' || p_partkey AS id
FROM part JOIN g ON page_id = p_brand || '/' || p_size % 10""",
)
def search_hits(spark, sf):
    return P.search_hits(_search_pages(spark, sf))


@query(
    "page_table",
    "SELECT DISTINCT 'N' || c_nationkey AS page_id, 'P' || c_custkey AS id FROM customer WHERE c_mktsegment = 'BUILDING'",
)
def page_table(spark, sf):
    """Rows of a link table on pages, kept when their type is the wanted one."""
    row = cat("<tr><td> <a href='/p'>P", s("c_custkey"), "</a></td><td>", F.col("c_name"), "</td><td>", F.when(F.col("c_mktsegment") == "BUILDING", "Enzyme").otherwise("Transporter"), "</td></tr>")
    half = (F.col("c_custkey") % 2).alias("half")
    pages = table(spark, sf, "customer").groupBy("c_nationkey", half).agg(F.array_join(F.collect_list(row), "\n").alias("rows")).select(
        key("N", "c_nationkey").alias("page_id"), cat("<table><thead><tr><th>HMDBP ID</th><th>Name</th><th>Type</th></tr></thead><tbody>", F.col("rows"), "</tbody></table>").alias("html"))
    return P.rows_of_type(P.extract_table(pages))


def _box(label, value):
    return cat("<tr><th><nobr>", label, "</nobr></th><td>", value, "</td></tr>")


def _grid(*pairs):
    return cat("<table>", *[cat("<tr><td><nobr>", k, "</nobr></td><td valign='top'>", v, "</td></tr>") for k, v in pairs], "</table>")


def _html(*rows):
    return cat("<html><body><table>", *rows, "</table></body></html>")


@query(
    "label_boxes",
    "SELECT 'C' || p_partkey AS page_id, unnest(['Name', 'Formula']) AS label, unnest([p_name || ';' || chr(10) || p_brand, 'C' || p_size || ' & co']) AS value FROM part",
)
def label_boxes(spark, sf):
    html = _html(_box("Name", cat("<div>", F.col("p_name"), ";<br/>\n", F.col("p_brand"), "</div>")), _box("Formula", cat("C", s("p_size"), " &amp; co")))
    pages = table(spark, sf, "part").select(key("C", "p_partkey").alias("page_id"), html.alias("html"))
    return P.extract_boxes(pages, ["Name", "Formula"]).select("page_id", "label", "value")


def _pages(df, url, html):
    return df.select(url.alias("page_id"), url.alias("url"), html.alias("html"))


@query(
    "kegg_gene_pages",
    """SELECT 'x' AS part, CAST(n_nationkey AS VARCHAR) AS entity_key, unnest(['kegg', 'synonyms', 'synonyms', 'kegg_ko', 'ncbi_genbank_gene', 'uniprot', 'uniprot']) AS k,
  unnest([CAST(n_nationkey AS VARCHAR), n_name, 'alias ' || n_nationkey, 'K0' || n_nationkey, CAST(n_regionkey AS VARCHAR), 'U' || n_nationkey, 'V' || n_nationkey]) AS v FROM nation
UNION ALL SELECT 'e', CAST(n_nationkey AS VARCHAR), 'gp', '1.1.1.' || n_regionkey FROM nation""",
)
def kegg_gene_pages(spark, sf):
    k = s("n_nationkey")
    html = _html(
        _box("Gene name", cat(F.col("n_name"), ", alias ", k)), _box("KO", cat("<a>K0", k, "</a> something [EC:1.1.1.", s("n_regionkey"), " 2.2.2.-]")),
        _box("Other DBs", _grid(("NCBI-GeneID: ", s("n_regionkey")), ("UniProt: ", cat("U", k, " V", k)), ("VGNC: ", F.lit("9")))))
    got = P.pages_to_xref(_pages(table(spark, sf, "nation"), cat("https://www.kegg.jp/dbget-bin/www_bget?hsa:", k), html), "kegg_gene")
    return _both(got)


def _both(got):
    rows = got["xref"].select(F.lit("x").alias("part"), "entity_key", F.col("id_type").alias("k"), F.col("id_value").alias("v"))
    return rows.unionByName(got["edge"].select(F.lit("e").alias("part"), F.col("src_key").alias("entity_key"), F.col("edge_type").alias("k"), F.col("dst_key").alias("v")))


@query(
    "kegg_enzyme_pages",
    """SELECT 'x' AS part, '1.1.1.' || c_custkey AS entity_key, unnest(['kegg', 'synonyms', 'synonyms', 'kegg_ko', 'cas']) AS k,
  unnest(['1.1.1.' || c_custkey, lower(c_name), lower(c_mktsegment), 'K' || c_custkey, c_custkey || '-1']) AS v FROM customer
UNION ALL SELECT 'e', '1.1.1.' || c_custkey, unnest(['pg', 'pg', 'pr', 'pr']), unnest(['hsa:' || c_nationkey, 'hsa:n' || c_nationkey, 'R' || c_custkey, 'R1' || c_custkey]) FROM customer""",
)
def kegg_enzyme_pages(spark, sf):
    k = s("c_custkey")
    html = _html(
        _box("Name", cat(F.col("c_name"), ";<br>\n", F.col("c_mktsegment"))), _box("Orthology", _grid((cat("K", k), F.lit("some group")))),
        _box("Genes", _grid((F.lit("HSA: "), cat(s("c_nationkey"), "(ABC) n", s("c_nationkey"))))), _box("Reaction(KEGG)", cat("R", k, "&gt; R1", k)),
        cat("<tr><td>CAS: </td><td>", k, "-1</td></tr>"))
    got = P.pages_to_xref(_pages(table(spark, sf, "customer"), cat("https://www.genome.jp/dbget-bin/www_bget?ec:1.1.1.", k), html), "kegg_enzyme")
    return _both(got)


@query(
    "kegg_reaction_pages",
    f"""WITH {EQUATION} SELECT 'x' AS part, reaction_key AS entity_key, 'kegg' AS k, reaction_key AS v FROM equation UNION ALL SELECT 'x', reaction_key, 'reaction_str', trim(replace(equation, 'C', 'name ')) FROM equation
UNION ALL SELECT 'x', reaction_key, 'pathways', 'rn1 : Path' FROM equation UNION ALL SELECT 'x', reaction_key, 'rhea', substr(reaction_key, 2) FROM equation UNION ALL SELECT 'e', reaction_key, 'rp', '1.1.1.1' FROM equation
UNION ALL SELECT 'p', reaction_key, side || pos, stoich || ' ' || compound_key FROM participant WHERE reaction_key IN (SELECT reaction_key FROM equation)""",
)
def kegg_reaction_pages(spark, sf):
    eq = equation_parts(spark, sf).select("reaction_key", format_equation("parts", "direction").alias("e"))
    esc = lambda c: F.replace(F.replace(c, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    html = _html(
        _box("Definition", esc(F.replace("e", F.lit("C"), F.lit("name ")))), _box("Equation", esc(F.regexp_replace("e", r"(C\d+)", "$1(n)"))),
        _box("Pathway", _grid((F.lit("rn1"), F.lit("Path")))), _box("Enzyme", F.lit("1.1.1.1  1.1.2.-")),
        _box("Other DBs", _grid((F.lit("RHEA:"), F.expr("substring(reaction_key, 2)")))))
    got = P.pages_to_xref(_pages(eq, cat("http://www.kegg.jp/dbget-bin/www_bget?rn:", F.col("reaction_key")), html), "kegg_reaction")
    parts = got["participant"].select(F.lit("p").alias("part"), F.col("reaction_key").alias("entity_key"), F.concat("side", s("pos")).alias("k"),
                                      F.concat_ws(" ", s("stoich"), "compound_key").alias("v"))
    return _both(got).unionByName(parts)


@query(
    "kegg_compound_pages",
    """SELECT 'x' AS part, 'C' || p_partkey AS entity_key, unnest(['kegg', 'synonyms', 'synonyms', 'chemical_formula', 'chebi', 'chebi', 'cas']) AS k,
  unnest(['C' || p_partkey, p_name, lower(p_brand), 'C' || p_size, CAST(p_partkey AS VARCHAR), '1' || p_partkey, p_size || '-0']) AS v FROM part
UNION ALL SELECT 'e', 'C' || p_partkey, 'cr', unnest(['R' || p_partkey, 'S' || p_size]) FROM part""",
)
def kegg_compound_pages(spark, sf):
    k = s("p_partkey")
    html = _html(
        _box("Name", cat(F.upper("p_name"), ";<br>\n", F.col("p_brand"))), _box("Formula", cat("C", s("p_size"))), _box("Reaction", cat("<a>R", k, "</a> <a>S", s("p_size"), "</a>")),
        _box("Other DBs", _grid(("CAS: ", cat(s("p_size"), "-0")), ("ChEBI: ", cat("<a>", k, "</a> <a>1", k, "</a>")), ("NIKKAJI: ", F.lit("J1")))))
    got = P.pages_to_xref(_pages(table(spark, sf, "part"), cat("https://www.genome.jp/dbget-bin/www_bget?cpd:C", k), html), "kegg_compound")
    return _both(got)


@query(
    "hmdb_compound_pages",
    """SELECT 'x' AS part, 'HMDB' || p_partkey AS entity_key, unnest(['hmdb', 'synonyms', 'inchi_key', 'chebi', 'location', 'location']) AS k,
  unnest(['HMDB' || p_partkey, p_name, 'K' || p_partkey, CAST(p_partkey AS VARCHAR), 'Blood', 'Urine']) AS v FROM part
UNION ALL SELECT 'x', 'HMDB' || p_partkey, 'kegg', p_brand FROM part WHERE p_type <> 'PROMO' UNION ALL SELECT 'e', 'HMDB' || p_partkey, 'cp', 'HMDBP' || p_size FROM part""",
)
def hmdb_compound_pages(spark, sf):
    k = s("p_partkey")
    row = lambda label, v: cat("<tr><th>", label, "</th><td>", v, "</td></tr>")
    html = _html(
        row("Common Name", F.upper("p_name")), row("InChI Key", cat("InChIKey=K", k)), row("ChEBI ID", k), row("Biospecimen Locations", F.lit("<ul><li>Blood</li>\n<li>Urine</li></ul>")),
        row("KEGG Compound ID", F.when(F.col("p_type") == "PROMO", "Not Available").otherwise(F.col("p_brand"))), row("Enzymes", cat('<a href="/proteins/HMDBP', s("p_size"), '">x</a>')))
    got = P.pages_to_xref(_pages(table(spark, sf, "part"), cat("http://www.hmdb.ca/metabolites/HMDB", k), html), "hmdb_compound")
    return _both(got)


@query(
    "hmdb_protein_pages",
    """SELECT 'protein' AS entity_type, 'HMDBP' || c_custkey AS entity_key, unnest(['hmdb', 'synonyms', 'uniprot', 'pdb', 'pdb']) AS k, unnest(['HMDBP' || c_custkey, c_name, 'U' || c_custkey, '1A' || c_nationkey, '2B' || c_nationkey]) AS v FROM customer
UNION ALL SELECT 'gene', 'HMDBP' || c_custkey, unnest(['hmdb', 'synonyms', 'uniprot', 'hgnc']), unnest(['HMDBP' || c_custkey, c_mktsegment, 'U' || c_custkey, 'HGNC:' || c_nationkey]) FROM customer
UNION ALL SELECT 'edge', 'HMDBP' || c_custkey, unnest(['pr', 'pg', 'gp']), unnest([CAST(c_nationkey AS VARCHAR), 'HMDBP' || c_custkey, 'HMDBP' || c_custkey]) FROM customer""",
)
def hmdb_protein_pages(spark, sf):
    k = s("c_custkey")
    row = lambda label, v: cat("<tr><th>", label, "</th><td>", v, "</td></tr>")
    html = _html(
        row("Name", F.col("c_name")), row("Gene Name", F.col("c_mktsegment")), row("UniProtKB/Swiss-Prot ID", cat("U", k)), row("PDB IDs", cat("1A", s("c_nationkey"), ",2B", s("c_nationkey"))),
        row("HGNC ID", cat("HGNC:", s("c_nationkey"))), row("Reactions", cat('<a href="/reactions/', s("c_nationkey"), '">r</a>')))
    got = P.pages_to_xref(_pages(table(spark, sf, "customer"), cat("http://www.hmdb.ca/proteins/HMDBP", k), html), "hmdb_protein")
    rows = got["xref"].select("entity_type", "entity_key", F.col("id_type").alias("k"), F.col("id_value").alias("v"))
    return rows.unionByName(got["edge"].select(F.lit("edge").alias("entity_type"), F.col("src_key").alias("entity_key"), F.col("edge_type").alias("k"), F.col("dst_key").alias("v")))


@query(
    "hmdb_reaction_pages",
    f"""WITH {PARTICIPANT}, n AS (SELECT DISTINCT reaction_key FROM participant)
SELECT substr(reaction_key, 2) AS entity_key, side || pos AS k, 'HMDB' || substr(compound_key, 2) AS v FROM participant JOIN n USING (reaction_key)
UNION ALL SELECT substr(reaction_key, 2), 'kegg', reaction_key FROM n UNION ALL SELECT substr(reaction_key, 2), 'hmdb', substr(reaction_key, 2) FROM n UNION ALL SELECT substr(reaction_key, 2), 'rp', 'HMDBP7' FROM n""",
)
def hmdb_reaction_pages(spark, sf):
    eq = equation_parts(spark, sf)
    a = lambda p: F.concat(F.lit('<a href="/metabolites/HMDB'), F.substring(p["name"], F.lit(2), F.length(p["name"])), F.lit('">Cpd '), p["name"], F.lit("</a>"))
    side = lambda w: F.array_join(F.transform(F.filter("parts", lambda p: p["side"] == w), a), " +\n\t")
    html = cat('<div class="panel reaction-panel"><div class="panel-heading"><strong>', side("left"), " = ", side("right"), "</strong></div></div><h4>External Links</h4><ol><li>KEGG Reaction: ",
               F.col("reaction_key"), '</li></ol><a href="/proteins/HMDBP7">p</a>')
    got = P.pages_to_xref(_pages(eq, cat("http://www.hmdb.ca/reactions/", F.expr("substring(reaction_key, 2)")), html), "hmdb_reaction")
    parts = got["participant"].select(F.col("reaction_key").alias("entity_key"), F.concat("side", s("pos")).alias("k"), F.col("source_id").alias("v"))
    ids = got["xref"].filter("id_type <> 'reaction_str'").select("entity_key", F.col("id_type").alias("k"), F.col("id_value").alias("v"))
    return parts.unionByName(ids).unionByName(got["edge"].select(F.col("src_key").alias("entity_key"), F.col("edge_type").alias("k"), F.col("dst_key").alias("v")))
