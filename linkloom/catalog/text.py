"""Queries on text, id and equation functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.catalog.registry import query
from linkloom.catalog.roles import EQUATION, equation_parts, key, table
from linkloom.functions import equations as E
from linkloom.functions import text as T
from linkloom.functions.arrays import spread
from linkloom.operators.lookup import text_ecs


def _trim_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s]+|[\s]+$', '', 'g')"


NORMAL = _trim_sql("replace(lower({0}), chr(10), '')")
for _tag in T.QUALIFIERS:
    NORMAL = f"replace({NORMAL}, '{_tag}', '')"
NORMAL = _trim_sql(NORMAL)


def normal_sql(x: str, compound: bool) -> str:
    n = NORMAL.format(x)
    if not compound:
        return f"nullif({n}, '')"
    bare = rf"CASE WHEN regexp_matches({x}, '^an?\s') THEN regexp_replace({n}, '^an?\s', '') ELSE {n} END"
    return f"CASE WHEN length(regexp_replace({bare}, '[^0-9]', '', 'g')) * 3 < length({bare}) THEN {bare} END"


@query(
    "normalize_names",
    f"""SELECT 'part' AS origin, p_partkey AS id, {normal_sql("'A ' || upper(p_name) || ' (brand name)' || chr(10)", True)} AS name FROM part
UNION ALL SELECT 'article', p_partkey, {normal_sql("'an ' || p_name || '(ambiguous)'", True)} FROM part
UNION ALL SELECT 'digits', p_partkey, {normal_sql("p_partkey || p_type", True)} FROM part
UNION ALL SELECT 'document', doc_id, md5({normal_sql("text", False)}) FROM documents""",
)
def normalize_names(spark, sf):
    p, d = table(spark, sf, "part"), table(spark, sf, "documents")
    row = lambda df, origin, i, c: df.select(F.lit(origin).alias("origin"), F.col(i).alias("id"), c.alias("name"))
    brand = F.concat(F.lit("A "), F.upper("p_name"), F.lit(" (brand name)\n"))
    return (
        row(p, "part", "p_partkey", T.normalize_synonym(brand, "compound"))
        .unionByName(row(p, "article", "p_partkey", T.normalize_synonym(F.concat(F.lit("an "), "p_name", F.lit("(ambiguous)")), "compound")))
        .unionByName(row(p, "digits", "p_partkey", T.normalize_synonym(F.concat(F.col("p_partkey").cast("string"), "p_type"), "compound")))
        .unionByName(row(d, "document", "doc_id", F.md5(T.normalize_synonym("text", "protein"))))
    )


# split a text around its raw hits, then look at the characters next to each hit
_HIT = T.EC_TEXT.replace("(?:", "(")
EC_HITS = rf"""
cut AS (SELECT doc_id, string_split(regexp_replace(text, '{_HIT}', chr(1) || '\0' || chr(1), 'g'), chr(1)) AS parts FROM documents),
hits AS (
  SELECT doc_id, parts[2 * i] AS hit, right(parts[2 * i - 1], 1) AS before,
         left(parts[2 * i + 1] || coalesce(parts[2 * i + 2], ''), 1) AS after
  FROM (SELECT doc_id, parts, unnest(range(1, CAST(len(parts) // 2 + 1 AS BIGINT))) AS i FROM cut)
)"""


@query(
    "ec_extract",
    f"""WITH {EC_HITS}
SELECT DISTINCT doc_id, hit AS enzyme_ec FROM hits
WHERE before <> '.' AND NOT regexp_matches(after, '[.a-zA-Z0-9-]')
  AND length(hit) - length(replace(hit, '.', '')) >= 2
  AND length(hit) - length(replace(hit, '.', '')) + 1 - (length(hit) - length(replace(hit, '-', ''))) >= 3""",
)
def ec_extract(spark, sf):
    """Enzyme numbers named anywhere in the documents."""
    return text_ecs(table(spark, sf, "documents"), "doc_id", "text")


@query(
    "ec_filter",
    r"""WITH tok AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(text, '\s+')) AS token FROM documents)
SELECT doc_id, token, len(string_split(replace(token, '.-', ''), '.')) >= 4 AS strict FROM tok
WHERE regexp_matches(token, '^\d+\.\d+\.\d+') AND len(string_split(replace(token, '.-', ''), '.')) >= 3""",
)
def ec_filter(spark, sf):
    """Words of the documents that have the shape of an enzyme number."""
    tok = spread(table(spark, sf, "documents"), F.array_distinct(F.split("text", r"\s+")), "token", "doc_id")
    return tok.filter(T.is_ec("token", 3)).select("doc_id", "token", T.is_ec("token", 4).alias("strict"))


@query(
    "strip_markup",
    r"""SELECT page_id, md5(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'),
  '</?[a-zA-Z!?][^>]*>', '', 'gs'), '&quot;', '"'), '&middot;', '·'), '&copy;', '©'), '&amp;', '&')) AS digest FROM pages""",
)
def strip_markup(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.md5(T.strip_tags("html")).alias("digest"))


@query(
    "id_cleanup",
    r"""SELECT p_partkey AS id, 'K' || p_partkey AS stripped, 'HMDB1' || p_partkey AS variant,
  'C' || p_size || 'H' || p_partkey AS formula, p_name <> 'red bolt' AS available,
  CASE WHEN p_type = 'SMALL' THEN 'N_A' ELSE p_type || ' ; ' || p_brand END AS joined,
  p_name || ' , ' || p_type AS listed,
  CASE WHEN p_type = 'SMALL' THEN 1 ELSE 0 END + CASE WHEN p_size = 1 THEN 1 ELSE 0 END AS missing,
  p_type = 'SMALL' OR p_size = 1 AS incomplete,
  p_type = 'STANDARD' AS overlaps FROM part""",
)
def id_cleanup(spark, sf):
    """Prefix removal, id variants, formulas, unavailable values, joined lists and missing field counts."""
    k = F.col("p_partkey").cast("string")
    typed = F.when(F.col("p_type") != "SMALL", F.col("p_type"))
    return table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        T.strip_prefix(F.concat(F.lit("InChIKey=K"), k)).alias("stripped"),
        F.element_at(T.hmdb_variants(F.concat(F.lit("HMDB0001"), k)), -1).alias("variant"),
        T.clean_formula(F.array(F.concat(F.lit("(C "), F.col("p_size").cast("string"), F.lit(")")), F.concat(F.lit("(H "), k, F.lit(")")))).alias("formula"),
        T.is_available(F.when(F.col("p_name") == "red bolt", F.lit("Not Available")).otherwise(F.col("p_name"))).alias("available"),
        T.join_values(F.when(typed.isNotNull(), F.array(typed, typed, "p_brand"))).alias("joined"),
        T.list_text(F.array("p_name", "p_type")).alias("listed"),
        T.n_missing(typed, F.when(F.col("p_size") != 1, F.col("p_size"))).alias("missing"),
        T.any_missing(typed, F.when(F.col("p_size") != 1, F.col("p_size"))).alias("incomplete"),
        T.ids_overlap(F.array("p_type", "p_brand"), F.array(F.lit("standard"), F.lit("none")), ignore_case=True).alias("overlaps"),
    )


_WORDS = """
w AS (SELECT DISTINCT p_name AS name, split_part(p_name, ' ', 2) AS word FROM part),
q AS (SELECT DISTINCT word || CASE WHEN length(word) % 2 = 0 THEN 's' ELSE '' END AS query FROM w),
n AS (SELECT DISTINCT word AS name FROM w UNION SELECT name FROM w)"""


@query(
    "synonym_equal",
    f"""WITH {_WORDS}
SELECT query, name, lower(query) = lower(name) AS exact, contains(lower(name), lower(query)) AS inside FROM q, n
WHERE lower(query) = lower(name) OR lower(query) = lower(name) || 's' OR lower(query) || 's' = lower(name)""",
)
def synonym_equal(spark, sf):
    """Names that equal a query up to a plural s: an equi join on the plural key, then the exact test."""
    p = table(spark, sf, "part").select("p_name", F.element_at(F.split("p_name", " "), 2).alias("word")).distinct()
    q = p.select(F.concat("word", F.when(F.length("word") % 2 == 0, "s").otherwise("")).alias("query")).distinct()
    n = p.select(F.col("word").alias("name")).unionByName(p.select(F.col("p_name").alias("name"))).distinct()
    met = q.withColumn("k", T.plural_key("query")).join(n.withColumn("k", T.plural_key("name")), "k")
    return met.filter(T.synonym_equal("query", "name")).select(
        "query", "name", T.synonym_equal("query", "name", "exact").alias("exact"), T.synonym_equal("query", "name", "contains").alias("inside"))


@query("equation_build", f"WITH {EQUATION} SELECT reaction_key, equation, reaction_compounds FROM equation")
def equation_build(spark, sf):
    return equation_parts(spark, sf).select(
        "reaction_key", E.format_equation("parts", "direction").alias("equation"),
        E.format_equation("parts", "direction", with_stoich=False).alias("reaction_compounds"))


def _spelled(spark, sf):
    """Equations in a spelling that depends on their status."""
    eq = equation_parts(spark, sf).withColumn("equation", E.format_equation("parts", "direction"))
    odd = F.when(F.col("status") == "F", F.replace("equation", F.lit(" <=> "), F.lit(" ↔ "))).when(
        F.col("status") == "O", F.replace("equation", F.lit(" => "), F.lit(" -> "))).otherwise(
        F.replace("equation", F.lit(" <= "), F.lit(" &lt;- ")))
    return eq.withColumn("spelled", odd)


@query("equation_standardize", f"WITH {EQUATION} SELECT reaction_key, trim(direction) AS direction, equation FROM equation")
def equation_standardize(spark, sf):
    return _spelled(spark, sf).select("reaction_key", E.direction("spelled").alias("direction"), E.standardize_equation("spelled").alias("equation"))


@query(
    "equation_parse",
    f"""WITH {EQUATION} SELECT reaction_key, side, pos, stoich, compound_key AS name FROM participant
WHERE reaction_key IN (SELECT reaction_key FROM equation)""",
)
def equation_parse(spark, sf):
    return spread(_spelled(spark, sf), E.parse_equation("spelled"), "p", "reaction_key").select(
        "reaction_key", "p.side", "p.pos", "p.stoich", "p.name")


@query(
    "equation_align",
    f"""WITH {EQUATION} SELECT reaction_key, side, pos, stoich, 'I' || substr(compound_key, 2) AS name FROM participant
WHERE reaction_key IN (SELECT reaction_key FROM equation)""",
)
def equation_align(spark, sf):
    """Stoichiometry of the name equation put on the equation of ids."""
    eq = equation_parts(spark, sf).select("reaction_key", E.format_equation("parts", "direction").alias("names"))
    eq = eq.withColumn("ids", F.regexp_replace(F.regexp_replace("names", r"\d+ C", "C"), "C", "I"))
    return spread(eq, E.align_equation("names", "ids"), "p", "reaction_key").select("reaction_key", "p.side", "p.pos", "p.stoich", "p.name")


@query(
    "equation_align_ids",
    f"""WITH {EQUATION} SELECT reaction_key, side, pos, stoich, 'I' || substr(compound_key, 2) AS name FROM participant
WHERE reaction_key IN (SELECT reaction_key FROM equation)""",
)
def equation_align_ids(spark, sf):
    """The same from a flat id list in which every other first id is listed twice in a row."""
    eq = equation_parts(spark, sf).select("reaction_key", "parts", E.format_equation("parts", "direction").alias("names"))
    ids = F.transform("parts", lambda p: F.concat(F.lit("I"), F.substring(p["name"], F.lit(2), F.length(p["name"]))))
    eq = eq.withColumn("ids", ids).withColumn("ids", F.when(F.length("reaction_key") % 2 == 0, F.concat(F.slice("ids", 1, 1), "ids")).otherwise(F.col("ids")))
    return spread(eq, E.align_ids("names", "ids"), "p", "reaction_key").select("reaction_key", "p.side", "p.pos", "p.stoich", "p.name")


@query("equation_build_one_sided", f"WITH {EQUATION} SELECT reaction_key, equation FROM equation")
def equation_build_one_sided(spark, sf):
    """Equations of all reactions with lines, those with one side too."""
    return equation_parts(spark, sf).select("reaction_key", E.format_equation("parts", "direction").alias("equation"))


@query("equation_parse_one_sided", f"WITH {EQUATION} SELECT reaction_key, side, pos, stoich, compound_key AS name FROM participant JOIN equation USING (reaction_key)")
def equation_parse_one_sided(spark, sf):
    return spread(_spelled(spark, sf), E.parse_equation("spelled"), "p", "reaction_key").select(
        "reaction_key", "p.side", "p.pos", "p.stoich", "p.name")


@query("equation_align_one_sided", f"WITH {EQUATION} SELECT reaction_key, side, pos, stoich, 'I' || substr(compound_key, 2) AS name FROM participant JOIN equation USING (reaction_key)")
def equation_align_one_sided(spark, sf):
    eq = equation_parts(spark, sf).select("reaction_key", E.format_equation("parts", "direction").alias("names"))
    eq = eq.withColumn("ids", F.regexp_replace(F.regexp_replace("names", r"\d+ C", "C"), "C", "I"))
    return spread(eq, E.align_equation("names", "ids"), "p", "reaction_key").select("reaction_key", "p.side", "p.pos", "p.stoich", "p.name")


@query(
    "equation_sides",
    f"""WITH {EQUATION} SELECT reaction_key, trim(direction) AS sign, direction = '<=>' AS reversible,
  coalesce((SELECT string_agg(compound_key, ',' ORDER BY pos) FROM participant p WHERE p.reaction_key = e.reaction_key AND side = 'left'), '') AS left_ids,
  coalesce((SELECT string_agg(compound_key, ',' ORDER BY pos) FROM participant p WHERE p.reaction_key = e.reaction_key AND side = 'right'), '') AS right_ids
FROM equation e""",
)
def equation_sides(spark, sf):
    eq = equation_parts(spark, sf).select("reaction_key", E.equation_sides(E.format_equation("parts", "direction", False)).alias("s"))
    return eq.select("reaction_key", "s.sign", "s.reversible", F.array_join("s.left", ",").alias("left_ids"), F.array_join("s.right", ",").alias("right_ids"))


@query(
    "equation_ids",
    f"""WITH {EQUATION} SELECT DISTINCT reaction_key, substr(compound_key, 2) AS id FROM participant
WHERE reaction_key IN (SELECT reaction_key FROM equation)""",
)
def equation_ids(spark, sf):
    eq = equation_parts(spark, sf).select("reaction_key", E.format_equation("parts", "direction", False).alias("e"))
    return spread(eq, E.equation_ids("e"), "id", "reaction_key").distinct()
