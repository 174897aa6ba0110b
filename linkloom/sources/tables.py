"""Reaction and ontology dumps: tab separated tables, text records and OBO terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.functions.arrays import spread
from linkloom.functions.equations import direction, parse_equation, standardize_equation

# Database names of the reaction cross-reference table; names left out are dropped on purpose.
RHEA_DBS = {"EC": "enzyme_ec", "METACYC": "metacyc", "ECOCYC": "metacyc", "KEGG_REACTION": "kegg"}
RHEA_DROPPED = ["REACTOME", "MACIE", "GO"]
# Accession types of the ontology's accession table.
ACCESSION_TYPES = {
    "KEGG COMPOUND": "kegg",
    "KEGG DRUG": "kegg",
    "KEGG DRUG accession": "kegg",
    "KEGG COMPOUND accession": "kegg",
    "MetaCyc accession": "metacyc",
    "HMDB accession": "hmdb",
    "Chemspider accession": "chemspider",
}
# Endings of ontology properties.
PROPERTIES = {"formula": "chemical_formula", "smiles": "smiles", "inchikey": "inchi_key"}


def _tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("quote", "").csv(path)


def _map(d: dict[str, str]):
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def parse_rhea_xrefs(df: DataFrame) -> DataFrame:
    """``(rhea_id, direction, master_id, db_id, db)`` to ``(master_id, id_type, id_value)``; unknown names stay as they are."""
    kind = F.coalesce(F.try_element_at(_map(RHEA_DBS), F.col("db")), F.col("db"))
    return df.filter(~F.col("db").isin(RHEA_DROPPED)).select("master_id", kind.alias("id_type"), F.col("db_id").alias("id_value")).distinct()


def read_rhea_xrefs(spark: SparkSession, path: str) -> DataFrame:
    return parse_rhea_xrefs(_tsv(spark, path, "rhea_id string, direction string, master_id string, db_id string, db string"))


def parse_rhea_uniprot(df: DataFrame) -> DataFrame:
    """``(rhea_id, direction, master_id, uniprot)`` to distinct ``(master_id, id_value)``."""
    return df.select("master_id", F.col("uniprot").alias("id_value")).distinct()


def read_rhea_uniprot(spark: SparkSession, path: str) -> DataFrame:
    return parse_rhea_uniprot(_tsv(spark, path, "rhea_id string, direction string, master_id string, uniprot string"))


def parse_alt_ids(df: DataFrame) -> DataFrame:
    """``(master_id, left_id, right_id, both_id)`` unpivoted to ``(alt_id, master_id)``."""
    return df.unpivot(["master_id"], ["left_id", "right_id", "both_id"], "way", "alt_id").filter(
        F.col("alt_id").isNotNull()).select("alt_id", "master_id")


def read_alt_ids(spark: SparkSession, path: str) -> DataFrame:
    return parse_alt_ids(_tsv(spark, path, "master_id string, left_id string, right_id string, both_id string"))


def parse_rhea_text(records: DataFrame) -> DataFrame:
    """Text records ``(record)`` to ``(reaction_key, definition, equation, direction, reversible, parts)``.

    A side may be empty; the equation then begins or ends with its sign and a blank.
    """
    field = lambda name: F.trim(F.regexp_extract("record", rf"(?m)^{name}[ \t]+(.*?)\r?$", 1))
    eq = standardize_equation(F.replace(field("EQUATION"), F.lit(","), F.lit(" + ")))
    eq = F.replace(eq, F.lit("CHEBI:"), F.lit(""))
    out = records.select(
        F.replace(field("ENTRY"), F.lit("RHEA:"), F.lit("")).alias("reaction_key"), field("DEFINITION").alias("definition"), eq.alias("equation")
    ).filter((F.col("reaction_key") != "") & (F.col("definition") != "") & (F.col("equation") != ""))
    return out.withColumn("direction", direction("equation")).withColumn(
        "reversible", F.coalesce(F.col("direction") == "<=>", F.lit(False))).withColumn("parts", parse_equation("equation"))


def read_rhea_reactions(spark: SparkSession, path: str) -> DataFrame:
    return parse_rhea_text(spark.read.option("lineSep", "///").text(path).withColumnRenamed("value", "record"))


def parse_obo(terms: DataFrame) -> DataFrame:
    """Ontology terms ``(term)`` to ``(chebi, id_type, id_value)``: alternative ids, formula, SMILES, InChI key."""
    main = F.trim(F.regexp_extract("term", r"(?m)^id: CHEBI:(\S+)", 1))
    line = spread(terms, F.split("term", "\r?\n"), "line", main.alias("chebi")).filter(F.col("chebi") != "")
    tok = F.split(F.trim("line"), r"\s+")
    link = F.element_at(tok, 2)
    prop = F.lit(None).cast("string")
    for ending, kind in PROPERTIES.items():
        prop = F.when(link.endswith(ending), F.lit(kind)).otherwise(prop)
    is_prop = F.col("line").startswith("property_value:") & (F.size(tok) == 4)
    is_alt = F.col("line").startswith("alt_id:")
    return line.filter(is_prop | is_alt).select(
        "chebi", F.when(is_alt, "chebi").otherwise(prop).alias("id_type"),
        F.when(is_alt, F.trim(F.substring_index("line", "CHEBI:", -1)))
        .otherwise(F.regexp_replace(F.element_at(tok, 3), r'^"+|"+$', "")).alias("id_value"),
    ).filter(F.col("id_type").isNotNull())


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    return parse_obo(spark.read.option("lineSep", "[Term]").text(path).withColumnRenamed("value", "term"))


def parse_accessions(df: DataFrame) -> DataFrame:
    """``(row_id, chebi, source, type, accession)`` to ``(chebi, id_type, id_value)``; other types are dropped."""
    kind = F.try_element_at(_map(ACCESSION_TYPES), F.col("type"))
    return df.select("chebi", kind.alias("id_type"), F.col("accession").alias("id_value")).filter(F.col("id_type").isNotNull())


def read_accessions(spark: SparkSession, path: str) -> DataFrame:
    return parse_accessions(_tsv(spark, path, "row_id string, chebi string, source string, type string, accession string"))
