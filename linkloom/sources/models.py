"""Metabolic model files: reactions with participants and annotation URIs, species with ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# URI names and the id type they fill, for reactions. Other names are dropped.
REACTION_URIS = {"ec-code": "enzyme_ec", "kegg.reaction": "kegg", "reactome": "reactome", "rhea": "rhea", "biocyc": "metacyc"}

_REFS = "struct<speciesReference: array<struct<_species: string, _stoichiometry: string>>>"
_RDF = (
    "struct<`rdf:RDF`: struct<`rdf:Description`: struct<`bqbiol:is`: struct<`rdf:Bag`: struct<`rdf:li`: "
    "array<struct<`_rdf:resource`: string, _VALUE: string>>>>>>>"
)
REACTION_SCHEMA = f"_metaid string, _id string, _reversible string, annotation {_RDF}, listOfReactants {_REFS}, listOfProducts {_REFS}"
SPECIES_SCHEMA = f"_metaid string, _id string, _compartment string, annotation {_RDF}"


def read_model_rows(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """``<reaction>`` or ``<species>`` elements of model files, with the file name as ``model``."""
    schema = {"reaction": REACTION_SCHEMA, "species": SPECIES_SCHEMA}[tag]
    df = spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    return df.select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("model"))


def parse_model_rows(df: DataFrame, tag: str, column: str = "xml") -> DataFrame:
    """The same for elements held as text in a column next to ``model``."""
    schema = {"reaction": REACTION_SCHEMA, "species": SPECIES_SCHEMA}[tag]
    return df.select("model", F.from_xml(column, schema, {"rowTag": tag}).alias("x")).select("model", "x.*")


def _key():
    return F.coalesce("_metaid", "_id")


def model_participant(rows: DataFrame) -> DataFrame:
    """``(model, reaction_key, side, pos, stoich, stoich_raw, compound_key)``."""
    def side(name: str, column: str) -> DataFrame:
        return rows.select("model", _key().alias("reaction_key"), F.lit(name).alias("side"),
                           F.posexplode(f"{column}.speciesReference").alias("pos", "p"))

    both = side("left", "listOfReactants").unionByName(side("right", "listOfProducts"))
    raw = F.coalesce(F.col("p._stoichiometry"), F.lit("1"))
    whole = raw.try_cast("double")
    return both.select(
        "model", "reaction_key", "side", "pos",
        F.when(whole == F.floor(whole), whole.cast("int")).otherwise(F.lit(-1)).alias("stoich"),
        raw.alias("stoich_raw"), F.col("p._species").alias("compound_key"))


def _uris(rows: DataFrame) -> DataFrame:
    uri = F.transform(F.col("annotation.`rdf:RDF`.`rdf:Description`.`bqbiol:is`.`rdf:Bag`.`rdf:li`"), lambda x: x["_rdf:resource"])
    part = lambda i: F.try_element_at(F.split("uri", "/"), F.lit(i))
    return rows.select("model", _key().alias("entity_key"), F.explode(uri).alias("uri")).select(
        "model", "entity_key", part(-2).alias("db"), part(-1).alias("id_value"))


def model_reaction_ids(rows: DataFrame) -> DataFrame:
    """``(model, reaction_key, id_type, id_value)`` from the resource URIs of reactions."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in REACTION_URIS.items() for x in kv]), F.col("db"))
    value = F.when(F.col("db") == "rhea", F.substring_index("id_value", "#", 1)).otherwise(F.col("id_value"))
    return _uris(rows).select("model", F.col("entity_key").alias("reaction_key"), kind.alias("id_type"), value.alias("id_value")).filter(
        F.col("id_type").isNotNull()).distinct()


def model_compound_ids(rows: DataFrame) -> DataFrame:
    """``(model, entity_key, id_type, id_value)`` from the resource URIs of species; a species without ids has no row."""
    db = F.lower("db")
    kind = (
        F.when(F.contains(db, F.lit("kegg")), "kegg").when(db == "inchikey", "inchi_key")
        .when(F.contains(db, F.lit("seed")), "seed").when(F.contains(db, F.lit("metanetx")), "metanetx").otherwise(db)
    )
    return _uris(rows).select("model", "entity_key", kind.alias("id_type"), "id_value").filter(F.col("id_value") != "").distinct()


def read_model(spark: SparkSession, path: str) -> DataFrame:
    return model_participant(read_model_rows(spark, path, "reaction"))
