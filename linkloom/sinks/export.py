"""Outputs: entity lines, SIF edge lists, seeds, reports, property graph tables and the ledger of finished seeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkloom.functions.text import is_ec
from linkloom.operators.expand import end_type, ends
from linkloom.operators.samples import Pairs
from linkloom.session import cut

# Field name of an outgoing link, by the entity type it leads to; complexes have their own.
LINK_FIELD = {"gene": "genes_connected", "protein": "proteins_connected", "reaction": "reactions_connected"}
FAMILY = ["in_complex", "has_subunits"]
ORDER = ["gene", "protein", "compound", "reaction"]


def dense_ids(entities: DataFrame) -> DataFrame:
    """``(entity_type, entity_key, internal_id)``: whole numbers from 0 over genes, proteins, compounds, reactions.

    Rows are range sorted in parallel; only one count per partition is summed up in one place.
    """
    rank = F.array_position(F.array(*[F.lit(t) for t in ORDER]), F.col("entity_type"))
    rows = entities.select("entity_type", "entity_key").distinct().withColumn("o", rank)
    placed = cut(
        rows.repartitionByRange("o", "entity_key").sortWithinPartitions("o", "entity_key")
        .withColumn("part", F.spark_partition_id()).withColumn("mid", F.monotonically_increasing_id()))
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    start = placed.groupBy("part").agg(F.min("mid").alias("lo"), F.count("*").alias("c")).select(
        "part", "lo", F.coalesce(F.sum("c").over(w), F.lit(0)).alias("offset"))
    return placed.join(start, "part").select(
        "entity_type", "entity_key", (F.col("mid") - F.col("lo") + F.col("offset")).cast("string").alias("internal_id"))


def entity_kv(xref: DataFrame, edge: DataFrame, participant: DataFrame, reaction: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """``(entity_type, internal_id, k, v)`` of all entities.

    A full enzyme number under another key than ``enzyme_ec`` is not written. ``ids(entity_type, entity_key,
    internal_id)`` renames the keys of each type (of all alike without its ``entity_type``); without it keys are written
    as they are. A reaction of unknown direction is written as reversible.
    """
    detail = xref.filter(~(is_ec("id_value", 4) & (F.col("id_type") != "enzyme_ec"))).select(
        "entity_type", "entity_key", F.col("id_type").alias("k"), F.col("id_value").alias("v"))
    links = edge.select("edge_type", "src_key", "dst_key")
    parts = participant.select("reaction_key", "side", "pos", "stoich", "compound_key")
    if ids is not None:
        typed = "entity_type" in ids.columns

        def renamed(df: DataFrame, col: str, kind) -> DataFrame:
            """``df`` with the keys in ``col``, of the entity type ``kind``, replaced."""
            new = ids.select(F.col("entity_key").alias(col), "internal_id", *([F.col("entity_type").alias("_kind")] if typed else []))
            df = df.withColumn("_kind", kind) if typed else df
            return df.join(new, [col, *(["_kind"] if typed else [])]).drop(col, "_kind").withColumnRenamed("internal_id", col)

        detail = renamed(detail, "entity_key", F.col("entity_type"))
        links = renamed(renamed(links, "src_key", end_type("edge_type", 0)), "dst_key", end_type("edge_type", 1))
        parts = renamed(parts, "compound_key", F.lit("compound"))
    types = F.create_map(*[F.lit(x) for e in ("gp", "pg", "pr", "rp", "cr", "rc", "pp", "cp", *FAMILY) for x in (e, ends(e)[0])])
    fields = F.create_map(*[F.lit(x) for e in ("gp", "pg", "pr", "rp", "cr", "pp", "cp") for x in (e, LINK_FIELD[ends(e)[1]])],
                          *[F.lit(x) for e in FAMILY for x in (e, e)])
    conn = links.filter(F.col("edge_type") != "rc").select(
        F.element_at(types, F.col("edge_type")).alias("entity_type"), F.col("src_key").alias("entity_key"),
        F.element_at(fields, F.col("edge_type")).alias("k"), F.col("dst_key").alias("v"))
    side = lambda s: F.array_join(F.transform(F.filter("p", lambda x: x["side"] == s), lambda x: x["compound_key"]), " + ")
    eq = parts.groupBy("reaction_key").agg(F.array_sort(F.collect_list(F.struct("side", "pos", "stoich", "compound_key"))).alias("p")).join(
        reaction.select("reaction_key", F.col("direction").alias("said")), "reaction_key", "left").withColumn("direction", F.coalesce("said", F.lit("<=>"))).select(
        F.col("reaction_key").alias("entity_key"),
        F.explode(F.array(
            F.struct(F.lit("reaction_compounds").alias("k"), F.concat_ws(" ", side("left"), "direction", side("right")).alias("v")),
            F.struct(F.lit("stoichiometry").alias("k"), F.array_join(F.transform("p", lambda x: x["stoich"].cast("string")), ",").alias("v")),
        )).alias("x"))
    if ids is not None:
        eq = renamed(eq, "entity_key", F.lit("reaction"))
    # repeated rows go once, at the end
    rows = detail.unionByName(conn).unionByName(eq.select(F.lit("reaction").alias("entity_type"), "entity_key", "x.k", "x.v"))
    return rows.select("entity_type", F.col("entity_key").alias("internal_id"), "k", "v").distinct()


def entity_lines(kv: DataFrame, per_line: int = 100_000) -> DataFrame:
    """``(entity_type, value)``: one line per entity, its fields sorted.

    An entity of more than ``per_line`` fields gets several lines of about that many; the reader takes lines with the same
    ``internal_id`` as one entity, so no hub is gathered in one row.
    """
    key = ["entity_type", "internal_id"]
    long = kv.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > per_line).select(*key, F.ceil(F.col("n") / per_line).alias("pieces"))
    piece = F.coalesce(F.pmod(F.xxhash64("k", "v"), F.col("pieces")), F.lit(0))
    fields = F.array_sort(F.collect_list(F.concat_ws(":", "k", "v")))
    return kv.join(long, key, "left").groupBy(*key, piece.alias("piece")).agg(fields.alias("f")).select(
        "entity_type", F.concat_ws("\t", F.concat(F.lit("internal_id:"), "internal_id"), F.array_join("f", "\t")).alias("value"))


def write_entities(kv: DataFrame, path: str) -> None:
    """One folder of text files per entity type."""
    entity_lines(kv).write.mode("overwrite").partitionBy("entity_type").text(path)


def sif_edges(edge: DataFrame, participant: DataFrame) -> DataFrame:
    """``(SOURCE, INTERACTION, TARGET)``: substrates ``cr``, products ``rc``, links by the initials of their ends."""
    left = F.col("side") == "left"
    p = participant.select(
        F.when(left, F.col("compound_key")).otherwise(F.col("reaction_key")).alias("SOURCE"),
        F.when(left, "cr").otherwise("rc").alias("INTERACTION"),
        F.when(left, F.col("reaction_key")).otherwise(F.col("compound_key")).alias("TARGET"))
    links = edge.filter(~F.col("edge_type").isin("cr", "rc", *FAMILY)).select(
        F.col("src_key").alias("SOURCE"), F.col("edge_type").alias("INTERACTION"), F.col("dst_key").alias("TARGET"))
    return p.unionByName(links).distinct()


def write_sif(sif: DataFrame, path: str) -> None:
    sif.write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def sif_organisms(linked: DataFrame, rp: DataFrame, sample_proteins: DataFrame | Pairs) -> DataFrame:
    """Compound to reaction ``cr``, reaction to protein ``rp``, protein to sample ``ps``.

    Rows of one kind differ from all others, so each kind is made distinct by itself; ``Pairs (sample, protein)`` are already.
    """
    row = lambda df, a, kind, b: df.select(F.col(a).alias("SOURCE"), F.lit(kind).alias("INTERACTION"), F.col(b).alias("TARGET"))
    once = sample_proteins.rows("sample", "protein_key") if isinstance(sample_proteins, Pairs) else sample_proteins.select("sample", "protein_key").distinct()
    return row(linked, "compound_key", "cr", "reaction_key").unionByName(row(rp, "reaction_key", "rp", "protein_key")).distinct().unionByName(
        row(once, "protein_key", "ps", "sample"))


def seed_rows(ids: DataFrame, entity_type: str, mode: str) -> DataFrame:
    """Ids ``(id, id_type)`` as seeds of one mode."""
    return ids.select("id", "id_type", F.lit(entity_type).alias("entity_type"), F.lit(mode).alias("mode")).distinct()


def write_seeds(seeds: DataFrame, path: str) -> None:
    seeds.select("id", "id_type", "entity_type", "mode").write.mode("overwrite").option("sep", "\t").csv(path)


def write_property_graph(nodes: DataFrame, id_nodes: DataFrame, rels: DataFrame, path: str) -> None:
    """Node and relation tables as Parquet, one folder per label or relation type."""
    nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/nodes")
    id_nodes.write.mode("overwrite").partitionBy("label").parquet(f"{path}/id_nodes")
    rels.write.mode("overwrite").partitionBy("rel_type").parquet(f"{path}/rels")


def pending(seeds: DataFrame, ledger: DataFrame) -> DataFrame:
    """Seed lines that are not in the ledger yet."""
    return seeds.join(ledger.select("line").distinct(), "line", "left_anti")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger, empty when it does not exist yet."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(jvm):
        return spark.createDataFrame([], "line string")
    return spark.read.schema("line string").option("recursiveFileLookup", True).parquet(path)


def log_batch(seeds: DataFrame, path: str, number: int) -> None:
    """The lines of a stream's batch in the ledger, under its number: logging a batch again replaces its entry."""
    seeds.select("line").write.mode("overwrite").parquet(f"{path}/batch-{number}")


def log_finished(seeds: DataFrame, path: str) -> None:
    """Add finished seed lines to the ledger."""
    seeds.select("line").write.mode("append").parquet(path)
