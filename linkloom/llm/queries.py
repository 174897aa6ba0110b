"""The queries of the training-data operators; each takes ``(spark, sf_dir)`` and reads a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.llm import bpe, conversation, lattice, line_dedup, mixing, ngram_join, ordering, pii, quality, recompression, resampling, token_counts, warc

QUERIES, SQL = {}, {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query("op5_byte_bpe")
def op5(spark, sf_dir):
    """Ids of every whole text and the bytes they decode to, as digests."""
    return bpe.encode_texts(_table(spark, sf_dir, "documents"), ["n_tokens", "ids_sha256", "decoded_sha256"])


@_query("op10_token_counts")
def op10(spark, sf_dir):
    """Tokens of each line of every document, counted in one encoding of the whole text."""
    return token_counts.section_tokens(_table(spark, sf_dir, "documents")).withColumn("n_tokens", F.col("n_tokens").cast("long"))


@_query("op8_mix_sources", mixing.mix_sql())
def op8(spark, sf_dir):
    """How often each document is taken so that every source comes near its target."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


@_query("op4_warc")
def op4(spark, sf_dir):
    """Pages written as archives and read back, record by record."""
    records = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")), payloads=False)
    number = lambda c: F.substring(c, len(warc.ID) + 1, 20).try_cast("long")
    faulty = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("record: "), F.col("error"))))
    return records.select(
        number(F.col("record_id")).alias("page_id"), F.coalesce(faulty.cast("long"), F.col("payload_bytes")).alias("payload_bytes"),
        "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))


@_query("op7_pii")
def op7(spark, sf_dir):
    """Personal data in every whole text."""
    return pii.personal_data(_table(spark, sf_dir, "documents"))


@_query("op9_training_order")
def op9(spark, sf_dir):
    """Documents as byte tokens in training order: every slot of the shards, read back."""
    docs = _table(spark, sf_dir, "documents")
    slots = ordering.read_slots(ordering.materialise(docs, F.col("text").cast("binary"), b"\xff"))
    return slots.select("slot", "sequence", "shard", "byte_offset", F.octet_length("ids").cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"))


@_query("op2_ngram_jaccard", ngram_join.jaccard_sql())
def op2(spark, sf_dir):
    """Components of documents that share four fifths of their five-word shingles."""
    return ngram_join.jaccard_components(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@_query("op6_line_dedup", line_dedup.remove_repeated_sql())
def op6(spark, sf_dir):
    """Documents without the passages of two lines or more that an earlier document holds."""
    docs = line_dedup.remove_repeated(_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "text", "chunks_removed", "lines_removed")


@_query("op6_passage_dedup", line_dedup.remove_passages_sql())
def op6_passages(spark, sf_dir):
    """Documents without the passages of two lines or more that an earlier document holds, wherever a passage begins and ends."""
    docs = line_dedup.remove_passages(_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "text", "lines_removed")


@_query("op1_quality_rules")
def op1(spark, sf_dir):
    """Base rules and robust distances of every document."""
    return quality.judge(_table(spark, sf_dir, "documents"))


@_query("op3_lattice_near_dedup", lattice.near_duplicates_sql())
def op3(spark, sf_dir):
    """Embeddings of one label with a cosine of 0.93 or more: links, components and what to keep."""
    return lattice.near_duplicates(_table(spark, sf_dir, "embeddings"))


@_query("op11_importance_resampling", resampling.resample_sql())
def op11(spark, sf_dir):
    """A quarter of the documents with words enough, drawn towards the features of ``benchmark``."""
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@_query("op12_conversation_repair", conversation.repair_sql())
def op12(spark, sf_dir):
    """Conversations with damaged rows, and the cheapest edits that let their roles alternate again."""
    return conversation.repair_conversations(_table(spark, sf_dir, "conversations"))


@_query("op13_substring_dedup", recompression.remove_substrings_sql())
def op13(spark, sf_dir):
    """Documents without the words of passages of fifty words or more that an earlier document holds."""
    return recompression.remove_substrings(_table(spark, sf_dir, "documents")).drop("kept")
