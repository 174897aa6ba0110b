"""A training corpus from raw documents; each stage works on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.llm import bpe, line_dedup, mixing, ngram_join, quality
from linkloom.session import cut


def quality_rules(spark, docs, sf_dir):
    """Documents that pass the base rules and lie near those of their language and source."""
    return quality.keep_good(docs)


def dedup_lines(spark, docs, sf_dir):
    """Passages that an earlier document holds are cut from the texts; ``n_chars`` follows. A document that loses all its words goes."""
    cleaned = line_dedup.remove_repeated(docs)
    cleaned = cleaned.filter((F.col("lines_removed") == 0) | F.col("text").rlike(line_dedup.WORD))
    chars = F.when(F.col("lines_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", chars).select(*docs.columns)


def dedup_documents(spark, docs, sf_dir):
    """One document, that of the smallest id, of each group linked by shared five-word shingles."""
    return ngram_join.keep_first(docs)


def mix_sources(spark, docs, sf_dir):
    """Documents as often as the mix of their source takes them."""
    return mixing.expand_copies(mixing.mix(docs))


def encode(spark, docs, sf_dir):
    """Token ids of every document, with digests of the ids and of the bytes they decode to."""
    return bpe.encode_texts(docs, ["n_tokens", "ids_sha256", "decoded_sha256"])


STAGES = [("quality rules", quality_rules), ("line dedup", dedup_lines), ("n-gram Jaccard join", dedup_documents),
          ("mixing sources", mix_sources), ("byte-level BPE", encode)]

ORACLE_SQL = None  # the merges of the byte-level encoding are no SQL; tests hold the stages against brute force


def run(spark, sf_dir):
    """All stages over ``documents``; each stage's result is written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
