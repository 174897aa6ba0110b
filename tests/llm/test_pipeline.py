import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from linkloom.llm import bpe, mixing, quality
from tests.llm import test_line_dedup, test_ngram_join
from tests.llm.helpers import SF, WORD, awkward_docs, duck, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def pairs(df):
    return [tuple(r) for r in df.select("doc_id", "text").collect()]


def test_each_stage_against_brute_force(spark):
    """Every stage on what the one before it kept, held against a plain version of itself."""
    docs, stages = table(spark, "documents"), dict(corpus_pipeline.STAGES)
    assert list(stages) == [n for n, _ in corpus_pipeline.STAGES] and len(stages) == 5
    quality_rules, dedup_lines, dedup_documents, mix_sources, encode = stages.values()

    kept = spark.createDataFrame(quality_rules(spark, docs, SF).collect(), docs.schema)
    verdict = {r.doc_id for r in quality.judge(docs).collect() if r.kept}
    assert kept.columns == COLUMNS and {r.doc_id for r in kept.collect()} == verdict and kept.count() == len(verdict)

    lines = spark.createDataFrame(dedup_lines(spark, kept, SF).collect(), docs.schema)
    want = test_line_dedup.by_hand(pairs(kept))
    emptied = {i for i, (t, *_) in want.items() if want[i][2] and not WORD.search(t)}
    assert dict(pairs(lines)) == {i: t for i, (t, *_) in want.items() if i not in emptied}
    assert all(r.n_chars == len(r.text) for r in lines.collect() if want[r.doc_id][2])

    single = spark.createDataFrame(dedup_documents(spark, lines, SF).collect(), docs.schema)
    comp = test_ngram_join.by_hand(pairs(lines))
    assert sorted(pairs(single)) == sorted((i, t) for i, t in pairs(lines) if comp[i] == i)

    mixed = spark.createDataFrame(mix_sources(spark, single, SF).collect(), docs.schema)
    copies = duck(f"SELECT doc_id, copies FROM ({mixing.mix_sql()})", documents=single.toPandas())
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(i for i, n in copies for _ in range(n))

    enc = bpe.Encoder(bpe.vocabulary_path())
    ids = lambda t: np.array(enc.tiktoken.encode_ordinary(t or ""), dtype="<u4").tobytes()
    last = sorted(tuple(r) for r in encode(spark, mixed, SF).collect())
    assert last == sorted((i, len(ids(t)) // 4, hashlib.sha256(ids(t)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in pairs(mixed))
    assert last == sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).collect())


def test_awkward_rows_pass_every_stage(spark):
    docs = awkward_docs(spark).withColumn("gone", F.lit("x"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0
        assert stage(spark, docs, SF).count() >= 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns


def test_emptied_copies_leave_with_the_line_stage(spark):
    """Of a large group of copies one text goes on; rows that had no words, and rows that keep a word, stay."""
    texts = ("\n".join(f"line {i} has words {i * 7 + k}" for i in range(12)) for k in range(10_000))
    text = next(t for t in texts if not test_line_dedup.by_hand([(0, t), (1, t)])[1][0])  # no chunk of a single line in it
    rows = [(i, text, "en", "a", len(text)) for i in range(2000)] + [(3000, "", "en", "a", 0), (3001, None, "en", "a", None), (3002, "own words\n" + text, "en", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["line dedup"](spark, docs, SF).collect()}
    assert set(got) == {0, 3000, 3001, 3002} and got[0] == text and got[3000] == "" and got[3001] is None and "own words" in got[3002]
