import pytest
from pyspark.sql import functions as F

from linkloom.llm import mixing
from tests.llm.helpers import SCHEMA, WORD, awkward, awkward_docs, clashing, duck, rows, table

COLS = ("doc_id", "size", "source_size", "target", "taken", "copies")


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Shares by weight; what exceeds the limit is shared again, round by round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, left, budget = {}, list(order), share * sum(sizes.values())
    while left:
        level = budget / sum(w[s] for s in left)
        full = [s for s in left if w[s] * level > most * sizes[s]]
        if not full:
            return out | {s: w[s] * level for s in left}
        for s in full:
            out[s] = float(most * sizes[s])
            budget -= out[s]
            left.remove(s)
    return out


def hold(docs, mixed):
    sizes, seen = {}, {}
    got = mixed.collect()
    assert len(got) == docs.count()
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        assert r.size == len(WORD.findall(r.text or "")) and 0 <= r.copies <= 2 and r.taken == r.size * r.copies
        seen.setdefault((r.doc_id, r.text, r.source), set()).add(r.copies)
    assert all(len(v) == 1 for v in seen.values())
    want = targets(sizes)
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    return sizes, want, got


def test_sources_come_near_their_targets(spark):
    docs = table(spark, "documents")
    sizes, want, got = hold(docs, mixing.mix(docs))
    for s in sizes:
        taken = sum(r.taken for r in got if r.source == s)
        assert abs(taken - want[s]) <= max(r.size for r in got if r.source == s)


def test_reruns_and_partitionings_agree(spark):
    docs = table(spark, "documents")
    one = rows(mixing.mix(docs), *COLS)
    assert one == rows(mixing.mix(docs.repartition(13, F.rand(3))), *COLS)


def test_inclusion_follows_expectation(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40 + 1).cast("int")).alias("text"),
                                    F.when(F.col("id") < 3000, "a").otherwise("b").alias("source"))
    got = mixing.mix(docs, weights=(1, 3), share=0.5).collect()
    a = [r for r in got if r.source == "a"]
    mean = lambda lo, hi: sum(r.copies for r in a if lo <= r.size <= hi) / sum(lo <= r.size <= hi for r in a)
    assert 0 < mean(1, 4) < mean(37, 40) <= 2  # the measure grows with the square root of the size
    assert mean(37, 40) / mean(9, 10) == pytest.approx(2, rel=0.3)


def test_awkward_rows_equal_sql(spark):
    docs = clashing(awkward_docs(spark))
    mixed = mixing.mix(docs)
    hold(docs, mixed)
    assert mixing.mix(docs.limit(0)).count() == 0 and [c for c in docs.columns if c not in ("size", "taken")] == mixed.columns[:-5]
    import pandas as pd

    frame = pd.DataFrame(awkward(), columns=[c.split()[0] for c in SCHEMA.split(", ")])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    sql = f"SELECT doc_id, size, source_size, target, taken, copies FROM ({mixing.mix_sql()})"
    key = lambda r: [(v is not None, v) for v in r]
    assert rows(mixed, *COLS) == sorted(duck(sql, documents=frame), key=key)


def test_copies_become_rows(spark):
    docs = awkward_docs(spark)
    mixed = mixing.mix(docs)
    out = mixing.expand_copies(mixed)
    assert out.columns == docs.columns and out.count() == mixed.agg(F.sum("copies")).first()[0]


def test_no_words_at_all(spark):
    docs = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in mixing.mix(docs).collect()} == {(0.0, 0)}
