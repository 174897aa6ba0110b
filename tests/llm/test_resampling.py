import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from linkloom.llm import resampling
from tests.llm.helpers import LONG, awkward, awkward_docs, clashing, rows, table

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def features(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def brute(docs, target, percent=25, least=20):
    made = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in made for b in f), Counter(b for x in target for b in features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for i, n, f in made:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2], r[3]))
    for k, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=lambda r: [(v is not None, v) for v in r])


COLS = ("doc_id", "n_words", "n_features", "weight", "score", "rank")


def test_odd_rows_and_ties(spark):
    target = spark.createDataFrame([("w1x1 w2x2 Seven EIGHT",), (None,), ("",), ("日本 é",)], "text string")
    docs = awkward_docs(spark)
    want = brute([(r[0], r[1]) for r in awkward()], ["w1x1 w2x2 Seven EIGHT", None, "", "日本 é"], percent=70, least=4)
    assert rows(resampling.resample(clashing(docs), target, percent=70, least_words=4), *COLS) == want


def test_empty_tables(spark):
    docs = awkward_docs(spark)
    assert resampling.resample(docs.limit(0), docs).count() == 0
    got = rows(resampling.resample(docs, docs.limit(0)), *COLS)
    assert got == brute([(r[0], r[1]) for r in awkward()], [])


def test_repeated_rows_share_a_score(spark):
    docs = spark.createDataFrame([(1, LONG)] * 40 + [(None, LONG)] * 40 + [(i, "a b c d e f") for i in range(40)], "doc_id long, text string")
    got = rows(resampling.resample(docs, docs, percent=50, least_words=5), *COLS)
    assert got == brute([(1, LONG)] * 40 + [(None, LONG)] * 40 + [(i, "a b c d e f") for i in range(40)], [LONG] * 80 + ["a b c d e f"] * 40, 50, 5)


def test_whole_table(spark):
    docs, target = table(spark, "documents"), table(spark, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [r.text for r in target.collect()])
    assert rows(resampling.resample(docs, target), *COLS) == want


@pytest.mark.parametrize("text", ["a" * 100_000, " " * 100_000, "ab, " * 30_000, "日本" * 20_000 + " x", "A-B" * 20_000, "x" * 16384 + " y" + "z" * 16384])
def test_pieces_end_between_words(text):
    n, buckets = resampling.feature_buckets(text)
    want, cells = features(text)
    assert n == want and sorted(buckets.tolist()) == sorted(cells)
    low = text.translate(resampling._LOWER)
    assert all(low[a:b] == w for w, (a, b) in resampling.word_offsets(low))
