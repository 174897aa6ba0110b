import json
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from linkloom.llm import quality
from tests.llm.helpers import WORD, awkward_docs, clashing, rows, table

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base(text):
    words = WORD.findall(text or "")
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {i + k for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for k in range(5)}
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, dup, len(hit), len(words) < 10 or 100 * len(hit) > 20 * len(words)


def vector(b):
    n = max(b[0], 1)
    v = [math.log(n), math.log((b[1] + 1) / n), math.log1p(b[2] * 100 / n), math.log1p(b[3]), math.log1p(b[4] * 100 / n)]
    return [math.floor(x * quality.SCALE + 0.5) / quality.SCALE for x in v]


def middle(v):
    return np.sort(v)[math.ceil(len(v) / 2) - 1]


def shape(x, factor):
    return x.mean(0), np.cov(x.T, bias=True).reshape(quality.DIMS, quality.DIMS) * factor + np.diag(np.square(quality.FLOORS))


def distance(x, m, c):
    return np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)


def nearest(x, d):
    bucket = np.floor(np.log2(d + 1e-3) * 16)
    limit = np.sort(bucket)[math.ceil(len(d) * quality.H) - 1]
    return x[bucket <= limit]


def robust(x):
    med = np.array([middle(x[:, j]) for j in range(quality.DIMS)])
    dev = np.array([middle(np.abs(x[:, j] - med[j])) for j in range(quality.DIMS)])
    z = np.abs(x - med) / np.maximum(1.4826 * dev, quality.FLOORS)
    found = []
    for s, d in enumerate([(z**2).sum(1), z.max(1) ** 2, z.sum(1) ** 2]):
        m, c = shape(nearest(x, d), quality.CONSISTENT_H)
        for _ in range(quality.STEPS):
            m, c = shape(nearest(x, distance(x, m, c)), quality.CONSISTENT_H)
        found.append((np.linalg.slogdet(c)[1], s, m, c))
    _, _, m, c = min(found, key=lambda f: (round(f[0], 9), f[1]))
    return shape(x[distance(x, m, c) <= quality.REWEIGHT], quality.CONSISTENT_REWEIGHT)


def by_hand(docs):
    bases = [base(t) for _, t, _, _ in docs]
    x = np.array([vector(b) for b in bases])
    groups = defaultdict(list)
    for i, (_, _, lang, source) in enumerate(docs):
        groups[lang, source].append(i)
    me, ce = robust(x)
    far = np.zeros(len(docs))
    for at in groups.values():
        m, c = robust(x[at])
        w = len(at) / (len(at) + quality.PRIOR)
        gap = m - me
        far[at] = distance(x[at], w * m + (1 - w) * me, w * c + (1 - w) * ce + w * (1 - w) * np.outer(gap, gap))
    return bases, far


def test_whole_table_against_numpy(spark):
    docs = table(spark, "documents")
    flat = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    bases, far = by_hand(flat)
    got = {r.doc_id: r for r in quality.judge(docs).collect()}
    for (i, *_), b, d in zip(flat, bases, far, strict=True):
        r = got[i]
        assert tuple(r[c] for c in BASE) == b
        assert r.distance == pytest.approx(d, rel=1e-4, abs=1e-4)
        assert r.kept == (not b[-1] and d <= quality.CUTOFF) or abs(d - quality.CUTOFF) < 1e-3


def test_order_does_not_matter(spark):
    docs = table(spark, "documents")
    one = rows(quality.judge(docs), "doc_id", *BASE, "kept", "distance")
    assert one == rows(quality.judge(docs.repartition(11, F.rand(5))), "doc_id", *BASE, "kept", "distance")


def test_outliers_go_and_the_bulk_stays(spark):
    rng = np.random.default_rng(1)
    plain = lambda i: " ".join("abcdefghij"[: rng.integers(2, 9)] + str(rng.integers(10**6)) for _ in range(int(rng.lognormal(5, 0.8)) + 12))
    docs = [(i, plain(i), "en", "a" if i % 3 else "b") for i in range(600)]
    bad = [(1000 + i, "## $$ ** ".join(f"word{i * 50 + k}" for k in range(50)), "en", "a") for i in range(60)]
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(docs + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i, *_ in docs) and not any(got[i] for i, *_ in bad)


def test_repeated_windows_by_hand(spark):
    texts = ["a b c d e a b c d e", "a a a a a a", "a b c d", "a b c d e", "x a b c d e y a b c d e z", "a b c d e f a b c d e f a", None, "", "é 日 é 日 é 日 é 日 é"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("*", "null as lang", "'s' as source")
    got = {r.doc_id: tuple(r[c] for c in BASE) for r in quality.judge(docs).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}


def test_awkward_rows(spark):
    docs = clashing(awkward_docs(spark))
    got = quality.judge(docs)
    texts = [r.text for r in docs.select("text").collect()]
    assert sorted(tuple(r[c] for c in BASE) for r in got.collect()) == sorted(map(base, texts))
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and good.count() == got.filter("kept").count()
    assert quality.judge(docs.limit(0)).count() == 0 and quality.keep_good(docs.limit(0)).count() == 0


def test_plan_is_native(spark):
    plan = json.dumps(quality.judge(table(spark, "documents"))._jdf.queryExecution().toString())
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
