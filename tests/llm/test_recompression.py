import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from linkloom.llm import recompression as r
from tests.llm.helpers import awkward, awkward_docs, clashing, rows

COLS = ("doc_id", "n_words", "n_removed", "kept", "kept_sha256")


def brute(docs, window=50):
    words = [(i, (t or "").encode().split()) for i, t in docs]
    least = {}
    for i, w in words:
        for p in range(len(w) - window + 1):
            k = tuple(w[p : p + window])
            least[k] = min(least.get(k, (True, 0)), (i is None, i or 0))
    out = []
    for i, w in words:
        gone = set()
        for p in range(len(w) - window + 1):
            if least[tuple(w[p : p + window])] < (i is None, i or 0):
                gone |= set(range(p, p + window))
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), kept.decode(), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=lambda x: [(v is not None, v) for v in x])


def made(seed, n=150, window=50):
    """Documents of random words, common passages at random places, runs, periods, copies, near copies and repeated ids."""
    rnd = random.Random(seed)
    word = lambda: f"w{rnd.randrange(400)}"
    shared = [[word() for _ in range(rnd.choice([window - 1, window, window + 1, 2 * window, 90]))] for _ in range(6)]
    shared += [["ha"] * (3 * window), ["a", "b"] * window, ["a", "a", "b"] * window, ["x"] * window]
    docs = []
    for i in range(n):
        w = []
        for _ in range(rnd.randrange(4)):
            w += [word() for _ in range(rnd.randrange(80))] + rnd.choice(shared)[rnd.randrange(2) * rnd.randrange(20) :]
        if docs and rnd.random() < 0.3:
            w = rnd.choice(docs)[1].split()
            for _ in range(rnd.randrange(3)):
                if w:
                    w[rnd.randrange(len(w))] = word()
        docs.append((rnd.choice([i, i, i, i, rnd.randrange(n), None]), rnd.choice([" ", "\n", "\t "]).join(w)))
    return docs


@pytest.mark.parametrize("seed, window, rounds", [(1, 50, 3), (2, 50, 1), (3, 10, 2), (4, 20, 4), (5, 1, 1)])
def test_against_all_windows(spark, seed, window, rounds):
    docs = made(seed, window=window)
    got = rows(r.remove_substrings(spark.createDataFrame(docs, "doc_id long, text string").repartition(7), window=window, rounds=rounds), *COLS)
    assert got == brute(docs, window)


def test_odd_rows(spark):
    want = brute([(x[0], x[1]) for x in awkward()], 5)
    assert rows(r.remove_substrings(clashing(awkward_docs(spark)), window=5), *COLS) == want
    assert r.remove_substrings(awkward_docs(spark).limit(0)).count() == 0


def test_a_large_group_of_copies(spark):
    text = " ".join(f"c{i}" for i in range(120))
    docs = [(i, text) for i in range(3000)] + [(i, f"u{i} " * 30 + text + f" v{i}" * 60) for i in range(3000, 3300)]
    assert rows(r.remove_substrings(spark.createDataFrame(docs, "doc_id long, text string")), *COLS) == brute(docs)


def test_equal_windows_have_equal_anchors():
    rnd = random.Random(3)
    for symbols in (2, 3, 50, 1000):
        core = [f"s{rnd.randrange(symbols)}" for _ in range(300)]
        texts = [" ".join([f"s{rnd.randrange(symbols)}" for _ in range(rnd.randrange(60))] + core + [f"s{rnd.randrange(symbols)}" for _ in range(rnd.randrange(60))]) for _ in range(20)]
        names, at = r.word_names(pa.array(texts))
        with np.errstate(over="ignore"):
            doc, x, lo, hi = r.anchors(names, at)
        found = {}
        for d, a, s, e in zip(doc.tolist(), x.tolist(), lo.tolist(), hi.tolist()):
            for p in range(s, e + 1):
                found.setdefault(names[p : p + 50].tobytes(), set()).add(a)
        assert len(found) == len({names[p : p + 50].tobytes() for a, b in zip(at, at[1:]) for p in range(a, b - 49)})
        assert all(len(a) == 1 for a in found.values())


def test_very_long_texts(spark):
    docs = [(1, " ".join(f"w{i % 65_537}" for i in range(300_000))), (2, "ha " * 300_000), (3, "ha " * 1000 + "end"), (4, "x" * 2_000_000)]
    got = {x.doc_id: (x.n_words, x.n_removed) for x in r.remove_substrings(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {1: (300_000, 0), 2: (300_000, 0), 3: (1001, 1000), 4: (1, 0)}
