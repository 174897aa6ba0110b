import random

import numpy as np
import pyarrow as pa
import pytest

from linkloom.llm import ngram_join
from tests.llm.helpers import WORD, awkward_docs, clashing

DOC = "doc_id long, text string"


def shingles(text, n=5):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def by_hand(docs, percent=80):
    """``[(id, text)]`` to the component of each id that is not null."""
    sets, up = [(i, shingles(t)) for i, t in docs if i is not None], {i: i for i, _ in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i, _ in sets}


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
    return words


def family(seed):
    """Chains of edits near the threshold, a passage that many share, short texts, equal texts and a large group."""
    rng, docs = random.Random(seed), []
    passage = [f"common{k}" for k in range(60)]
    for f in range(12):
        words = [f"f{f}w{rng.randrange(300)}" for _ in range(rng.randint(6, 120))]
        for _ in range(rng.randint(1, 8)):
            docs.append(" ".join(words))
            words = edited(rng, words, rng.randint(0, 3))
    for k in range(60):
        docs.append(" ".join([f"own{k}x{j}" for j in range(rng.randint(5, 150))] + passage))
    large = [f"large{k}" for k in range(100)]
    docs += [" ".join(edited(rng, large, rng.randint(0, 2))) for _ in range(60)]
    docs += ["a b", "A  B", "a b c", "", "x", " ".join(passage), " ".join([*passage, "one", "more"])]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(ngram_join, "PART_LEVEL", 3)  # so that columns are dealt over parts
    docs = family(seed)
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, DOC))
    want = by_hand(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == {i: (len(shingles(t)), want[i]) for i, t in docs}


def test_awkward_rows(spark):
    docs = clashing(awkward_docs(spark))
    got = ngram_join.jaccard_components(docs).collect()
    flat = [(r.doc_id, r.text) for r in docs.collect()]
    want = by_hand(flat)
    expected = [(i, len(shingles(t)), want.get(i)) for i, t in flat]
    order = lambda r: [(v is not None, v) for v in r]
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got], key=order) == sorted(expected, key=order)
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([i for i, t in flat if i is None or want[i] == i], key=str)
    assert ngram_join.jaccard_components(docs.limit(0)).count() == 0
    empty = ngram_join.jaccard_components(docs.filter("doc_id in (4, 6)")).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in empty) == [(4, 0, 4), (6, 0, 6)]


def test_sets(monkeypatch):
    texts = ["a b c d e f", None, "", "A b C d E F g", "\x0b", "one  two\n", "x " * 50, "é É K"]
    grams, at = ngram_join.ngram_sets(pa.array(texts))
    assert [b - a for a, b in zip(at[:-1], at[1:], strict=True)] == [len(shingles(t)) for t in texts]
    first, fourth = set(grams[at[0] : at[1]].tolist()), set(grams[at[3] : at[4]].tolist())
    assert first < fourth and (np.diff(grams[at[3] : at[4]].astype(object)) > 0).all()
    assert len(ngram_join.ngram_sets(pa.array([], pa.string()))[0]) == 0


def test_tasks_hold_a_bounded_number_of_ngrams(spark, monkeypatch):
    """Counts come in many packs and texts in small slices; what is found is the same."""
    base = [" ".join(f"w{i}_{k}" for k in range(60)) for i in range(12)]
    texts = [t + (" tail" if c else "") for t in base for c in range(9)] + ["", None, "a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(2)
    want = {i: (i // 9 * 9 if i < 108 else i) for i in range(len(texts))}
    monkeypatch.setattr(ngram_join, "PACK", 100)
    monkeypatch.setattr(ngram_join, "SLICE_BYTES", 600)
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs).collect()} == want


def near_misses(seed):
    """Groups of edited copies, most pairs of which stay just below the threshold, and repeated ids with other texts."""
    rng, docs = random.Random(seed), []
    for f, (size, words) in enumerate([(120, 150), (90, 60)]):
        base = [f"t{f}x{k}" for k in range(words)]
        spots = [rng.randrange(words) for _ in range(12)]
        for k in range(size):
            text = list(base)
            for _ in range(rng.randint(1, max(2, words // 40))):
                text[rng.choice(spots) if k % 3 == 0 else rng.randrange(words)] = f"e{rng.randrange(10**6) if k % 2 else f}"
            docs.append((1000 * f + (k if k % 10 else 0), " ".join(text)))
    rng.shuffle(docs)
    return docs


def test_groups_below_the_threshold(spark, monkeypatch):
    """A large group is settled by what its rows differ in; few pairs are left to verify."""
    verified, old = [], ngram_join._verified
    monkeypatch.setattr(ngram_join, "_verified", lambda texts, key, pairs, n, p: verified.append(pairs.count()) or old(texts, key, pairs, n, p))
    monkeypatch.setattr(ngram_join, "WIDE", 8)
    for seed in (1, 2):
        docs = near_misses(seed)
        verified.clear()
        got = ngram_join.jaccard_components(spark.createDataFrame(docs, DOC)).collect()
        want = by_hand(docs)
        assert {(r.doc_id, r.component_id) for r in got} == set(want.items())
        assert sum(verified) < 210 * 10


def test_equal_sets_are_one_class_wherever_they_stand(spark):
    """A set's digest does not depend on the texts before it in the slice."""
    docs = [(k, f"own{k} " * 7 + " ".join(f"w{k}_{j}" for j in range(50)) if k % 2 else "the same words in every second text of all") for k in range(40)]
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, DOC).coalesce(1)).collect()
    assert {r.doc_id: r.class_id for r in got} == {k: k if k % 2 else 0 for k in range(40)}


def test_dense_groups_and_passages(spark, monkeypatch):
    """Of a group where most texts link, few pairs are made; rows near the reference are of one class before. Parts of the text stand in the same columns."""
    rng, docs = random.Random(3), []
    base = [f"t{k}" for k in range(200)]
    spots = [10 * k for k in range(20)]
    for k in range(150):
        text = list(base)
        for spot in rng.sample(spots, 10):
            text[spot] = f"e{spot}"
        docs.append((k, " ".join(text if k % 3 else text[: rng.choice([60, 80, 100, 150])])))
    docs += [(1000 + k, " ".join([*base[:40], f"own{k}", *[f"x{k}_{j}" for j in range(3)]])) for k in range(30)]
    rng.shuffle(docs)
    made, old = [], ngram_join._by_differences

    def counted(*args):
        out = old(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "_by_differences", counted)
    monkeypatch.setattr(ngram_join, "WIDE", 8)
    got = ngram_join.jaccard_components(spark.createDataFrame(docs, DOC)).collect()
    assert {r.doc_id: r.component_id for r in got} == by_hand(docs)
    assert made and made[0] < 3 * len(docs)


@pytest.mark.parametrize("percent", [50, 80, 99, 100])
def test_sizes_that_may_link_share_a_window(spark, percent):
    sizes = [1, 2, 4, 5, 8, 16, 32, 64, 80, 99, 100, 125, 1000, 1250, 12500]
    rows = ngram_join._size_windows(spark.createDataFrame([(n,) for n in sizes], "n long"), percent).collect()
    wins = {n: {r.win for r in rows if r.n == n} for n in sizes}
    assert all(wins[a] & wins[b] for a in sizes for b in sizes if 100 * a >= percent * b and a <= b)
