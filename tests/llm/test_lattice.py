import itertools

import numpy as np
import pytest

from linkloom.llm import lattice
from tests.llm.helpers import clashing, rows

VEC = "vec_id long, embedding array<float>, label int"


def test_decoder_finds_the_nearest_point():
    rng = np.random.default_rng(0)
    x = rng.normal(scale=1.3, size=(60, 8))
    best, other = lattice.nearest_e8(x)
    for row, b, o in zip(x, best, other, strict=True):
        near = []
        for half in (0.0, 0.5):
            corners = np.floor(row - half) + np.array(list(itertools.product((0, 1), repeat=8)))  # of the unit cube around the row
            near.append(((corners[corners.sum(axis=1) % 2 == 0] + half - row) ** 2).sum(axis=1).min())
        mine = [((v / 2 - row) ** 2).sum() for v in (b, o)]
        assert mine == pytest.approx(sorted(near))
        for v in (b, o):
            assert (v % 2 == v[0] % 2).all() and v.sum() % 4 == 0


def clusters(seed, n, dim=64, spread=(0.01, 0.05, 0.12)):
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        c = rng.normal(size=dim)
        for s in spread[: 1 + k % 3]:
            out += [c + s * rng.normal(size=dim) * np.linalg.norm(c) / 8 * 3 for _ in range(k % 4)]
        out.append(c)
    return out


def by_hand(vectors, threshold=0.93):
    n, up = {}, {i: i for i, *_ in vectors}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    good = [(i, np.array(v, float), l) for i, v, l in vectors if l is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    n = {i: 0 for i, *_ in vectors}
    for k, (i, a, l) in enumerate(good):
        for j, b, m in good[:k]:
            if l == m and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= threshold:
                n[i] += 1
                n[j] += 1
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    return {i: (n[i], find(i), find(i) == i) for i in n}


@pytest.mark.parametrize(("seed", "part"), [(1, 1024), (2, 4)])
def test_against_brute_force(spark, seed, part, monkeypatch):
    monkeypatch.setattr(lattice, "PART", part)
    data = [(i, [float(np.float32(x)) for x in v], i % 2) for i, v in enumerate(clusters(seed, 40))]
    big = np.random.default_rng(9).normal(size=64)
    data += [(1000 + i, [float(np.float32(x)) for x in big + 0.05 * np.random.default_rng(i).normal(size=64)], 1) for i in range(40)]
    data += [(2000 + i, data[3][1], data[3][2]) for i in range(5)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(spark.createDataFrame(data, VEC)).collect()}
    want = by_hand(data)
    links = sum(n for n, *_ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want)  # nothing below the threshold
    assert sum(n for n, *_ in got.values()) >= 0.99 * links > 0
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)


def test_recall_at_the_threshold():
    rng, n = np.random.default_rng(3), 2000
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=(n, 64))
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    a, b = lattice.cells_of(x), lattice.cells_of(0.93 * x + np.sqrt(1 - 0.93**2) * z)
    meet = ((a[:, :, :1] == b) | (b[:, :, :1] == a)).any(axis=(1, 2))
    assert meet.mean() > 0.99


def test_awkward_vectors(spark):
    v = [1.0, 2.0] + [0.5] * 14
    data = [(1, v, 0), (2, v, 0), (3, [2 * x for x in v], 0), (4, v, None), (5, v, 1), (6, None, 0), (7, [], 0), (8, [0.0] * 16, 0), (9, [float("nan")] * 16, 0),
            (10, [float("inf"), *v[1:]], 0), (11, [None, *v[1:]], 0), (12, v[:15], 0), (13, [-x for x in v], 0), (14, [1e-30 * x for x in v], 0), (15, [1e30 * x for x in v], 0)]
    want = by_hand(data)
    df = clashing(spark.createDataFrame([*data, (None, v, 0)], VEC))
    got = rows(lattice.near_duplicates(df), "vec_id", "n_links", "component_id", "kept")
    assert got[0] == (None, 0, None, False)
    assert {r[0]: r[1:] for r in got[1:]} == want
    assert lattice.near_duplicates(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(1, v, 0), (1, v, 0), (2, v, 0)], VEC)
    assert rows(lattice.near_duplicates(twice), "vec_id", "component_id") == [(1, 1), (1, 1), (2, 1)]
