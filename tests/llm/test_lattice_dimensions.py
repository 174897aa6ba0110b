import numpy as np
import pytest

from linkloom.llm import lattice
from tests.llm.test_lattice import VEC, by_hand


def pairs(dim, n, cosine):
    """Unit vectors in random directions, and one at the given cosine to each."""
    rng = np.random.default_rng(3)
    x, z = rng.normal(size=(2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z -= (z * x).sum(1, keepdims=True) * x
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    return x, cosine * x + np.sqrt(1 - cosine**2) * z


@pytest.mark.parametrize("dim", [8, 16, 32, 64, 384])
def test_recall_and_chance_meetings(dim):
    x, y = pairs(dim, 2000, 0.9301)
    a, b = lattice.cells_of(x), lattice.cells_of(y)
    meet = lambda p, q: (p[:, :, :1] == q) | (q[:, :, :1] == p)
    assert meet(a, b).any(axis=(1, 2)).mean() > 0.99
    assert meet(a, np.roll(a, 1, axis=0)).any(axis=2).mean() < 0.05  # random vectors, per table


def test_short_vectors_link(spark):
    x, y = pairs(8, 60, 0.94)
    data = [(i, [float(np.float32(c)) for c in v], i // 2) for i, v in enumerate(v for p in zip(x, y, strict=True) for v in p)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in lattice.near_duplicates(spark.createDataFrame(data, VEC)).collect()}
    want = by_hand(data)
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want) and sum(n for n, *_ in want.values()) == 120
