"""Clusters kept up to date against resolving everything anew."""

import random

import pytest

from linkloom.operators import incremental as I
from linkloom.operators import resolve as R
from linkloom.operators.matching import MatchConfig, Rule

SCHEMA = "entity_type string, entity_key string, source_db string, id_type string, id_value string, n long"
RULES = MatchConfig((Rule("a", 1, 0.5), Rule("b", 1, 0.5), Rule("c", 2, 1), Rule("d", 0.5, 0, absolute=False)), threshold=1.5, hmdb_type=None)
STRICT = MatchConfig((Rule("a", 1, 1), Rule("b", 1, 1), Rule("c", 1, 1), Rule("d", 1, 1)), threshold=2, hmdb_type=None)


def made(spark, seed, n=60, values=12):
    rnd = random.Random(seed)
    rows = [("compound", f"e{i:03d}", "x", t, f"v{rnd.randrange(values) if rnd.random() < 0.8 else 0}", 1)
            for i in range(n) for t in "abcd" for _ in range(rnd.randrange(3))]
    return spark.createDataFrame(rows, SCHEMA)


def as_dict(df):
    got = [tuple(r) for r in df.select("entity_key", "cluster_key").collect()]
    assert len(got) == len(dict(got))
    return dict(got)


@pytest.mark.parametrize("seed, rules", [(1, RULES)])
def test_batches_equal_one_resolution(spark, seed, rules):
    x = made(spark, seed)
    store = I.empty(spark)
    for part in ("rlike '[0-5]$'", "rlike 'never'", "rlike '[6-9]$'"):
        store = I.insert(store, x.filter(f"entity_key {part}"), rules)
    assert as_dict(store.cluster) == as_dict(R.clusters(x, rules))


@pytest.mark.parametrize("seed, rules", [(4, STRICT)])
def test_removal_splits_and_joins(spark, seed, rules, tmp_path):
    x = made(spark, seed)
    I.insert(I.empty(spark), x, rules).save(f"{tmp_path}/store")
    store = I.load(spark, f"{tmp_path}/store")
    before = as_dict(store.cluster)
    after, left = I.remove(store, x, x.filter("(id_type = 'c' and id_value = 'v0') or entity_key = 'e007'"), rules)
    want = as_dict(R.clusters(left, rules))
    assert as_dict(after.cluster) == want and "e007" not in want
    assert any(before[k] != v for k, v in want.items())


def test_a_record_that_changes(spark):
    row = lambda e, t, v: ("compound", e, "x", t, v, 1)
    x = spark.createDataFrame([row("m", "a", "1"), row("m", "b", "1"), row("k", "a", "1"), row("k", "b", "1"), row("z", "a", "9"), row("z", "b", "9")], SCHEMA)
    store = I.insert(I.empty(spark), x, STRICT)
    assert as_dict(store.cluster) == {"k": "k", "m": "k", "z": "z"}
    new = spark.createDataFrame([row("k", "a", "9"), row("k", "b", "9"), row("b", "a", "1"), row("b", "b", "1")], SCHEMA)
    store = I.change(store, spark.createDataFrame([("k",)], "entity_key string"), new, STRICT)
    assert as_dict(store.cluster) == {"k": "k", "z": "k", "m": "b", "b": "b"}


def test_stored_rows_that_are_looked_at_follow_the_batch(spark):
    """A value that all stored entities hold brings one of each cluster and set of types, not all of them."""
    row = lambda e, t, v: ("compound", e, "x", t, v, 1)
    x = spark.createDataFrame([row(f"s{i}", t, v) for i in range(500) for t, v in (("a", "hot"), ("b", f"own{i // 100}"))], SCHEMA)
    store = I.insert(I.empty(spark), x, STRICT)
    assert len(set(as_dict(store.cluster).values())) == 5
    batch = spark.createDataFrame([row("n1", "a", "hot"), row("n1", "b", "own3"), row("n2", "a", "cold")], SCHEMA)
    standing, clusters = I._standing(store, I.features(batch, STRICT), STRICT)
    assert clusters.count() == 5 and standing.count() == 10
    before, after = as_dict(store.cluster), as_dict(I.insert(store, batch, STRICT).cluster)
    assert {k for k, v in after.items() if v == after["n1"]} == {"n1"} | {k for k, v in before.items() if v == before["s300"]} and after["n2"] == "n2"
