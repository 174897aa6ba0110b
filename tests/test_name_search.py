"""Name search against a plain substring test, over every kind of query."""

import random

from linkloom.operators.lookup import contains_search, name_search


def test_contains_equals_brute_force(spark):
    rnd = random.Random(5)
    words = ["ab", "Ba", "a", "é日", "日本語", "xyzzy", "", "b" * 9, "tail"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))).lower() for _ in range(120)]
    texts += ["x" * 300, "ab" * 200, "日本語" * 40, "line one\nline two\tand three", "same", "same"]
    names = [(f"e{i}", t) for i, t in enumerate(texts)] + [("e0", "a second name of e0"), ("null", None)]
    queries = {"", "a", "日", "b ", "aba", "e d", "line two\tand", "x" * 50, "x" * 301, "abab" * 9, "日本語日本", "no such text at all in here", "second name of", "a second name of e0 and more"}
    for t in rnd.sample(texts, 60):
        if t:
            i = rnd.randrange(len(t))
            queries.add(t[i:i + rnd.choice([1, 2, 3, 5, 9, 20, 60, 400])])
    q = [(x,) for x in queries] + [("a",), (None,)]
    got = contains_search(spark.createDataFrame(q, "query string"), spark.createDataFrame(names, "entity_key string, name string"))
    want = sorted({(x, k) for x in queries if x for k, t in names if t is not None and x in t})
    assert sorted(map(tuple, got.collect())) == want


def test_exact_names_come_first(spark):
    names = spark.createDataFrame([("c2", "Red Rod"), ("c1", "red rod"), ("c3", "old red rod of the north"), ("c4", None)], "entity_key string, name string")
    queries = spark.createDataFrame([("RED ROD",), ("ed ro",), ("nothing",), (None,), ("",)], "query string")
    assert sorted(map(tuple, name_search(queries, names).collect())) == [
        ("RED ROD", "c1", "exact"), ("ed ro", "c1", "contains"), ("ed ro", "c2", "contains"), ("ed ro", "c3", "contains")]


def test_nothing_to_search(spark):
    none = spark.createDataFrame([], "query string")
    assert name_search(none, spark.createDataFrame([], "entity_key string, name string")).count() == 0
    assert contains_search(none, spark.createDataFrame([("a", "b")], "entity_key string, name string")).count() == 0
