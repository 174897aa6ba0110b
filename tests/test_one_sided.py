"""Reactions with one side only: formatting, parsing and alignment, alone and over the whole tables."""

import pytest
from pyspark.sql import functions as F

from linkloom.catalog import QUERIES, SQL
from linkloom.functions import equations as E
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"


def test_empty_side_is_an_empty_list(spark):
    texts = ["2 A + B => ", " => C", "2 A + B =>", "=> C", " <=> ", "A => B", "A + B"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] and [(p.side, p.pos, p.stoich, p.name) for p in r[0]] if r[0] is not None else None for r in df.select(E.parse_equation("t")).collect()]
    left, right = [("left", 0, 2, "A"), ("left", 1, 1, "B")], [("right", 0, 1, "C")]
    assert got == [left, right, left, right, [], [("left", 0, 1, "A"), ("right", 0, 1, "B")], None]
    sides = [(r.s.left, r.s.right) for r in df.limit(2).select(E.equation_sides("t").alias("s")).collect()]
    assert sides == [(["2 A", "B"], []), ([], ["C"])]
    again = df.limit(2).select(E.format_equation(E.parse_equation("t"), F.lit("=>")).alias("e")).collect()
    assert [r.e for r in again] == ["2 A + 1 B => ", " => 1 C"]


@pytest.mark.parametrize("name", ["equation_build_one_sided", "equation_parse_one_sided", "equation_align_one_sided"])
def test_whole_tables(spark, name):
    ok, message = compare(spark, connect(SF), name, QUERIES[name], SQL[name], SF)
    assert ok, message
    keys = lambda n: {r[0] for r in QUERIES[n](spark, SF).select("reaction_key").distinct().collect()}
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey").distinct().collect()
    assert keys(name) == keys("equation_build") == {f"R{r[0]}" for r in lines}


def test_signs_at_the_edge_in_every_spelling(spark):
    signs = {" -> ": "=>", " → ": "=>", " &gt; ": "=>", " <- ": "<=", " ← ": "<=", " ↔ ": "<=>", " = ": "<=>", " &lt;=&gt; ": "<=>"}
    df = spark.createDataFrame([(f"2 A{k}", f"2 A {v} ", v) for k, v in signs.items()] + [(f"{k}2 A", f" {v} 2 A", v) for k, v in signs.items()], "t string, e string, d string")
    got = df.select("e", "d", E.standardize_equation("t").alias("x"), E.direction("t").alias("y"), E.standardize_equation(F.trim("t")).alias("z")).collect()
    assert all(r.x == r.e == r.z for r in got), got
    assert all(r.y == r.d for r in got), got
