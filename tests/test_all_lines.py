"""The queries over all lines, against union-find on small tables with a chain, a hub and lines of every flag."""

from collections import Counter

import pytest

from linkloom.catalog import QUERIES, SQL
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
LINES = ([(k, k) for k in range(40)] + [(k, k + 1) for k in range(40)]  # a chain of orders and parts
         + [(1000 + k, 500) for k in range(30)] + [(2000, 600), (2001, 600), (3000, 700), (3000, 700)])


def by_hand(lines):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for order, part in lines:
        a, b = find(f"R_{order}"), find(f"M_{part}_c")
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in list(up)}


def test_all_lines(spark, tmp_path):
    rows = [(o, p, "RAN"[k % 3], float(1 + k % 50)) for k, (o, p) in enumerate(LINES)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_returnflag string, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    want = by_hand(LINES)
    assert dict(map(tuple, QUERIES["components_all_lines"](spark, str(tmp_path)).collect())) == want
    compounds = Counter(c for n, c in want.items() if n.startswith("M_"))
    reactions = Counter(c for n, c in want.items() if n.startswith("R_"))
    sizes = Counter([("compounds", n) for n in compounds.values()] + [("reactions", n) for n in reactions.values()])
    got = QUERIES["component_histogram_all_lines"](spark, str(tmp_path)).select("kind", "size", "n_components").collect()
    assert {(r.kind, r.size): r.n_components for r in got} == sizes


@pytest.mark.parametrize("name", ["components_all_lines", "component_histogram_all_lines"])
def test_against_sql(spark, name):
    ok, message = compare(spark, connect(SF), name, QUERIES[name], SQL[name], SF)
    assert ok, message
