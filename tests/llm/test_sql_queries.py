"""Queries of the training-data operators against their SQL, and the entry that lists them."""

import pytest

import __spark_entry__ as entry
from tests.llm.helpers import SF
from tests.oracle import compare, connect

NAMES = sorted(n for n in entry.oracle_sql() if n.startswith("op"))


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert "pipeline" in names


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    ok, message = compare(spark, connect(SF), name, entry.queries()[name], entry.oracle_sql()[name], SF)
    assert ok, message
