"""Helpers that keep array work to one evaluation per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spread(df: DataFrame, array, name: str, *keep, pos: str | None = None) -> DataFrame:
    """One row per array element, next to the columns ``keep``; ``pos`` adds the position from 0.

    A plain ``explode`` of a computed array makes the optimizer add a size filter on the same expression, pushed
    below everything, so a costly expression runs twice. The outer form with a null filter above it does not.
    ``keep`` is computed below the generator: beside it an expression would run once for each element, which over a long
    row is the square of its length.
    """
    rows = df.select(*keep, (F.col(array) if isinstance(array, str) else array).alias("_array"))
    kept = [c for c in rows.columns if c != "_array"]
    if pos:
        return rows.select(*kept, F.posexplode_outer("_array").alias(pos, name)).filter(F.col(pos).isNotNull())
    return rows.select(*kept, F.explode_outer("_array").alias(name)).filter(F.col(name).isNotNull())
