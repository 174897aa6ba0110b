"""Keep most rows out of a join: a bitmap of fixed size says which rows may have a partner."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 22  # 512 KB, whatever the number of keys; a full bitmap only stops saving work


def _slot(cols) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(1 << BITS))


def may_be_in(keys: DataFrame, key_cols, cols) -> Column:
    """A condition on a frame with the columns ``cols``: false only if no row of ``keys`` agrees in ``key_cols``.

    The bitmap is folded on the executors to at most 2^16 words of 64 bits and enters the plan as a scalar subquery.
    """
    spark = keys.sparkSession
    slot = _slot([F.col(c) for c in key_cols])
    words = (
        keys.select(slot.alias("s")).groupBy(F.floor(F.col("s") / 64).cast("int").alias("w"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")).toArrow()
    )
    dense = np.zeros(1 << (BITS - 6), np.int64)
    dense[words.column("w").to_numpy()] = words.column("bits").to_numpy()
    bitmap = spark.createDataFrame([(dense.tolist(),)], "bits array<long>").scalar()
    at = _slot([F.col(c) for c in cols])
    return F.getbit(F.get(bitmap, F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1


def drop_keys(df: DataFrame, keys: DataFrame, cols) -> DataFrame:
    """``df`` without the rows whose ``cols`` equal a row of ``keys``; null equals null. Only rows that the bitmap lets through are shuffled."""
    names = [f"_k{i}" for i in range(len(cols))]
    gone = keys.select(*[F.col(c).alias(n) for c, n in zip(cols, names, strict=True)])
    hit = may_be_in(gone, names, cols)
    match = F.lit(True)
    for c, n in zip(cols, names, strict=True):
        match = match & F.col(c).eqNullSafe(F.col(n))
    return df.filter(~hit).unionByName(df.filter(hit).join(gone, match, "left_anti"))
