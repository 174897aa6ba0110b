import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.llm import ordering
from tests.llm.helpers import SF, awkward_docs, clashing


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 3000), st.text(max_size=5))
def test_permutation(n, key):
    slots = ordering.permute(np.arange(n), n, key)
    assert sorted(slots.tolist()) == list(range(n))
    assert (ordering.permute(slots, n, key, inverse=True) == np.arange(n)).all()


def test_permutation_of_a_large_domain():
    n, some = (1 << 47) + 12345, np.array([0, 1, 2, 1 << 40, (1 << 47) + 12344])
    slots = ordering.permute(some, n, "k")
    assert len(set(slots.tolist())) == 5 and slots.max() < n
    assert (ordering.permute(slots, n, "k", inverse=True) == some).all()


def stored(spark, df, tmp_path, parts=3):
    df.repartition(parts).write.parquet(f"{tmp_path}/t")
    return spark.read.parquet(f"{tmp_path}/t")


def stream_of(docs, ids, mark):
    got = docs.select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r"), F.coalesce(ids, F.lit(b"")).alias("x")).collect()
    return b"".join(bytes(r.x) + mark for r in sorted(got))


def hold(spark, docs, ids, mark, length, per_shard, tmp_path):
    folder = f"file://{tmp_path}/shards"
    shards = ordering.materialise(docs, ids, mark, folder, length, per_shard, "k")
    stream, stride = stream_of(docs, ids, mark), length * len(mark)
    n = -(-len(stream) // stride)
    stream += mark * ((n * stride - len(stream)) // len(mark))
    slots = ordering.permute(np.arange(n), n, "k") if n else np.zeros(0, int)
    want = sorted((int(t), i, stream[i * stride : (i + 1) * stride]) for i, t in enumerate(slots))
    got = sorted((r.slot, r.sequence, bytes(r.ids)) for r in ordering.read_slots(shards).collect())
    assert got == want
    for r in shards.collect():
        data = (tmp_path / "shards" / r.path.rpartition("/")[2]).read_bytes()
        assert data == b"".join(x for t, _, x in want if t // per_shard == r.shard) and hashlib.sha256(data).hexdigest() == r.sha256
    return shards, want


def test_documents(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shards, want = hold(spark, docs, F.col("text").cast("binary"), b"\xff", 64, 100, tmp_path)
    part = sorted((r.slot, bytes(r.ids)) for r in ordering.read_slots(shards, 150, 333).collect())
    assert part == [(t, x) for t, _, x in want if 150 <= t < 333]


def test_wide_tokens_and_awkward_rows(spark, tmp_path):
    docs = stored(spark, clashing(awkward_docs(spark)), tmp_path)
    ids = F.encode(F.substring("text", 1, 2000), "UTF-16LE")
    hold(spark, docs, ids, b"\x00\xd8", 32, 7, tmp_path)


@pytest.mark.parametrize("parts", [1, 4])
def test_small_splits_give_the_same_shards(spark, tmp_path, parts):
    docs = stored(spark, awkward_docs(spark), tmp_path, parts)
    one, _ = hold(spark, docs, F.col("text").cast("binary"), b"\xff", 50, 20, tmp_path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        again = spark.read.parquet(f"{tmp_path}/t")
        two = ordering.materialise(again, F.col("text").cast("binary"), b"\xff", f"file://{tmp_path}/again", 50, 20, "k")
        assert sorted(r.sha256 for r in one.collect()) == sorted(r.sha256 for r in two.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_empty_table(spark, tmp_path):
    docs = stored(spark, awkward_docs(spark).limit(0), tmp_path, 1)
    hold(spark, docs, F.col("text").cast("binary"), b"\xff", 50, 20, tmp_path)
