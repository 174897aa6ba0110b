"""Helpers for Arrow tasks: bounded slices of a batch, and storage that executors reach through a URI."""

from __future__ import annotations

import ctypes
import uuid

import pyarrow as pa
import pyarrow.compute
import pyarrow.fs
from pyspark.sql import DataFrame

from linkloom.session import ensure_checkpoint_dir, ship_package


BATCH_BYTES = "8m"  # of an Arrow batch, unless the session says otherwise: texts are long, and workers should stay small
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPARK_DEFAULT = "67108864b"


def give_back() -> None:
    """Return free memory of this worker to the machine: it may sit idle beside workers of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # GNU C library only
    if trim:
        trim(0)


def map_arrow(df: DataFrame, fn, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package sent to the executors, and batches bounded by bytes."""
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(_LIMIT, None) == _SPARK_DEFAULT:
        spark.conf.set(_LIMIT, BATCH_BYTES)

    def run(batches):
        yield from fn(batches)
        give_back()

    return df.mapInArrow(run, schema)


def slices(batches, column: str, max_bytes: int = 2 << 20):
    """Cut record batches so that ``column`` holds about ``max_bytes`` in each piece; a longer value stands alone."""
    for batch in batches:
        col = batch.column(column)
        start = held = 0
        sizes = pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False)
        for i, size in enumerate(sizes):
            if held and held + size > max_bytes:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(size)
        if start < batch.num_rows:
            yield batch.slice(start)
        pa.default_memory_pool().release_unused()


def deal(df: DataFrame, tasks_per_core: int = 4) -> DataFrame:
    """A short list dealt over the cluster, one row a task as far as cores allow; the number given keeps adaptive execution from merging them."""
    spark = df.sparkSession
    most = max(tasks_per_core * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(max(1, min(df.count(), most)))


def shared_folder(spark, name: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``, where the driver and all executors see the same files."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/linkloom-{name}-{uuid.uuid4().hex}"


def storage(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI, and the path in it."""
    fs, path = pyarrow.fs.FileSystem.from_uri(uri)
    return fs, path


def put_file(fs, folder: str, name: str, chunks) -> int:
    """Write ``chunks`` under a name of this attempt, then move the whole file to ``name``; the bytes written.

    A repeated task writes the same bytes, so whichever attempt moves last leaves the same file.
    """
    fs.create_dir(folder, recursive=True)
    part, size = f"{folder}/.{name}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(part, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    fs.move(part, f"{folder}/{name}")
    return size
