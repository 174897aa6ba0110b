"""Seed files that arrive over time: each line is processed once, and finished lines go to the ledger.

The stream's checkpoint holds which files were read and, as keyed state, which lines were seen, so the work of a batch
follows its own lines and not the ledger's length. A batch is logged after it was processed. A failure repeats the batch
with the same lines, whose ledger entry is written over, so no restart loses a line or logs it twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from linkloom.sinks.export import log_batch, pending
from linkloom.sources.seeds import parse_seeds


def follow_seeds(spark: SparkSession, folder: str, ledger: str, checkpoint: str, process: Callable[[DataFrame], None],
                 finished: DataFrame | None = None, files_at_once: int | None = None) -> StreamingQuery:
    """Run ``process`` on the unseen seeds of every new file in ``folder``; stops when all files are read.

    Lines in ``finished`` (``line``), such as a ledger that was kept before there was a stream, count as seen. A batch holds
    all new files, or ``files_at_once`` of them. Of equal lines one is processed; empty lines are no seeds. ``process`` may
    meet a batch again after a failure.
    """
    files = spark.readStream.format("text")
    if files_at_once:
        files = files.option("maxFilesPerTrigger", files_at_once)
    fresh = parse_seeds(files.load(folder)).dropDuplicates(["line"])
    if finished is not None:
        fresh = pending(fresh, finished)

    def batch(todo: DataFrame, number: int) -> None:
        todo.persist()
        try:
            process(todo)
            log_batch(todo, ledger, number)
        finally:
            todo.unpersist()

    return fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
