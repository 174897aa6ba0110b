"""Session helpers: tuned session, lineage cuts, and keys shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, Observation, SparkSession


def build_session(app: str = "linkloom", master: str | None = None, partitions: int | None = None,
                  memory: str | None = None) -> SparkSession:
    """A session with adaptive execution on; master, partitions and driver memory are left to the cluster unless given."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
        .config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    if master:
        b = b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    if memory:
        b = b.config("spark.driver.memory", memory)
    return b.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; a private one only for a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if shared:
        sc.setCheckpointDir(shared)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="linkloom-ckpt-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")


# Spark's defaults and what takes their place: keys of these tables compress so well that 64 MB of a shuffle are over 1 GB in a task's sorts
_TASK_INPUT = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": ("67108864b", "16m"), "spark.sql.files.maxPartitionBytes": ("134217728b", "16m")}


def bound_tasks(spark: SparkSession) -> None:
    """Let no task gather more than about 16 MB of a shuffle or of files, unless the session says otherwise; larger inputs make more tasks."""
    for name, (default, value) in _TASK_INPUT.items():
        if spark.conf.get(name) == default:
            spark.conf.set(name, value)


def plain_unions(spark: SparkSession) -> None:
    """Let no plan rely on how the parts of a union are dealt.

    Spark 4.1 takes a union of parts that are dealt alike as dealt like them. On large tables adaptive execution makes such a
    union one of twice as many partitions after the join above it was planned, which then fails: "Can't zip RDDs with
    unequal numbers of partitions". A Spark without the setting has no such plans.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/linkloom-{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, observe: dict | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and read it back.

    This cuts the lineage, so a lost executor never replays the loop behind it. Compared with an RDD checkpoint the
    plan runs once, columns can be pruned, and later joins see the true size: Spark broadcasts the table only when it
    is below ``spark.sql.autoBroadcastJoinThreshold``. ``observe`` maps names to aggregate columns that are taken from
    the write itself, without a second job; they are left in the frame's ``observed``.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/linkloom-{uuid.uuid4().hex}"
    watch = Observation() if observe else None
    (df.observe(watch, *[c.alias(k) for k, c in observe.items()]) if observe else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path, out.observed = path, watch.get if watch else {}
    return out


def discard(df: DataFrame) -> None:
    """Remove the folder of a ``cut`` frame that nothing reads any more."""
    sc = df.sparkSession.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(df.cut_path)
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that Python tasks can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="linkloom-ship-"), "linkloom.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("linkloom", os.path.relpath(full, here)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)
