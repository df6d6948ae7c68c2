"""Session and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "recallscope") -> SparkSession:
    """A local session for tests and the bench (the cluster brings its own)."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # scorer batches carry whole texts: bound them by bytes, not only rows
        .config("spark.sql.execution.arrow.maxBytesPerBatch", str(64 * 1024 * 1024))
        .config("spark.sql.session.timeZone", "UTC")
        # call-site capture costs JVM round trips for every Column built on the driver
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session names none and runs in local mode (tests) do we
    pick a scratch folder of our own and register it as the checkpoint
    directory; on a cluster a machine-local folder would not survive the
    loss of an executor, so an unset folder is an error there.
    """
    sc = spark.sparkContext
    conf_dir = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        return conf_dir.rstrip("/")
    sc_dir = sc.getCheckpointDir()
    if sc_dir:
        return sc_dir.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder shared by the cluster "
                         "(results and stream progress are kept there)")
    local = tempfile.mkdtemp(prefix="recallscope-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new, unused location below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through Hadoop's FileSystem, so it works for any scheme."""
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession):
    """Inside, :func:`materialize` writes below one folder of the shared store, which is deleted on the
    way out. For work that repeats for as long as a stream runs: checkpoints would pile
    up. Nothing materialized inside may be read after it."""
    folder = fresh_path(spark, "scratch")
    token = _SCRATCH.set(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(token)
        jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)


def materialize(df):
    """Compute a small result once and cut its lineage.

    For tables bounded by the experiment design (one row per setting) that
    several later steps read. ``checkpoint`` writes to the shared checkpoint
    folder, so the result survives the loss of any executor; inside :func:`scratch`
    a Parquet table there does the same.
    """
    folder = _SCRATCH.get()
    if folder is not None:
        path = f"{folder}/{uuid.uuid4().hex[:12]}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
