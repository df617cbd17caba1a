"""Session defaults and the path by which Python workers find this package."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def get_session(app: str = "driftmode", master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution and Arrow transfer on; other settings are the cluster's."""
    b = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.execution.arrow.pyspark.enabled", "true")
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return prepare(b.getOrCreate())


#: Settings of the C library by which Python workers, which outlive their tasks, give freed memory back.
ALLOCATOR = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "4194304"}
#: Rows and bytes of an Arrow batch where the session has Spark's defaults: rows may be long texts.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "4194304b")}


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package where it isn't installed (a no-op on a cluster that gets it by --py-files),
    and bound the Arrow batches that they get."""
    for key, (default, ours) in BATCH.items():
        if spark.conf.get(key, default) == default:
            spark.conf.set(key, ours)
    env = spark.sparkContext.environment
    for key, value in ALLOCATOR.items():
        if key not in env and key not in os.environ:
            env[key] = value
    path = env.get("PYTHONPATH") or os.environ.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, path) if x)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names, or the one set on the context. Where neither is set and all runs on one
    machine (local mode, as in tests), one is made; on a cluster that is an error, for executors share no local folder."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not where:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="driftmode-shared-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that was written to the shared folder, once nothing reads it any more."""
    context = df.sparkSession.sparkContext
    for folder in {x.rpartition("/")[0] for x in df.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
