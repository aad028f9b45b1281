"""The folder that all executors share, and tables kept there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a local session (tests) gets a temporary
    folder, and a cluster an error: a folder of the driver's machine is of no use to executors."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not root and current.isDefined():
        root = current.get()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='standex-')}"
    if current.isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def own_root(spark: SparkSession) -> str:
    """What this application keeps below the shared folder."""
    return f"{shared_root(spark)}/standex-{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder's URI below the shared one. Unique, so that concurrent runs don't meet."""
    return f"{own_root(spark)}/{purpose}-{uuid.uuid4().hex}"


def drop_folder(spark: SparkSession, uri: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def exists(spark: SparkSession, uri: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def state(df: DataFrame) -> str:
    """What tells one state of the tables that a frame reads from another: their files' names, lengths and times."""
    spark = df.sparkSession
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    found = []
    for name in sorted(df.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        status = path.getFileSystem(conf).getFileStatus(path)
        found.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return "\n".join(found)


def clean(spark: SparkSession) -> None:
    """Drops all that this application has kept (indexes without a path, media, archives, tables between
    stages). Frames that read them can't be used afterwards; checkpoints are Spark's to clean."""
    drop_folder(spark, own_root(spark))


def materialise(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage is cut at files that outlive a lost executor."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """A table written to the shared folder and read again. Unlike a checkpoint, its size is then
    known to the planner, which broadcasts it only below spark.sql.autoBroadcastJoinThreshold."""
    uri = shared_folder(df.sparkSession, purpose)
    df.write.parquet(uri)
    return df.sparkSession.read.parquet(uri)


@contextmanager
def read_in_parts(spark: SparkSession, most: int) -> Iterator[None]:
    """What is executed meanwhile reads files in parts of at most so many bytes, or fewer if the session says so."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    least = min(most, spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(before))
    spark.conf.set(name, str(least))
    try:
        yield
    finally:
        spark.conf.set(name, before)
