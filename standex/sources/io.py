"""Readers and writers: JSON arrays with explicit schemas, Parquet, documents behind a parser."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..operators.ordinals import numbered
from .shared import shared_folder

def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array of objects, or a folder of JSON lines; malformed input raises."""
    reader = spark.read.schema(schema).option("mode", "FAILFAST")
    return reader.option("multiLine", not _is_folder(spark, path)).json(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory()


def is_parquet(spark: SparkSession, path: str) -> bool:
    """Whether a path is, or is a folder that holds, Parquet files."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(hadoop.suffix("/*.parquet"))
    return path.endswith(".parquet") or bool(files)


def read_chunks(spark: SparkSession, *paths: str) -> DataFrame:
    """Chunks from the first path that exists: enriched ones, then plain ones; Parquet or JSON. Chunks
    that bring no doc_idx (a JSON array from elsewhere) are numbered in the file's order."""
    for path in paths:
        if exists(spark, path):
            found = spark.read.parquet(path) if is_parquet(spark, path) else read_array(spark, path, schemas.ENRICHED)
            if "doc_idx" in found.columns and (found.isEmpty() or not found.where(F.col("doc_idx").isNotNull()).isEmpty()):
                return found
            return found.withColumn("doc_idx", F.monotonically_increasing_id())
    raise FileNotFoundError(f"none of {', '.join(paths)} exists")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return read_array(spark, path, schemas.QUERY)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return read_array(spark, path, schemas.RESULT)


def stream(spark: SparkSession, path: str, schema: str, files: int) -> DataFrame:
    """A stream of the Parquet files of a path, which may be a folder or a single file: a pattern that
    only the path itself fits. `files` are taken at once."""
    path = path.rstrip("/")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{path[:-1]}[{path[-1]}]")


def write(df: DataFrame, path: str, form: str = "parquet") -> None:
    """Overwrites a table of Parquet files, or of JSON lines."""
    df.write.mode("overwrite").format(form).save(path)


def write_array(df: DataFrame, path: str) -> None:
    """One file with one JSON array, a row a line, in the order of df's partitions; null fields are left out.

    An array is one file, so one task writes it, row by row; nothing passes through the driver, and any number of rows
    will do. The file takes its place when it is whole."""
    spark = df.sparkSession
    rows = df.select(F.to_json(F.struct("*")).alias("row"), F.monotonically_increasing_id().alias("at"))
    placed = numbered(rows, ["at"], "k")
    lines = placed.select(F.concat(F.when(F.col("k") > 0, ",").otherwise(""), "row").alias("value"), "k")
    ends = spark.createDataFrame([("[", -1), ("]", 2**62)], "value string, k long")
    uri = shared_folder(spark, "array")
    lines.unionByName(ends).orderBy("k").select("value").coalesce(1).write.text(uri)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    made, target = hadoop.Path(uri), hadoop.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    part = made.getFileSystem(conf).globStatus(hadoop.Path(f"{uri}/part-*"))[0].getPath()
    if target.getParent() is not None:
        target.getFileSystem(conf).mkdirs(target.getParent())
    hadoop.FileUtil.copy(part.getFileSystem(conf), part, target.getFileSystem(conf), target, True, True, conf)


def read_documents(spark: SparkSession, path: str, parser: Callable[[bytes], list[str]]) -> DataFrame:
    """(src_id, page_no, text) of binary documents. The parser turns a file's bytes into the texts of its
    pages and runs on the executors, a file at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, i, t) for p, data in zip(batch["path"], batch["content"], strict=True) for i, t in enumerate(parser(data))]
            yield pd.DataFrame(rows, columns=["src_id", "page_no", "text"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "src_id string, page_no int, text string")


def plain_text(data: bytes) -> list[str]:
    """The default parser: form feeds divide pages."""
    return data.decode("utf-8", "replace").split("\f")


def environment(spark: SparkSession, name: str, default: str | None = None) -> str | None:
    """A setting from the session (spark.standex.<name>), else from the environment."""
    return spark.conf.get(f"spark.standex.{name.lower()}", None) or os.environ.get(name, default)


def literal(spark: SparkSession, terms: dict[str, list[str]]) -> DataFrame:
    """A word list as a relation (ord, grp, term)."""
    rows = [(i, g, t) for i, (g, t) in enumerate((g, t) for g, ts in terms.items() for t in ts)]
    return spark.createDataFrame(rows, "ord int, grp string, term string").orderBy(F.col("ord"))
