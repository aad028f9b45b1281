"""Streaming queries: an extension, run to the end of what is there and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from ..sources import io
from ..streaming import extension, history
from .registry import query


@query(
    "SELECT date_trunc('hour', ts)::VARCHAR AS window_start, event_type, count(*)::BIGINT AS n, round(avg(value), 6) AS mean_value, round(max(value), 6) AS max_value FROM events GROUP BY ALL"
)
def stream_value_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows of events, streamed in one go; the update log keeps each window's last state."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(_folder(spark, path))
    uri, checkpoint = shared_folder(spark, "windows"), shared_folder(spark, "windows-state")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(uri)

    stream = extension.value_windows(events).writeStream.outputMode("update").foreachBatch(keep)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    log = spark.read.parquet(uri)
    last = log.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "mean_value", "max_value"), "batch").alias("s"))
    return last.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event_type", "s.n",
        F.round("s.mean_value", 6).alias("mean_value"), F.round("s.max_value", 6).alias("max_value"),
    )


#: Entries of a history that are shown.
SHOWN = 3


@query(
    f"SELECT * FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC)::INTEGER AS pos, md5(text) AS query_md5 FROM conversations WHERE role = 'user') WHERE pos <= {SHOWN}"
)
def history_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' newest queries as a stream keeps them; of each user the last state counts."""
    turns = io.stream(spark, f"{sf_dir}/conversations.parquet", "conv_id long, turn long, role string, text string", 1).where("role = 'user'")
    asked = turns.select(F.col("conv_id").alias("user"), (F.col("turn") + 1).alias("ts"), F.col("turn").alias("seq"), F.col("text").alias("query"))  # time 0 is late from the start
    uri, checkpoint = shared_folder(spark, "histories"), shared_folder(spark, "histories-state")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("append").parquet(uri)

    stream = history.histories(asked, SHOWN).writeStream.outputMode("update").foreachBatch(keep)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    last = spark.read.schema(history.HISTORY).parquet(uri).groupBy("user").agg(F.max_by("entries", "version").alias("entries"))
    each = last.select(F.col("user").alias("conv_id"), F.posexplode("entries").alias("k", "e"))
    return each.select("conv_id", F.col("e.seq").alias("turn"), (F.col("k") + 1).alias("pos"), F.md5("e.query").alias("query_md5"))


def _folder(spark: SparkSession, path: str) -> str:
    """A stream reads folders: the table's own, or a copy of a table that is a single file."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(hadoop).isDirectory():
        return path
    uri = shared_folder(spark, "events")
    spark.read.parquet(path).write.parquet(uri)
    return uri
