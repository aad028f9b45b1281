"""Streaming: an extension. The batch operators run unchanged on micro-batches of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.index import Index
from ..operators.rank import recommend


def answer_stream(queries: DataFrame, vectors_of: object, index: Index, path: str, checkpoint: str) -> StreamingQuery:
    """Answers a stream of (qid, query) against static index tables; each micro-batch is one job over all
    its queries and appends (qid, retrieved_standards) to path. vectors_of: DataFrame of (qid, query) to
    (qid, embedding)."""

    def answer(batch: DataFrame, _: int) -> None:
        batch.persist()
        recommend(batch, vectors_of(batch), index).write.mode("append").parquet(path)
        batch.unpersist()

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def value_windows(events: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Count, mean and maximum of `value` by window and type. ts may be without time zone; a watermark needs one."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = timed.groupBy(F.window("ts", length).alias("w"), "event_type")
    return grouped.agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value")).select(
        F.col("w.start").alias("window_start"), "event_type", "n", "mean_value", "max_value"
    )
