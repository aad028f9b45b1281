"""Micro-batches give what one batch gives."""

import random

from pyspark.sql import functions as F

from standex import api
from standex.operators import client
from standex.plans import data, search_queries
from standex.streaming import extension, history
from standex.streaming.progress import Progress


def test_answers_of_a_stream_equal_those_of_a_batch(spark, small, tmp_path):
    indexes = search_queries.domain_index(spark, small)
    queries = data.public_queries(spark).where("qid < 4")
    for k in range(2):  # two files, so at least two micro-batches
        queries.where(f"qid % 2 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/asked")
    vectors_of = lambda batch: search_queries._scale_vectors(spark, small, batch)
    asked = spark.readStream.schema(queries.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/asked")
    with Progress(spark, total=8) as progress:
        stream = extension.answer_stream(asked, vectors_of, indexes, f"{tmp_path}/answers", f"{tmp_path}/state")
        stream.awaitTermination()
        progress.wait(stream)
        assert (progress.rows, progress.batches) == (4, 2) and progress.rate > 0
        assert abs(progress.seconds_left * progress.rate - 4) < 0.1  # half of the rows are left
    rows = lambda df: sorted((r.qid, tuple(r.retrieved_standards)) for r in df.collect())
    assert rows(spark.read.parquet(f"{tmp_path}/answers")) == rows(api.rank.recommend(queries, vectors_of(queries), indexes))


def test_histories_of_a_stream_equal_those_of_a_batch(spark, tmp_path):
    """Three runs over growing input with one checkpoint: rows out of order, one file twice, queries beyond what is kept."""
    rng = random.Random(1)
    rows = [(u, 1_000_000 + rng.randrange(50), s, f"query {u} {s}") for u in range(5) for s in range(14)]
    rng.shuffle(rows)
    schema = "user long, ts long, seq long, query string"

    def drop(part):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/asked")

    def run():
        stream = history.histories(spark.readStream.schema(schema).parquet(f"{tmp_path}/asked"), kept=6)
        stream = stream.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("append").parquet(f"{tmp_path}/out"))
        stream.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
        last = spark.read.parquet(f"{tmp_path}/out").groupBy("user").agg(F.max_by("entries", "version").alias("e"))
        return {r["user"]: [(e["ts"], e["seq"], e["query"]) for e in r["e"]] for r in last.collect()}

    for a, b in ((0, 20), (20, 50), (10, 70)):
        drop(rows[a:b])
        asked = spark.createDataFrame(rows[: max(b, 50) if b > 20 else b], schema)
        want = {}
        for r in client.history(asked).where("pos <= 6").orderBy("user", "pos").collect():
            want.setdefault(r["user"], []).append((r["ts"], r["seq"], r["query"]))
        assert run() == want
    assert run() == want  # nothing new


def test_idle_users_are_forgotten(spark, tmp_path):
    schema = "user long, ts long, seq long, query string"
    for ts in (1_000, 10_000_000, 20_000_000):  # each later than the one before by more than what may be late and idle
        spark.createDataFrame([(ts, ts, 1, "q")], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/asked")
        stream = history.histories(spark.readStream.schema(schema).parquet(f"{tmp_path}/asked"), idle=5_000, late="1 second")
        query = stream.writeStream.outputMode("update").foreachBatch(lambda b, i: b.count()).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2
