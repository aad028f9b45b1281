"""Answers a set of queries over a corpus of documents and says how good the answers are.

The corpus is indexed (tables in a work folder), all queries are asked at once by hybrid search (lexical with learned
synonyms, exact vectors, fusion, boosts), each answer is judged (relevant: the document holds the query's whole
text), and each query gets Hit@3, the reciprocal rank among its first five, and the share of its relevant documents
that were found. Answers are written as Parquet partitioned by outcome, so that misses are read by themselves.

A run overwrites what an earlier one left in the target, and depends on the tables alone: repeated, or cut off and
repeated, it leaves the same rows. It takes the index that an earlier run made whole of the same documents, told by their
files' names, lengths and times, and else makes it anew; all queries are answered and judged each time. Queries with a
null id or text have no row; queries without vectors are answered by their words. An empty corpus gives no answers.
Tables: documents (doc_id, text, lang), queries (item_id, text), vectors (vec_id, embedding), which are both the
documents' and the queries'.

    python -m jobs.search_evaluation --config jobs/search_evaluation.toml
"""

from __future__ import annotations

import logging
import sys
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from standex.operators import evaluate, index, search
from standex.sources.shared import state, stored

from . import settings

log = logging.getLogger("search_evaluation")


@dataclass(frozen=True)
class Settings:
    documents: str
    queries: str
    vectors: str
    #: Folder of the index; may be dropped between runs.
    work: str
    #: Folder of the answers.
    target: str
    #: Answers a query gets.
    answers: int = 20


def outcome() -> Column:
    """By the rank of a query's first relevant answer."""
    first = F.col("first_rank")
    by_rank = F.when(first == 1, "first").when(first <= 3, "top3").when(first <= 5, "top5").when(first > 5, "below")
    return F.coalesce(by_rank, F.when(F.col("n_relevant") > 0, "missed").otherwise("no_relevant"))


def run(spark: SparkSession, settings: Settings) -> DataFrame:
    """Answers, judges and writes; returns the answers with their queries' marks."""
    documents = spark.read.parquet(settings.documents).select("doc_id", "text", "lang")
    queries = spark.read.parquet(settings.queries).select(F.col("item_id").alias("qid"), F.col("text").alias("query"))
    queries = queries.where("qid is not null and query is not null")
    vectors = spark.read.parquet(settings.vectors).select("vec_id", "embedding")
    log.info("read %d documents, %d queries, %d vectors", documents.count(), queries.count(), vectors.count())

    corpus = documents.select(
        F.col("doc_id").alias("doc_idx"), F.lit("").alias("id"), F.lit("").alias("title"), "text", F.col("lang").alias("category"), F.concat_ws(" ", "text", "lang").alias("search_text")
    )
    built = index.build_of(state(documents), corpus, vectors.select(F.col("vec_id").alias("doc_idx"), "embedding"), settings.work)
    asked = vectors.select(F.col("vec_id").alias("qid"), "embedding").join(queries.select("qid"), "qid", "left_semi")
    found = search.hybrid(queries, asked, built, settings.answers)

    sought = queries.withColumnRenamed("query", "sought")
    judged = stored(evaluate.judged(stored(found, "found"), documents, sought), "judged")  # both are read several times
    held = evaluate.relevant(documents, sought).groupBy("sought").agg(F.count("*").alias("n"))
    n_relevant = sought.join(held, "sought", "left").select("qid", F.coalesce("n", F.lit(0)).alias("n_relevant"))
    marks = evaluate.hits(evaluate.as_results(judged)).select(F.col("id").alias("_id"), "hit_at_3", "rr_at_5")
    of_query = judged.groupBy("qid").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first_rank"), F.count_if("relevant").alias("n_found"))
    of_query = of_query.join(n_relevant, "qid").join(marks, F.col("qid").cast("string") == F.col("_id")).drop("_id")
    of_query = of_query.withColumn("recall", F.when(F.col("n_relevant") > 0, F.col("n_found") / F.col("n_relevant"))).withColumn("outcome", outcome())

    rows = judged.join(of_query, "qid").select(
        F.col("qid").alias("item_id"), "rank", F.col("doc_idx").alias("doc_id"), "rrf_score", "relevant", "first_rank", "n_relevant", "hit_at_3", "rr_at_5", "recall", "outcome"
    )
    rows.write.mode("overwrite").partitionBy("outcome").parquet(settings.target)
    written = spark.read.schema(rows.schema).parquet(settings.target)
    each = written.where("rank = 1")
    for row in each.groupBy("outcome").agg(F.count("*").alias("n")).orderBy("outcome").collect():  # six outcomes
        log.info("%s: %d queries", row["outcome"], row["n"])
    s = each.agg(F.count("*").alias("n"), F.avg(F.col("hit_at_3").cast("int")).alias("hit"), F.avg("rr_at_5").alias("mrr")).first()
    log.info("wrote the answers to %d queries to %s: Hit@3 %.4f, MRR@5 %.4f", s["n"], settings.target, s["hit"] or 0, s["mrr"] or 0)
    return written


def main(argv: list[str]) -> int:
    chosen = settings.read(Settings, argv, "Answers a set of queries and evaluates the answers.")
    spark = SparkSession.builder.appName("search_evaluation").getOrCreate()
    log.info("settings: %s", asdict(chosen))
    run(spark, chosen)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
