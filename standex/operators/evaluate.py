"""Metrics, statistics and validation of results (id, query, expected_standards, retrieved_standards, latency_seconds)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..sources.shared import materialise
from .contain import BOUND, holding

# What validation says.
MISSING, INVALID, DUPLICATE = "Missing '{}' field", "Invalid standard at position ", "Duplicate query ID"


def hits(results: DataFrame) -> DataFrame:
    """(id, hit_at_3, rr_at_5, latency): whether an expected id is among the first three, and one over the
    first match's rank among the first five (0 without)."""
    none = F.array().cast("array<string>")
    expected = F.transform(F.coalesce("expected_standards", none), lambda x: ids.normalize_id(x))
    got = F.transform(F.coalesce("retrieved_standards", none), lambda x: ids.normalize_id(x))
    marks = F.transform(F.slice(got, 1, 5), lambda x: F.array_contains(expected, x))
    first = F.array_position(marks, True)
    return results.select(
        "id", F.arrays_overlap(F.slice(got, 1, 3), expected).alias("hit_at_3"),
        F.when(first > 0, 1.0 / first).otherwise(0.0).alias("rr_at_5"), F.coalesce("latency_seconds", F.lit(0.0)).alias("latency"),
    )


def summary(results: DataFrame) -> DataFrame:
    """One row: n_queries, hit_rate_3 (percent), mrr_5, avg_latency."""
    return hits(results).agg(
        F.count("*").alias("n_queries"), (F.avg(F.col("hit_at_3").cast("int")) * 100).alias("hit_rate_3"),
        F.avg("rr_at_5").alias("mrr_5"), F.avg("latency").alias("avg_latency"),
    )


def latency_statistics(results: DataFrame) -> DataFrame:
    """One row. Median and p95 are elements of the sorted list, found by their rank: distinct values are
    dealt out by ranges, and each adds up its own after the sum of the ranges before it. A single-partition
    window sees one row a range."""
    x = F.coalesce("latency_seconds", F.lit(0.0))
    counts = results.groupBy(x.alias("x")).agg(F.count("*").alias("c"))
    # written once: the ranges are sampled, and a second run might draw others
    dealt = materialise(counts.repartitionByRange("x").withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    ranges = dealt.groupBy("_range").agg(F.sum("c").alias("_sum"))
    ranges = ranges.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"), F.sum("_sum").over(every).alias("n"))
    upto = Window.partitionBy("_range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("_own", F.sum("c").over(upto)).join(ranges, "_range").withColumn("upto", F.col("_start") + F.col("_own"))
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("n") * share), F.col("x")))
    return ranked.agg(
        F.sum("c").alias("n"), F.min("x").alias("min_s"), F.max("x").alias("max_s"), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean_s"),
        at(0.5).alias("median_s"), at(0.95).alias("p95_s"), F.sum(F.col("x") * F.col("c")).alias("total_s"),
    )


def size_histogram(results: DataFrame) -> DataFrame:
    sizes = results.groupBy(F.coalesce(F.size("retrieved_standards"), F.lit(0)).alias("n_standards")).agg(F.count("*").alias("n_queries"))
    return sizes.withColumn("pct", F.col("n_queries") * 100.0 / F.sum("n_queries").over(Window.partitionBy()))


def clean_results(results: DataFrame) -> DataFrame:
    """Result projection: blank predictions out, latency to 4 digits."""
    kept = F.filter(F.coalesce("retrieved_standards", F.array().cast("array<string>")), lambda s: text.strip(s) != "")
    return results.select(
        F.coalesce("id", F.lit("unknown")).alias("id"), F.coalesce("query", F.lit("")).alias("query"), "expected_standards",
        kept.alias("retrieved_standards"), F.bround("latency_seconds", 4).alias("latency_seconds"),
    )


def validation_issues(results: DataFrame) -> DataFrame:
    """(id, issue): missing fields, repeated ids, blank standards. No row means the set is valid."""
    fields = ["id", "query", "expected_standards", "retrieved_standards", "latency_seconds"]
    missing = [F.when(F.col(c).isNull(), F.lit(MISSING.format(c))) for c in fields]
    blank = F.transform(
        F.coalesce("retrieved_standards", F.array().cast("array<string>")),
        lambda s, i: F.when(s.isNull() | (text.strip(s) == ""), F.concat(F.lit(INVALID), i.cast("string"))),
    )
    own = results.select("id", F.explode(F.array_compact(F.concat(F.array(*missing), blank))).alias("issue"))
    repeated = results.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 and id is not null")
    again = repeated.select("id", F.explode(F.array_repeat(F.lit(DUPLICATE), F.col("n").cast("int") - 1)).alias("issue"))
    return own.unionByName(again)


def format_report(rows: DataFrame) -> DataFrame:
    """(qid, all_valid, invalid) of (qid, std_ids)."""
    invalid = F.filter("std_ids", lambda s: ~ids.is_valid(s))
    return rows.select("qid", (F.size(invalid) == 0).alias("all_valid"), invalid.alias("invalid"))


def relevant(docs: DataFrame, items: DataFrame, bound: int = BOUND) -> DataFrame:
    """(doc_id, sought): documents (doc_id, text) that hold the whole text `sought` of an item."""
    return holding(docs, "text", ["doc_id"], items, "sought", bound)


def judged(found: DataFrame, docs: DataFrame, items: DataFrame) -> DataFrame:
    """Ranked answers (qid, rank, doc_idx) with `relevant`: whether the document holds the whole text of the item
    (qid, sought). Only documents that are answers are looked into."""
    texts = docs.select(F.col("doc_id").alias("doc_idx"), "text").join(found.select("doc_idx").distinct(), "doc_idx", "left_semi")
    asked = found.join(items.select("qid", "sought"), "qid").join(texts, "doc_idx", "left")
    holds = F.coalesce(F.contains("text", F.col("sought")), F.lit(False))
    return asked.groupBy(*found.columns).agg(F.max(holds).alias("relevant"))


def as_results(judged_rows: DataFrame) -> DataFrame:
    """Results (id, query, expected_standards, retrieved_standards, latency_seconds) of judged answers. Expected
    are the relevant ones among the answers: more can't change whether and where the first is met."""
    rows = judged_rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.col("doc_idx").cast("string").alias("d"), "relevant"))).alias("r"))
    named = lambda r: F.transform(r, lambda s: s["d"])
    return rows.select(
        F.col("qid").cast("string").alias("id"), F.lit(None).cast("string").alias("query"), named(F.filter("r", lambda s: s["relevant"])).alias("expected_standards"),
        named(F.col("r")).alias("retrieved_standards"), F.lit(None).cast("double").alias("latency_seconds"),
    )
