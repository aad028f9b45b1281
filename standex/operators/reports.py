"""Reports over chunks and ranked lists; each is one aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids


def category_histogram(chunks: DataFrame, most: int | None = None) -> DataFrame:
    """(category, n, pct), most frequent first."""
    counts = chunks.groupBy(F.coalesce("category", F.lit("unknown")).alias("category")).agg(F.count("*").alias("n"))
    shared = counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))
    ordered = shared.orderBy(F.desc("n"), "category")
    return ordered.limit(most) if most else ordered


def part_histogram(chunks: DataFrame) -> DataFrame:
    return chunks.where("part_number is not null").groupBy("part_number").agg(F.count("*").alias("n")).orderBy("part_number")


def domain_histogram(chunks: DataFrame, most: int = 10) -> DataFrame:
    counts = chunks.select(F.explode("application_domains").alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "domain").limit(most)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """One row of conditional counts, in one pass."""
    some = lambda c: F.coalesce(c, F.lit(False))
    return chunks.agg(
        F.count("*").alias("n_chunks"), F.count_if(some(F.col("is_summary_chunk"))).alias("n_anchor"),
        F.count_if(~some(F.col("is_summary_chunk"))).alias("n_content"), F.count_if(F.col("part_number").isNotNull()).alias("n_multi_part"),
        F.count_if(some(F.col("is_test_method"))).alias("n_test_method"), F.count_if(F.size("related_standards") > 0).alias("n_with_refs"),
    )


def sample(chunks: DataFrame, n: int = 3) -> DataFrame:
    """The first chunks, shortened for reading."""
    return chunks.orderBy("doc_idx").limit(n).select(
        "doc_idx", "id", "category", F.array_join(F.slice("keywords", 1, 5), ", ").alias("keywords"), F.substring("text", 1, 150).alias("text"),
    )


def enriched_sample(chunks: DataFrame, n: int = 3) -> DataFrame:
    """The first enriched chunks: their lists shortened, and of the properties the first two kinds present."""
    kinds = ("physical", "chemical", "testing", "manufacturing", "quality")
    shown = [
        F.when(F.col(f"technical_properties.{k}").isNotNull(), F.concat(F.lit(f"{k}: "), F.array_join(F.slice(f"technical_properties.{k}", 1, 3), ", ")))
        for k in kinds
    ]
    part = lambda c, m: F.array_join(F.slice(c, 1, m), ", ").alias(c)
    return chunks.orderBy("doc_idx").limit(n).select(
        "doc_idx", "id", F.substring("title", 1, 60).alias("title"), "category", "part_number", "standard_year", "is_summary_chunk", "is_test_method",
        part("keywords", 8), part("application_domains", 3), part("composition_terms", 6), part("related_standards", 5),
        F.array_join(F.slice(F.array_compact(F.array(*shown)), 1, 2), "; ").alias("properties"), F.substring("text", 1, 150).alias("text"),
    )


def first_issues(checked: DataFrame, n: int = 5) -> DataFrame:
    """The first chunks with quality issues."""
    bad = checked.where(~F.col("is_valid")).orderBy("doc_idx").limit(n)
    return bad.select("doc_idx", F.coalesce("id", F.lit("unknown")).alias("id"), F.array_join("issues", ", ").alias("issues"))


def duplicate_versions(ranked: DataFrame, emitted: DataFrame, most: int = 5) -> DataFrame:
    """(qid, base_key, std_id, n_versions, selected): standards with several versions in a ranked list,
    the first `most` of each query, and whether each was emitted."""
    named = ranked.withColumn("std_id", ids.format_standard_id(F.col("id"))).where(ids.is_valid(F.col("std_id")))
    keyed = named.withColumn("base_key", ids.base_key(F.col("std_id")))
    whole = Window.partitionBy("qid", "base_key")
    counted = keyed.withColumns({"n_versions": F.count("*").over(whole), "_first": F.min("rank").over(whole)}).where("n_versions > 1")
    groups = counted.withColumn("_g", F.dense_rank().over(Window.partitionBy("qid").orderBy("_first"))).where(F.col("_g") <= most)
    chosen = emitted.select("qid", "std_id", F.lit(True).alias("selected"))
    out = groups.join(chosen, ["qid", "std_id"], "left")
    return out.select("qid", "base_key", "rank", "std_id", "n_versions", F.coalesce("selected", F.lit(False)).alias("selected"))


def dedup_counts(ranked: DataFrame, emitted: DataFrame) -> DataFrame:
    """(qid, n_in, n_out, n_merged)."""
    into = ranked.groupBy("qid").agg(F.count("*").alias("n_in"))
    out = emitted.groupBy("qid").agg(F.count("*").alias("n_out"))
    return into.join(out, "qid", "left").select(
        "qid", "n_in", F.coalesce("n_out", F.lit(0)).alias("n_out"), (F.col("n_in") - F.coalesce("n_out", F.lit(0))).alias("n_merged"),
    )
