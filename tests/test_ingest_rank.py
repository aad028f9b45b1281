"""Ingest, ranking and evaluation on small rows."""

import re

import pytest
from pyspark.sql import functions as F

from standex import api
from standex.operators import evaluate, ingest, rank, rationale
from standex.plans import data


@pytest.mark.parametrize(("n", "chunks"), [(600, 1), (601, 2), (1400, 2), (1401, 3), (2600, 4)])
def test_window_counts(spark, n, chunks):
    df = spark.createDataFrame([(0, "IS 1: 2000", "t", "x" * n)], "std_seq long, id string, title string, text string")
    assert ingest.chunks(df).where("not is_summary_chunk").count() == chunks


def test_doc_idx_is_dense_and_ordered(spark, small):
    got = [r.doc_idx for r in data.domain_chunks(spark, small).orderBy("doc_idx").collect()]
    assert got == list(range(len(got)))


def test_running_offset_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(ingest, "BLOCK", 3)
    df = spark.range(10).withColumn("v", F.col("id") + 1)
    got = {r.id: r.offset for r in ingest.running_offset(df, "id", F.col("v")).collect()}
    assert got == {i: sum(range(1, i + 1)) for i in range(10)}


def test_ingest_end_to_end(spark):
    lines = [("a", 1, 0, "front matter"), ("a", 1, 1, "IS 269 : 1989 - Ordinary Portland Cement"), ("a", 1, 2, "fineness and soundness, portland cement"), ("a", 1, 3, "IS 1")]
    got = api.ingest(spark.createDataFrame(lines, "src_id string, page_no int, line_no int, line string")).orderBy("doc_idx").collect()
    assert [r.id for r in got] == ["IS 269 : 1989"] * 2 and got[0].is_summary_chunk and got[1].chunk_index == 0
    assert got[0].title == "Ordinary Portland Cement" and got[0].category == "cement" and got[0].standard_year == 1989


def plain_segments(lines):
    """A fold over the lines in order, as one process would do it."""
    out, own = {}, {}
    for src, _, _, line in sorted(lines):
        if re.search(r"(?i)IS\s+\d{1,5}", line):
            own[src] = own.get(src, 0) + 1
        if own.get(src):
            out.setdefault((src, own[src]), []).append(line)
    return {k: " ".join(v) for k, v in out.items() if len(" ".join(v)) > 20}


@pytest.mark.parametrize("ranges", ["1", "9"])
def test_a_source_over_many_ranges_is_segmented_like_one(spark, ranges):
    lines = [("big", p, n, f"IS {100 + p} standard of page {p}" if n == 0 and p % 3 else f"line {n} of page {p}") for p in range(60) for n in range(20)]
    lines += [("few", 1, 0, "no identifier here"), ("few", 1, 1, "IS 7"), ("late", 1, 0, "x"), ("late", 2, 0, "IS 8 begins only here"), ("none", 1, 0, "nothing at all to be seen")]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(lines, "src_id string, page_no int, line_no int, line string").repartition(5)
        got = ingest.segment(df)
        assert {(r.src_id, r.seg): r.text for r in got.collect()} == plain_segments(lines)
        numbered = ingest.number_standards(got).orderBy("std_seq").collect()
        assert [r.std_seq for r in numbered] == list(range(len(numbered)))
        assert [r.text for r in numbered] == [t for _, t in sorted(plain_segments(lines).items())]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


SCHEMA = "qid int, rank int, doc_idx long, id string, standard_year int"


def test_version_dedup_refills_with_losers(spark):
    rows = [("IS 269: 1989", 1989), ("IS269:1989", 1989), ("IS 269: 2013", 2013), ("IS 2185 (Part 1): 1979", 1979), ("IS 2185 (Part 2): 1983", 1983), ("IS 383: 1970", 1970)]
    df = spark.createDataFrame([(1, i + 1, i, a, y) for i, (a, y) in enumerate(rows)], SCHEMA)
    got = [r.std_id for r in rank.version_dedup(df).orderBy("pos").collect()]
    assert got == ["IS 269: 1989", "IS 2185 (Part 1): 1979", "IS 2185 (Part 2): 1983", "IS 383: 1970", "IS 269: 2013"]


@pytest.mark.parametrize(("scores", "n"), [([10, 9, 8, 7.9, 5, 1], 4), ([-1, -2, -3, -4], 3), ([3, 2], 2), ([10.0 - i / 10 for i in range(12)], 8)])
def test_truncate(spark, scores, n):
    df = spark.createDataFrame([(1, i + 1, float(s)) for i, s in enumerate(scores)], "qid int, rank int, score double")
    assert rank.truncate(df).count() == n


def test_blank_query_returns_all_with_zero(spark):
    df = spark.createDataFrame(
        [(1, " ", i + 1, f"IS {i}: 2000", "t", "x", "c", [], [], 1.0) for i in range(12)],
        "qid int, query string, rank int, id string, title string, text string, category string, keywords array<string>, related_standards array<string>, importance_weight double",
    )
    got = rank.rerank(df, rank.overlap_model).collect()
    assert len(got) == 12 and {r.score for r in got} == {0.0}


def test_statistics_of_1_to_10(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "latency_seconds double")
    got = evaluate.latency_statistics(df).first()
    assert (got.median_s, got.p95_s, got.n) == (6.0, 10.0, 10)


def test_published_run(spark):
    got = evaluate.summary(data.run_results(spark)).first()
    assert (got.n_queries, got.hit_rate_3, got.mrr_5) == (10, 100.0, 0.95) and abs(got.avg_latency - 0.40028) < 1e-9


def test_confidence_by_rank(spark):
    got = [r.c for r in spark.range(1, 10).select(rationale.confidence(F.col("id")).alias("c")).collect()]
    assert got == [0.95, 0.85, 0.75, 0.65, 0.55, 0.45, 0.35, 0.3, 0.3]


def test_model_seam_failures_fall_back(spark):
    def model(prompt):
        if "bad" in prompt:
            raise RuntimeError("no answer")
        return "[]"

    df = spark.createDataFrame([("bad",), ("good",)], "prompt string")
    got = {r.prompt: r.reply for r in rationale.answered(df, model).collect()}
    assert got == {"bad": None, "good": "[]"}
