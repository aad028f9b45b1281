"""Command line: python -m standex infer|evaluate|ingest|enrich|analyze ..."""

from __future__ import annotations

import argparse
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import enrich, evaluate, reports
from .operators.index import Index
from .sources import io
from .sources.shared import clean, materialise

#: Queries between two lines of progress.
PROGRESS = 10


def _asked_together(asked: DataFrame, indexes: Index) -> DataFrame:
    """(id, retrieved_standards, latency_seconds): the set is one job, and each query's latency its share."""
    began = time.time()
    found = materialise(api.recommend(asked, indexes).withColumnRenamed("qid", "id"))
    return found.withColumn("latency_seconds", F.lit((time.time() - began) / max(found.count(), 1)))


def _asked_in_turn(spark: SparkSession, asked: DataFrame, indexes: Index) -> DataFrame:
    """The same, a job for each query with its own latency, and its progress on the way. For sets as
    small as an array file is."""
    rows, began = [], time.time()
    listed = asked.collect()
    for k, query in enumerate(listed, 1):
        start = time.time()
        one = spark.createDataFrame([query], asked.schema)
        found = api.recommend(one, indexes).first()
        rows.append((query.qid, found.retrieved_standards if found else [], time.time() - start))
        if k % PROGRESS == 0 or k == len(listed):
            rate = k / (time.time() - began)
            print(f"{k} of {len(listed)}: {rate:.2f} queries a second, {(len(listed) - k) / rate:.0f} s left", file=sys.stderr)
    return spark.createDataFrame(rows, "id string, retrieved_standards array<string>, latency_seconds double")


def infer(spark: SparkSession, args: argparse.Namespace) -> int:
    queries = io.read_queries(spark, args.input)
    asked = queries.select(F.col("id").alias("qid"), "query")
    indexes = api.build_indexes(io.read_chunks(spark, *args.chunks))
    found = _asked_in_turn(spark, asked, indexes) if args.sequential else _asked_together(asked, indexes)
    results = evaluate.clean_results(queries.join(found, "id", "left"))
    issues = evaluate.validation_issues(results)
    if not issues.isEmpty():
        issues.show(10, False)
    io.write_array(results, args.output)
    if args.verbose:
        evaluate.size_histogram(results).show()
        evaluate.latency_statistics(results).show()
    clean(spark)
    return 0


def judge(spark: SparkSession, args: argparse.Namespace) -> int:
    results = io.read_results(spark, args.results)
    if results.isEmpty():
        print("no results")
        return 0
    api.evaluate(results).show()
    return 0


def ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    from .operators.ingest import lines_of

    io.write(api.ingest(lines_of(io.read_documents(spark, args.source, io.plain_text))), args.target)
    return 0


def enrich_chunks(spark: SparkSession, args: argparse.Namespace) -> int:
    io.write(api.enrich(io.read_chunks(spark, args.source)), args.target, "json")
    return 0


def analyze(spark: SparkSession, args: argparse.Namespace) -> int:
    chunks = io.read_chunks(spark, args.source)
    for report in (reports.chunk_counts, reports.category_histogram, reports.part_histogram, reports.domain_histogram, reports.enriched_sample):
        report(chunks).show(truncate=60)
    reports.first_issues(enrich.quality_issues(chunks)).show(truncate=False)
    return 0


def main(argv: list[str]) -> int:
    parser = argparse.ArgumentParser("standex")
    commands = parser.add_subparsers(required=True)
    p = commands.add_parser("infer")
    p.add_argument("--input", "-i", required=True)
    p.add_argument("--output", "-o", required=True)
    p.add_argument("--chunks", nargs="+", required=True, help="enriched chunks, else plain ones: the first path that exists")
    p.add_argument("--sequential", action="store_true", help="one query at a time, each with its own latency; else the set is one job")
    p.add_argument("--verbose", "-v", action="store_true")
    p.set_defaults(run=infer)
    p = commands.add_parser("evaluate")
    p.add_argument("--results", required=True)
    p.set_defaults(run=judge)
    for name, run in (("ingest", ingest), ("enrich", enrich_chunks)):
        p = commands.add_parser(name)
        p.add_argument("source")
        p.add_argument("target")
        p.set_defaults(run=run)
    p = commands.add_parser("analyze")
    p.add_argument("source")
    p.set_defaults(run=analyze)
    args = parser.parse_args(argv)
    return args.run(SparkSession.builder.appName("standex").getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
