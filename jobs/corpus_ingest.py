"""Keeps the chunk corpus of a growing folder of documents.

A file stream over the documents takes the files that are new since the last run, and ends when there are no more.
Each document is cut into overlapping chunks, each chunk gets its category, keywords, references, fields of use and
quality issues, and is appended to Parquet partitioned by is_valid and category: what search indexes read is one
partition filter away, and so are the faulty chunks. Spark's checkpoint says which files were taken, and the sink's own
log which of its files count, so a run that is cut off or repeated neither loses nor repeats a chunk.

Rows are independent and nothing is shuffled; memory doesn't grow with what was taken before. Documents of 20
characters or fewer (null and blank ones too) make no chunk. A document that comes again in a new file is
chunked again. Further columns of the documents aren't read.

    python -m jobs.corpus_ingest --config jobs/corpus_ingest.toml
"""

from __future__ import annotations

import logging
import sys
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standex.functions import text
from standex.operators import enrich, ingest
from standex.sources import io
from standex.streaming.progress import Progress

from . import settings

log = logging.getLogger("corpus_ingest")

DOCUMENTS = "doc_id long, text string, source string"
#: Longest text, in characters, that is too short for a standard.
SHORT = 20


@dataclass(frozen=True)
class Settings:
    #: Parquet documents (doc_id, text, source): a folder that grows, or a file.
    documents: str
    #: The chunks' folder and the stream's checkpoint.
    target: str
    checkpoint: str
    #: Files of documents that are taken at once.
    files_per_batch: int = 100


def chunks_of(documents: DataFrame) -> DataFrame:
    """Enriched chunks of documents, each by itself."""
    kept = documents.where(F.length(text.strip(F.coalesce("text", F.lit("")))) > SHORT)
    titled = kept.select("doc_id", "source", F.concat(F.lit("D"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("id"), F.lit("").alias("title"), "text")
    return enrich.quality_issues(enrich.enrich(ingest.cut(ingest.described(titled))))


def run(spark: SparkSession, settings: Settings) -> DataFrame:
    """Takes what is new; returns all chunks that were ever taken."""
    made = chunks_of(io.stream(spark, settings.documents, DOCUMENTS, settings.files_per_batch))
    writer = made.writeStream.format("parquet").partitionBy("is_valid", "category").outputMode("append")
    writer = writer.option("path", settings.target).option("checkpointLocation", settings.checkpoint).trigger(availableNow=True)
    with Progress(spark, log) as progress:
        stream = writer.start()
        stream.awaitTermination()
        progress.wait(stream)
    log.info("read %d new documents in %d batches from %s", progress.rows, progress.batches, settings.documents)
    if not io.exists(spark, settings.target):
        return spark.createDataFrame([], made.schema)
    chunks = spark.read.schema(made.schema).parquet(settings.target)
    log.info("%s holds %d chunks", settings.target, chunks.count())
    return chunks


def main(argv: list[str]) -> int:
    chosen = settings.read(Settings, argv, "Cuts new documents into enriched chunks.")
    spark = SparkSession.builder.appName("corpus_ingest").getOrCreate()
    log.info("settings: %s", asdict(chosen))
    run(spark, chosen)
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
