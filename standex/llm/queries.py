"""One query per operator over its whole table, each (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontam, extract, langid, line_dedup, media, mixing, simhash, spelling, sql, substring_dedup, token_count, url_filter, warc
from .common import as_bytes, drop_folder, shared_folder, stored, table

#: The vocabulary of op3, a parameter; the file is read by the driver alone.
VOCABULARY = os.environ.get("STANDEX_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract.extract(pages)


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    kept = F.coalesce("text", F.lit(""))
    return found.select(
        "doc_id", "n_removed", "n_chars_removed", spans.alias("removed_spans"),
        F.length(kept).cast("long").alias("n_chars_kept"), F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
    )


def op3_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    automaton = token_count.Automaton(*token_count.sentencepiece_vocabulary(VOCABULARY))
    return token_count.with_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), automaton)


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.document_media(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.deduplicated(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    raw, normal = shared_folder(spark, "warc-raw"), shared_folder(spark, "warc")
    archives = warc.normalise(warc.write_archives(records, raw), normal)
    drop_folder(spark, raw)  # the manifest of the normalised archives is checkpointed
    return warc.read_records(archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), "contaminated", F.col("near").alias("n_near"),
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit_on_documents(docs)
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return mixed.select("doc.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [line_dedup.cut(t, k) for t, k in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
            n, dropped, kept = zip(*cut, strict=True) if cut else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(dropped, pa.int64()),
                 pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
                ["doc_id", "n_lines", "n_dropped", "kept_sha256"],
            )

    marked = line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs))
    return marked.select("doc_id", "text", "keep").mapInArrow(digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


#: The rules of op11: verdict, host and path.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = url_filter.judge(pages, url_filter.rule_table(spark, URL_RULES))
    return found.select("page_id", "host", "path", "rule", "verdict")


#: One in so many of a document's words of op12 loses a code point.
MISSPELT = 97


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    h, run = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary")), F.col("run")
    runs = spelling.runs(docs).withColumn("h", h)
    gone = F.pmod("h", F.length("run")).cast("int")
    word = F.when(F.col("h") % MISSPELT == 0, F.concat(F.substr(run, F.lit(1), gone), F.substr(run, gone + 2))).otherwise(run)
    found = spelling.grouped(stored(spelling.counted(runs, word), "words"))
    return found.select("word", "form", "root", "n", "n_near", "form_n")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_text": op1_html_text,
        "op2_substring_dedup": op2_substring_dedup,
        "op3_token_count": op3_token_count,
        "op4_media": op4_media,
        "op5_warc": op5_warc,
        "op6_decontamination": op6_decontamination,
        "op7_language_id": op7_language_id,
        "op8_source_mix": op8_source_mix,
        "op9_simhash": op9_simhash,
        "op10_line_dedup": op10_line_dedup,
        "op11_url_filter": op11_url_filter,
        "op12_spelling": op12_spelling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_substring_dedup": sql.SUBSTRING_DEDUP,
        "op5_warc": sql.WARC,
        "op6_decontamination": sql.DECONTAMINATION,
        "op8_source_mix": sql.MIXING,
        "op10_line_dedup": sql.LINE_DEDUP,
        "op11_url_filter": sql.URL_FILTER,
        "op12_spelling": sql.SPELLING,
    }
