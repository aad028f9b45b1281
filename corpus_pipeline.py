"""A corpus pipeline of five stages, each by one of the operators in standex.llm.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read again
as the next stage's docs. All but the last keep all columns of their input, extra ones too, in order (names
that begin with _sx_ are the operators' own).

For every stage: an empty table gives an empty one; rows are judged by id and text, so rows repeated whole
share their fate, and rows of one id with different texts do not; a null doc_id is a document like others and
sorts last; texts of any length are read whole. Nulls in lang, source, n_chars and extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from standex.llm import decontam, langid, line_dedup, mixing, simhash
from standex.llm.common import KEY, as_bytes, drop_folder, materialise, row_key, shared_folder, small_batches, table, without

#: Documents whose best language has a lower posterior are rejected, as are those of no language.
LEAST_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that are null, empty or without letters, and those whose score is below LEAST_SCORE:
    in a language unlike any that the labelled rows are in, or undecided between some. Where no labelled row
    was there to learn from, only those without letters go. Ties in the score's languages change nothing."""
    small_batches(spark)
    model = langid.fit_on_documents(docs)
    if not model.langs:
        model = langid.Model.of_any()
    found = langid.identify(docs.select(F.struct("*").alias("_sx_doc"), F.col("text").alias("_sx_text")), model, "_sx_text")
    return found.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select("_sx_doc.*")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the lines that an earlier document has; n_chars follows the text. A document that loses all its
    lines stays with an empty text (the next stage keeps one such); a null text stays null, with null n_chars.
    Of a line that several documents have, the smallest id keeps all its own; repeated rows keep the same."""
    small_batches(spark)
    marked = line_dedup.with_bitmaps(docs.select("doc_id", "text", F.struct("*").alias("_sx_doc")), line_dedup.keep_bitmaps(docs))

    @F.arrow_udf("string")
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, bitmaps in batches:
            kept = []
            for text, keep in zip(as_bytes(texts), bitmaps.to_pylist(), strict=True):
                kept.append(text if text is None or keep is None else line_dedup.cut(text, keep)[2])
            yield pa.array(kept, pa.binary()).cast(pa.string())

    out = marked.select("_sx_doc", cut(F.col("text"), F.col("keep")).alias("_sx_kept"))
    columns = {"text": F.col("_sx_kept"), "n_chars": F.length("_sx_kept").cast("long")}
    return out.select(*[columns[c].alias(c) if c in columns else F.col("_sx_doc").getField(c).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near duplicates (five-word shingles about 0.8 alike or more, see
    simhash.similar_classes) the document with the smallest id, of equal ids the one with the smallest hash
    of its text, and of rows repeated whole one. Texts without words (null, empty) are one class."""
    small_batches(spark)
    keyed = docs.withColumns(row_key())
    marked = simhash.similar_classes(keyed.select("text", *KEY))
    best = marked.groupBy("class").agg(F.min(F.struct(*KEY)).alias("k")).select("k.*")
    n = F.count("*").alias("_sx_n")
    again = materialise(marked.join(best, list(KEY), "left_semi").groupBy(*KEY).agg(n).where("_sx_n > 1").select(*KEY))
    gone = materialise(marked.join(best, list(KEY), "left_anti").select(*KEY))
    once = without(keyed, gone.unionByName(again), *KEY).drop(*KEY)
    if again.isEmpty():
        return once
    # rows that are repeated with the same id and text: one of them
    return once.unionByName(keyed.join(again, list(KEY), "left_semi").dropDuplicates(list(KEY)).drop(*KEY))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents of which benchmark windows cover at least a twentieth of the words. Null and empty
    texts have none and stay, as does everything where the benchmark is empty."""
    found = decontam.contamination(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    bad = materialise(found.where("contaminated").select(*KEY).distinct())
    return without(docs.withColumns(row_key()), bad, *KEY).drop(*KEY)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Emits each document as often as the mix takes it, with its `size` in words and `copy`, which numbers the
    repeats from 1 (columns of those names, in whatever case, in the input are replaced). A null source is a source of its
    own. Texts without words have size 0; they are taken as often as their source's rate says."""
    mixed = mixing.emit(mixing.mix(docs))
    kept = [c for c in docs.columns if c.lower() not in ("size", "copy")]
    return mixed.select(*[F.col("doc").getField(c).alias(c) for c in kept], "size", "copy")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
]

#: Naive Bayes and SimHash fingerprints aren't SQL; tests/llm holds run() against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of what the stages keep. Each stage's table replaces its predecessor's."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        uri = shared_folder(spark, name)
        stage(spark, docs, sf_dir).write.parquet(uri)
        docs = spark.read.parquet(uri)
        if before is not None:
            drop_folder(spark, before)
        before = uri
    return STAGES[-1][1](spark, docs, sf_dir)
