"""The runnable jobs, each run twice over whole tables into one folder, and read back as it stands then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import corpus_ingest, search_evaluation

from ..functions import lexicons as lex
from ..sources.shared import shared_folder
from . import sqlgen as g
from .domain_queries import joined
from .registry import query
from .search_queries import BENCHMARK_Q, HYBRID, SCALE_QV

_COUNT = "length(text) - length(replace(text, '{}', ''))"
_ISSUES = (
    f"concat_ws(', ', CASE WHEN length({g.strip('text')}) < 20 THEN 'Text too short or missing' END, CASE WHEN coalesce(len(keywords), 0) = 0 THEN 'No keywords extracted' END, "
    f"CASE WHEN {_COUNT.format('*')} > 50 OR {_COUNT.format('†')} > 20 THEN 'Possible text corruption (excessive symbols)' END)"
)


@query(
    f"WITH doc AS (SELECT doc_id, source, 'D' || coalesce(doc_id::VARCHAR, '') AS id, text, lower(text) AS l FROM documents WHERE length({g.strip('text')}) > 20), "
    f"cat AS (SELECT *, {g.category('l')} AS category FROM doc), key0 AS (SELECT *, {g.keywords('l', 'category')} AS k0 FROM cat), key AS (SELECT *, {g.once('k0')} AS keys FROM key0), "
    "body AS (SELECT *, list_concat([concat_ws(' ', id, CASE WHEN category <> 'general' THEN category END, nullif(array_to_string(keys[1:15], ' '), '')), substr(text, 1, 600)], "
    "CASE WHEN length(text) > 600 THEN list_transform(range(0, length(text) - 600, 800), lambda s: id || '  ' || substr(text, 601 + s, 1200)) ELSE [] END) AS bodies FROM key), "
    "c AS (SELECT doc_id, source, id, category, j AS k, bodies[j + 1] AS text, CASE WHEN j = 0 THEN keys[1:20] ELSE keys[1:10] END AS keywords FROM (SELECT *, unnest(range(0, len(bodies))) AS j FROM body)), "
    "cl AS (SELECT *, lower(text) AS l FROM c) "
    f"SELECT doc_id, source, k::INTEGER AS k, md5(text) AS text_md5, category, {g.join('keywords')} AS keywords, {g.join(g.references('text', 'id'))} AS related, {g.join(g.domains('l'))} AS domains, "
    f"{g.join('(' + g.has(lex.COMPOSITION_TERMS, 'l') + ')[1:12]')} AS composition, {g.n_has(lex.TEST_METHOD_INDICATORS, 'l')} >= 2 AS is_test_method, {_ISSUES} AS issues, {_ISSUES} = '' AS is_valid FROM cl"
)
def job1_corpus_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run finds nothing new and adds nothing."""
    chosen = corpus_ingest.Settings(f"{sf_dir}/documents.parquet", shared_folder(spark, "job1"), shared_folder(spark, "job1-checkpoint"))
    corpus_ingest.run(spark, chosen)
    chunks = corpus_ingest.run(spark, chosen)
    return chunks.select(
        "doc_id", "source", "k", F.md5("text").alias("text_md5"), "category", joined("keywords").alias("keywords"), joined("related_standards").alias("related"),
        joined("application_domains").alias("domains"), joined("composition_terms").alias("composition"), "is_test_method", F.array_join("issues", ", ").alias("issues"), "is_valid",
    )


@query(
    f"WITH {g.SCALE}, {g.LEXICAL}, {BENCHMARK_Q}, {SCALE_QV}, {HYBRID}, "
    "rel AS (SELECT q.qid, d.doc_id FROM q JOIN documents d ON contains(d.text, q.query)), "
    "a AS (SELECT qid, doc_idx, rrf_score, rank, EXISTS (SELECT 1 FROM rel WHERE rel.qid = found.qid AND rel.doc_id = found.doc_idx) AS relevant FROM found), "
    "m AS (SELECT qid, min(rank) FILTER (WHERE relevant) AS f, count(*) FILTER (WHERE relevant) AS nf, (SELECT count(*) FROM rel WHERE rel.qid = a.qid) AS nr FROM a GROUP BY qid) "
    "SELECT qid AS item_id, rank::INTEGER AS rank, doc_idx AS doc_id, rrf_score, relevant, f::INTEGER AS first_rank, nr::BIGINT AS n_relevant, coalesce(f <= 3, false) AS hit_at_3, "
    "round(CASE WHEN f <= 5 THEN 1.0 / f ELSE 0 END, 6)::DOUBLE AS rr_at_5, round(nf / nullif(nr, 0), 6)::DOUBLE AS recall, "
    "CASE WHEN f = 1 THEN 'first' WHEN f <= 3 THEN 'top3' WHEN f <= 5 THEN 'top5' WHEN f > 5 THEN 'below' WHEN nr > 0 THEN 'missed' ELSE 'no_relevant' END AS outcome FROM a JOIN m USING (qid)"
)
def job2_search_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second run replaces the first one's answers by equal ones."""
    chosen = search_evaluation.Settings(f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{sf_dir}/embeddings.parquet", shared_folder(spark, "job2-index"), shared_folder(spark, "job2"))
    search_evaluation.run(spark, chosen)
    answers = search_evaluation.run(spark, chosen)
    return answers.withColumns({c: F.round(c, 6) for c in ("rr_at_5", "recall")})
