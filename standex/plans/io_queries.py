"""Sources, sinks and the calls of the API: written, read back, and compared with what went in."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import api
from ..operators import client, index, rank, rationale
from ..sources import io
from ..sources.shared import shared_folder
from . import data
from . import sqlgen as g
from .domain_queries import CARDS, FAULTY_SQL, RECOMMEND, _faulty, _known, joined
from .registry import query
from .search_queries import BENCHMARK_Q, HYBRID


@query(f"WITH {g.ENRICHED} SELECT doc_idx, id, md5(text) AS text_md5, category, {g.join('keywords')} AS keywords, {g.join('related_standards')} AS related, is_test_method FROM enriched")
def chunk_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks written as Parquet, read, enriched, written as JSON lines, and read again: doc_idx stays."""
    plain, rich = shared_folder(spark, "chunks"), shared_folder(spark, "enriched")
    io.write(data.domain_chunks(spark, sf_dir), plain)
    io.write(api.enrich(io.read_chunks(spark, plain)), rich, "json")
    back = io.read_chunks(spark, f"{rich}-none", rich)
    return back.select("doc_idx", "id", F.md5("text").alias("text_md5"), "category", joined("keywords").alias("keywords"), joined("related_standards").alias("related"), "is_test_method")


@query(f"WITH {FAULTY_SQL} SELECT id, query, {g.join('e')} AS expected, {g.join('g')} AS retrieved, s AS latency_seconds FROM (SELECT id, query, string_split(e, ';') AS e, string_split(g, ';') AS g, s FROM f)")
def result_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as JSON lines and read with their schema."""
    uri = shared_folder(spark, "results")
    io.write(_faulty(spark, sf_dir), uri, "json")
    back = io.read_results(spark, uri)
    return back.select("id", "query", joined("expected_standards").alias("expected"), joined("retrieved_standards").alias("retrieved"), "latency_seconds")


@query(
    f"WITH {g.CORPUS}, w AS (SELECT doc_idx, list_filter(regexp_split_to_array(lower(search_text), '\\s+'), lambda x: x <> '') AS w FROM corpus) "
    "SELECT doc_idx, 64 AS dimensions, CASE WHEN len(w) > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm FROM w"
)
def encoded_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the default encoder have unit length."""
    corpus = data.domain_corpus(spark, sf_dir).select("doc_idx", "search_text")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    return api.encode(corpus, "doc_idx", "search_text").select("doc_idx", F.size("embedding").alias("dimensions"), F.round(norm, 5).alias("norm"))


#: Blank queries, and how many chunks each is given.
BLANKS, GIVEN = [(1, ""), (2, " \t "), (3, None)], 20


@query(f"WITH {g.CORPUS}, {data.values('q', 'qid, query', BLANKS)} SELECT qid, doc_idx, 0.0::DOUBLE AS score, (doc_idx + 1)::INTEGER AS rank FROM q, corpus WHERE doc_idx < {GIVEN}")
def blank_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank query gets all its candidates back, in order, with score 0."""
    chunks = data.domain_enriched(spark, sf_dir).where(F.col("doc_idx") < GIVEN)
    asked = data.literal(spark, "qid, query", BLANKS).withColumn("ids", F.sequence(F.lit(0), F.lit(GIVEN - 1)).cast("array<long>"))
    listed = asked.select("qid", "query", F.explode("ids").alias("doc_idx"))
    candidates = listed.join(chunks, "doc_idx").withColumn("rank", (F.col("doc_idx") + 1).cast("int"))
    return rank.rerank(candidates, rank.overlap_model).select("qid", "doc_idx", "score", "rank")


#: Chunks that each canned query's prompt is given; a prompt shows five of them.
SHOWN = 7
_DOC = "id || ': ' || coalesce(title, '') || ' — ' || substr(text, 1, 300)"


@query(
    f"WITH {g.CORPUS}, {data.values('q', 'qid, query', data.PUBLIC)}, c AS (SELECT q.qid, q.query, doc_idx - q.qid * {SHOWN} AS k, id, {_DOC} AS d FROM q JOIN corpus ON doc_idx // {SHOWN} = q.qid), "
    "p AS (SELECT qid, query, string_agg('- ' || id, chr(10) ORDER BY k) AS ids, string_agg(d, chr(10) || chr(10) ORDER BY k) FILTER (WHERE k < 5) AS docs FROM c GROUP BY ALL) "
    "SELECT qid, 'Explain in one line each why these standards fit the query. Use only the context. Add and change no standard.' || chr(10) || chr(10) || 'Query: ' || query || chr(10) || chr(10) || "
    "'Standards:' || chr(10) || ids || chr(10) || chr(10) || 'Context:' || chr(10) || docs || chr(10) || chr(10) || 'Answer as JSON: [{\"standard\": \"...\", \"reason\": \"...\"}]' AS prompt FROM p"
)
def model_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language model's input: five documents, 300 characters of each."""
    k = F.floor(F.col("doc_idx") / SHOWN)
    own = data.domain_chunks(spark, sf_dir).join(data.public_queries(spark), k == F.col("qid"))
    docs = own.groupBy("qid", "query").agg(F.array_sort(F.collect_list(F.struct("doc_idx", "id", "title", "text"))).alias("docs"))
    return docs.select("qid", rationale.prompt(F.col("query"), F.transform("docs", lambda d: d["id"]), F.col("docs")).alias("prompt"))


@query(f"WITH {FAULTY_SQL} SELECT id, query, {g.join('e')} AS expected, {g.join('g')} AS retrieved, s AS latency_seconds FROM (SELECT id, query, string_split(e, ';') AS e, string_split(g, ';') AS g, s FROM f)")
def array_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results written as one JSON array, and read."""
    uri = f"{shared_folder(spark, 'results')}/deeper/results.json"
    io.write_array(_faulty(spark, sf_dir), uri)
    back = io.read_results(spark, uri)
    return back.select("id", "query", joined("expected_standards").alias("expected"), joined("retrieved_standards").alias("retrieved"), "latency_seconds")


@query("SELECT item_id::VARCHAR AS id, text AS query, 'b' || item_id AS expected FROM benchmark")
def query_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries written as one JSON array, and read with their schema."""
    uri = f"{shared_folder(spark, 'queries')}/queries.json"
    items = data.table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("query"))
    io.write_array(items.withColumn("expected_standards", F.array(F.concat(F.lit("b"), "id"))), uri)
    return io.read_queries(spark, uri).select("id", "query", joined("expected_standards").alias("expected"))


@query(
    f"WITH {CARDS} SELECT qid, qid AS filename_part, to_json({{'generated_on': '2020-01-01T00:00:00Z', 'query': qid, 'results': list({{'rank': rank, 'id': std_id, 'title': title}} ORDER BY rank, std_id, title)}})::VARCHAR AS payload "
    "FROM cards GROUP BY qid"
)
def export_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each dataset's cards as a JSON document to download, under a name made of its query."""
    shown = client.cards(_known(spark, sf_dir), client.catalogue(spark))
    rows = shown.select("qid", F.col("qid").alias("query"), "rank", F.col("std_id").alias("id"), "title")
    return client.export(rows, F.lit("2020-01-01T00:00:00Z"))


# ---- the calls of the API, with a model of texts that SQL can state ------------------------------

#: Dimensions of the model: a text's vector is the unit vector of its length's remainder.
LENGTHS = 8
_UNIT = "list_transform(range(8), lambda i: CASE WHEN i = length({}) % 8 THEN 1.0 ELSE 0.0 END)"
_VECTORS = f"embeddings AS (SELECT doc_idx AS vec_id, {_UNIT.format('search_text')} AS embedding FROM corpus)"
_QV = f"qv AS (SELECT qid, {_UNIT.format('query')} AS embedding FROM q)"


def lengths(texts: list[str]) -> np.ndarray:
    return np.eye(LENGTHS, dtype=np.float32)[[len(t) % LENGTHS for t in texts]]


_INDEXES: dict[tuple[str, str], str] = {}


def _opened(spark: SparkSession, sf_dir: str) -> index.Index:
    """An index of the derived corpus, built by the API once and opened from its path."""
    key = (spark.sparkContext.applicationId, data.state(spark, sf_dir, "part"))
    if key not in _INDEXES:
        uri = shared_folder(spark, "api-index")
        api.build_indexes(data.domain_enriched(spark, sf_dir), uri, lengths).vectors.write.parquet(f"{uri}/vectors")
        _INDEXES[key] = uri
    return index.Index.load(spark, _INDEXES[key], spark.read.parquet(f"{_INDEXES[key]}/vectors"))


_DOMAIN = f"{g.CORPUS}, {_VECTORS}, {g.LEXICAL}"


@query(f"WITH {_DOMAIN}, {BENCHMARK_Q}, {_QV}, {HYBRID} SELECT qid, doc_idx, rrf_score, rank::INTEGER AS rank FROM found")
def api_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return api.hybrid_search(data.scale_queries(spark, sf_dir), _opened(spark, sf_dir), model=lengths)


#: The canned queries' vectors are of the queries as they were asked.
_RECOMMEND = RECOMMEND.replace(f"WITH {g.CORPUS}, {g.LEXICAL}, ", f"WITH {_DOMAIN}, ").replace(
    "qv AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id IN (SELECT qid FROM q))", f"qv AS (SELECT qid, {_UNIT.format('query')} AS embedding FROM q0)"
)


@query(_RECOMMEND)
def api_recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = api.recommend(data.public_queries(spark), _opened(spark, sf_dir), model=lengths)
    return found.select("qid", F.array_join("retrieved_standards", "; ").alias("retrieved_standards"))


@query(_RECOMMEND.split("SELECT q.qid, coalesce((SELECT string_agg")[0] + "SELECT qid, std_id AS id, pos::INTEGER AS rank, round(greatest(0.95 - (pos - 1) * 0.1, 0.3), 3)::DOUBLE AS confidence FROM padded")
def api_rationales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations with a reason each; the reasons' texts are template_rationale's."""
    _, reasons = api.recommend_with_rationale(data.public_queries(spark), _opened(spark, sf_dir), model=lengths)
    return reasons.select("qid", "id", F.col("rank").cast("int").alias("rank"), "confidence")
