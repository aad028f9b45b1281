"""The public calls: ingest, enrich, build_indexes, hybrid_search, recommend, explain, evaluate."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import enrich as enriching
from .operators import evaluate as evaluating
from .operators import index as indexing
from .operators import ingest as ingesting
from .operators import rank, rationale, search
from .sources.shared import materialise

#: Dimensions of the default encoder.
DIMENSIONS = 64


def ingest(lines: DataFrame) -> DataFrame:
    """Chunks of raw lines (src_id, page_no, line_no, line)."""
    return ingesting.chunks(ingesting.number_standards(ingesting.segment(lines)))


def enrich(chunks: DataFrame) -> DataFrame:
    return enriching.enrich(chunks)


def encode(rows: DataFrame, key: str, body: str, model: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """(key, embedding): unit vectors of texts. The model is a seam; without one, tokens are hashed
    into DIMENSIONS signed cells, which needs no download and gives equal texts equal vectors."""

    def hashed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), DIMENSIONS), np.float32)
        for i, t in enumerate(texts):
            for word in (t or "").lower().split():
                h = zlib.crc32(word.encode())
                out[i, h % DIMENSIONS] += 1 if h & 0x10000 else -1
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = np.asarray((model or hashed)(batch[body].tolist()), np.float32)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            yield pd.DataFrame({key: batch[key], "embedding": list(x)})

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, body).mapInPandas(run, f"{key} {kind}, embedding array<float>")


def build_indexes(chunks: DataFrame, path: str | None = None, model: Callable[[list[str]], np.ndarray] | None = None) -> indexing.Index:
    """The index of enriched chunks with doc_idx, kept at path."""
    corpus = chunks.withColumn("search_text", indexing.search_text())
    return indexing.build(corpus, encode(corpus, "doc_idx", "search_text", model), path)


def add_to_indexes(chunks: DataFrame, indexes: indexing.Index, path: str, model: Callable[[list[str]], np.ndarray] | None = None) -> indexing.Index:
    """The index at path (indexes, opened) with more enriched chunks, of new doc_idx; only these are read and encoded."""
    corpus = chunks.withColumn("search_text", indexing.search_text())
    vectors = indexes.vectors.unionByName(encode(corpus, "doc_idx", "search_text", model))
    return indexing.append(corpus, vectors, path)


def hybrid_search(queries: DataFrame, indexes: indexing.Index, k: int = search.TOP_K, model: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """(qid, doc_idx, rrf_score, rank) of (qid, query)."""
    return search.hybrid(queries, encode(queries, "qid", "query", model), indexes, k)


def recommend(queries: DataFrame, indexes: indexing.Index, scorer: rank.Scorer | None = rank.overlap_model, model: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """(qid, retrieved_standards) of (qid, query): a whole query set in one run."""
    return rank.recommend(queries, encode(queries, "qid", "query", model), indexes, scorer)


def explain(queries: DataFrame, rows: DataFrame, indexes: indexing.Index, model: Callable[[str], str] | None = None) -> DataFrame:
    """(qid, id, rationale, confidence, rank) of recommended rows (qid, std_id, doc_idx, pos): by a language
    model (prompt to reply, called on the executors once a query) or, without one, by templates."""
    if model is not None:
        return rationale.explained(queries, rows, indexes.corpus, model)
    docs = indexes.corpus.select("doc_idx", "title", "text")
    ranked = rows.join(docs, "doc_idx").join(queries.select("qid", "query"), "qid")
    return rationale.rationales(ranked.select("qid", "query", F.col("pos").alias("rank"), F.col("std_id").alias("id"), "title", "text"))


def recommend_with_rationale(
    queries: DataFrame, indexes: indexing.Index, scorer: rank.Scorer | None = rank.overlap_model, model: Callable[[list[str]], np.ndarray] | None = None,
    writer: Callable[[str], str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(recommended rows (qid, std_id, doc_idx, pos), their rationales)."""
    rows = materialise(rank.recommend_rows(queries, encode(queries, "qid", "query", model), indexes, scorer))
    return rows, explain(queries, rows, indexes, writer)


def score_single(query: str, chunk: DataFrame, scorer: rank.Scorer | None = rank.overlap_model) -> float:
    """The reranker's score of one chunk (a frame of one row) for one query; 0 where it has nothing to read."""
    found = rank.rerank(chunk.select(F.lit(0).alias("qid"), F.lit(query).alias("query"), F.lit(1).alias("rank"), "*"), scorer).first()
    return float(found.score) if found else 0.0


def evaluate(results: DataFrame) -> DataFrame:
    return evaluating.summary(results)
