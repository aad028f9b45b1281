"""Reranking, truncation by score gaps, deduplication by version, padding, the whole pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..sources.shared import materialise
from .index import Index
from .search import hybrid

CANDIDATES, MAX_CHARS = 8, 250
LEAST, MOST, RESULTS, GAP, PAD = 3, 8, 5, 0.15, 0.5


def pair_text() -> Column:
    """What a pair scorer reads of a chunk: compact, at most 250 characters."""
    parts = [
        *[text.full(text.strip(F.coalesce(c, F.lit("")))) for c in ("id", "title", "category")],
        text.full(text.list_to_string(F.col("keywords"), 5)), text.full(text.list_to_string(F.col("related_standards"), 3)),
        text.full(F.substring(text.strip(F.coalesce("text", F.lit(""))), 1, 120)),
    ]
    return F.substring(text.strip(F.concat_ws(" ", *parts)), 1, MAX_CHARS)


def metadata_factor(query: Column, named: Column, importance: Column) -> Column:
    """The factor of a model's score: importance, shared numbers in id and title, the part."""
    shared = F.arrays_overlap(ids.is_numbers(query), ids.is_numbers(named))
    q, d = ids.part(query, ids.PART_LOOSE), ids.part(named, ids.PART_LOOSE)
    part = F.when(q.isNull() | d.isNull(), 1.0).when(q == d, 1.1).otherwise(0.95)
    return F.coalesce(importance, F.lit(1.0)) * F.when(shared, 1.2).otherwise(1.0) * part


def rule_score(query: Column, std_id: Column, importance: Column) -> Column:
    """The deterministic scorer: needs no model."""
    std_id = F.coalesce(std_id, F.lit(""))
    shared = F.arrays_overlap(ids.is_numbers(query, ids.NUMBERS_LOOSE), ids.is_numbers(std_id, ids.NUMBERS_LOOSE))
    q, d = ids.part(query, ids.PART_LOOSE), ids.part(std_id, ids.PART_LOOSE)
    part = F.when(q.isNull() | d.isNull(), 1.0).when(q == d, 1.2).otherwise(0.8)
    return F.coalesce(importance, F.lit(1.0)) * F.when(shared, 1.3).otherwise(1.0) * part


def overlap_model(query: Column, body: Column) -> Column:
    """The default stand-in for a pair model: a tenth for each query token that the text has."""
    return F.size(F.array_intersect(text.tokenize(query), text.tokenize(body))).cast("double") / 10


Scorer = Callable[[Column, Column], Column]


def rerank(candidates: DataFrame, scorer: Scorer | None = None, most: int = CANDIDATES) -> DataFrame:
    """(qid, ..., score, rank) of (qid, query, rank, chunk columns).

    With a scorer (a Column function; a pandas_udf is one) the first `most` candidates are scored
    and boosted; a null score counts as 0; a blank query returns all candidates with 0. Without
    one, the rules score all. Equal scores keep their order."""
    if scorer is None:
        score = rule_score(F.col("query"), F.col("id"), F.col("importance_weight"))
        kept = candidates
    else:
        blank = text.strip(F.coalesce("query", F.lit(""))) == ""
        named = F.concat_ws(" ", F.coalesce("id", F.lit("")), F.coalesce("title", F.lit("")))
        model = F.coalesce(scorer(F.col("query"), pair_text()), F.lit(0.0))
        score = F.when(blank, 0.0).otherwise(model * metadata_factor(F.col("query"), named, F.col("importance_weight")))
        kept = candidates.where((F.col("rank") <= most) & (F.length(pair_text()) > 0) | blank)
    scored = kept.withColumnRenamed("rank", "prior").withColumn("score", F.round(score, 9))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "prior")
    return scored.withColumn("rank", F.row_number().over(order)).drop("prior")


def truncate(scored: DataFrame, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Cuts each query's list (qid, rank, score) before the first large gap after `least` rows."""
    order = Window.partitionBy("qid").orderBy("rank")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    gap = F.abs(F.lag("score").over(order) - F.col("score"))
    marked = scored.withColumns({"_top": F.first("score").over(whole), "_n": F.count("*").over(whole), "_gap": gap})
    at = F.when(F.col("rank").between(least + 1, most) & (F.col("_gap") > GAP * F.abs("_top")), F.col("rank"))
    cut = marked.withColumn("_cut", F.min(at).over(whole))
    keep = F.when(F.col("_n") <= least, F.lit(True)).when(F.col("_top") <= 0, F.col("rank") <= least)
    keep = keep.otherwise(F.col("rank") < F.coalesce("_cut", F.lit(most + 1)))
    return cut.where(keep).drop("_top", "_n", "_gap", "_cut")


def version_dedup(ranked: DataFrame, most: int = RESULTS) -> DataFrame:
    """(qid, std_id, doc_idx, pos) of (qid, rank, doc_idx, id, standard_year): the best version of each
    standard, in order of the versions' ranks; then other versions until there are `most`."""
    named = ranked.withColumn("std_id", ids.format_standard_id(F.col("id"))).where(ids.is_valid(F.col("std_id")))
    named = named.withColumn("_key", ids.base_key(F.col("std_id"))).withColumn("_year", ids.year_at_end(F.col("std_id")))
    same = F.coalesce(F.col("_year") == F.col("standard_year"), F.lit(False))
    best = Window.partitionBy("qid", "_key").orderBy(F.desc(same), F.when(same, 0).otherwise(-F.col("_year")), "rank")
    marked = named.withColumn("_loser", F.row_number().over(best) > 1)
    first = Window.partitionBy("qid", "std_id").orderBy("_loser", "rank")
    once = marked.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    order = Window.partitionBy("qid").orderBy("_loser", "rank")
    return once.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= most).select("qid", "std_id", "doc_idx", "pos")


def pad(emitted: DataFrame, candidates: DataFrame, top: DataFrame, most: int = RESULTS) -> DataFrame:
    """Fills lists shorter than `most` with candidates (qid, rank, doc_idx, id, rrf_score) whose score is
    at least half the top score of (qid, top); ids need not be valid, only new."""
    short = emitted.groupBy("qid").agg(F.max("pos").alias("n"))
    named = candidates.withColumn("std_id", ids.format_standard_id(F.col("id"))).join(top, "qid").join(short, "qid", "left")
    fit = named.where((F.col("rrf_score") >= PAD * F.abs("top")) & (F.coalesce("std_id", F.lit("")) != ""))
    new = fit.join(emitted.select("qid", "std_id"), ["qid", "std_id"], "left_anti")
    first = Window.partitionBy("qid", "std_id").orderBy("rank")
    once = new.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    order = Window.partitionBy("qid").orderBy("rank")
    pos = (F.coalesce("n", F.lit(0)) + F.row_number().over(order)).cast("int")
    more = once.withColumn("pos", pos).where(F.col("pos") <= most).select("qid", "std_id", "doc_idx", "pos")
    return emitted.select("qid", "std_id", "doc_idx", "pos").unionByName(more)


def recommend_rows(queries: DataFrame, query_vectors: DataFrame, index: Index, scorer: Scorer | None = overlap_model) -> DataFrame:
    """(qid, std_id, doc_idx, pos): queries expanded, searched, reranked, cut, deduplicated, padded."""
    expanded = queries.select("qid", text.expand_query(F.col("query")).alias("query"))
    found = materialise(hybrid(expanded, query_vectors, index))  # 20 rows a query, read twice below
    candidates = found.join(index.corpus, "doc_idx").join(queries.select("qid", "query"), "qid")
    scored = materialise(truncate(rerank(candidates, scorer)).select("qid", "doc_idx", "id", "standard_year", "score", "rank"))
    top = scored.where("rank = 1").select("qid", F.col("score").alias("top"))
    return pad(version_dedup(scored), candidates, top)


def recommend(queries: DataFrame, query_vectors: DataFrame, index: Index, scorer: Scorer | None = overlap_model) -> DataFrame:
    """(qid, retrieved_standards); a query without results has an empty list."""
    rows = recommend_rows(queries, query_vectors, index, scorer)
    lists = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("pos", "std_id"))).alias("r"))
    out = queries.select("qid").join(lists, "qid", "left")
    named = F.transform("r", lambda s: s["std_id"])
    return out.select("qid", F.coalesce(named, F.array().cast("array<string>")).alias("retrieved_standards"))
