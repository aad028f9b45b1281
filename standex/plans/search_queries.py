"""Text, identifiers, lexical and dense search, learned maps, fusion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import index, search
from ..sources.shared import exists, shared_folder
from . import data
from . import sqlgen as g
from .registry import query

Q_VALUES = data.values("q", "qid, query", data.PUBLIC)
#: Queries with misspellings, abbreviations, ids in several spellings, blanks and repeated words.
SPELLINGS = [
    (1, "  Portand cememnt   PPC for reinfored work "), (2, "is-269 and IS 455 (Part 2) sec-3"), (3, "what is 33 grade OPC"),
    (4, "sand for mortar and coarse aggregate gravel"), (5, ""), (6, "   "), (7, "hollow block hollow block aac AC sheet"),
    (8, "which standard is the standard IS 269 part 1 part 1"), (9, "low heat marine slag cement roofing cladding culvert"),
]
ID_TEXTS = [
    (1, "IS 269 : 1989"), (2, "IS 8112:1989"), (3, "IS 459"), (4, "IS 1489(Part 2):1991"), (5, "IS 2185 (Part 2) 1983"), (6, "IS 2185 (Part 3)"),
    (7, "IS 1489 (Part 9)"), (8, "IS 99999"), (9, "no identifier"), (10, ""), (11, " is 383-1970 "), (12, "IS 2185 (Part 1) (Sec 2): 1979"),
    (13, "IS 4031 (Part 1)"), (14, "See IS 269 and IS 455 (Part 2): 1989; IS 269"), (15, "IS 1237 superseded by IS 13801: 2013"), (16, "this 45 and IS456"),
]
ID_ROWS = data.values("v", "i, raw", ID_TEXTS)
#: Queries that are asked: the ones above, the canned ones, and what users say in conversations, each with one of these behind it.
_PHRASES = [*SPELLINGS, *[(100 + i, q) for i, q in data.PUBLIC]]
_NUMBERED = data.values("phrases", "k, qid, query", [(k, *row) for k, row in enumerate(_PHRASES)])
_ASKED = (
    "SELECT CAST(qid AS BIGINT) AS qid, query FROM phrases UNION ALL "
    f"SELECT CAST(1000 + c.conv_id * 1000 + c.turn AS BIGINT), c.text || ' ' || p.query FROM conversations c JOIN phrases p ON p.k = c.conv_id % {len(_PHRASES)} WHERE c.role = 'user'"
)
ASKED = f"{_NUMBERED}, q AS ({_ASKED})"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(qid, query): the literal queries and those of the conversations."""
    return spark.sql(f"WITH {_NUMBERED} {_ASKED.replace('FROM conversations c', 'FROM {conversations} c')}", conversations=data.table(spark, sf_dir, "conversations"))


@query(f"WITH t AS (SELECT doc_id, {g.tokens('text')} AS w FROM documents) SELECT doc_id, len(w)::BIGINT AS n_tokens, len(list_distinct(w))::BIGINT AS n_distinct, md5({g.join('w', ' ')}) AS tokens_md5 FROM t")
def tokenize_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = data.table(spark, sf_dir, "documents").select("doc_id", text.tokenize(F.col("text")).alias("w"))
    return t.select(
        "doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"),
        F.md5(F.array_join("w", " ").cast("binary")).alias("tokens_md5"),
    )


@query(f"WITH {ASKED} SELECT qid, {g.normal_query('query')} AS normalized FROM q")
def normalize_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("qid", text.normalize_query(F.col("query")).alias("normalized"))


@query(f"WITH {ASKED}, n AS (SELECT qid, {g.normal_query('query')} AS n FROM q) SELECT qid, {g.expanded('n')} AS expanded FROM n")
def expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("qid", text.expand_query(F.col("query")).alias("expanded"))


@query(f"WITH {ASKED}, n AS (SELECT qid, {g.words(g.normal_query('query'))} AS w FROM q) SELECT qid, len(w)::BIGINT AS n_words, array_to_string(({g.once('w')})[1:5 * len(w)], ' ') AS deduped FROM n")
def token_dedup_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = text.split_words(text.normalize_query(F.col("query")))
    rows = asked(spark, sf_dir).select("qid", words.alias("w"))
    deduped = F.array_join(F.slice(F.array_distinct("w"), 1, F.size("w") * 5), " ")
    return rows.select("qid", F.size("w").cast("long").alias("n_words"), deduped.alias("deduped"))


@query(f"WITH {g.RAW}, {ID_ROWS}, b AS (SELECT i AS key, raw FROM v UNION ALL SELECT 1000 + std_seq, id FROM raw) SELECT key, {g.formatted('raw')} AS std_id, {g.valid(g.formatted('raw'))} AS is_valid FROM b")
def format_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.literal(spark, "key, raw", ID_TEXTS).select(F.col("key").cast("long").alias("key"), "raw")
    corpus = data.standards(spark, sf_dir).select((F.col("std_seq") + 1000).alias("key"), F.col("id").alias("raw"))
    made = rows.unionByName(corpus).select("key", ids.format_standard_id(F.col("raw")).alias("std_id"))
    return made.select("key", "std_id", ids.is_valid(F.col("std_id")).alias("is_valid"))


@query(f"WITH {g.RAW}, f AS (SELECT std_seq, {g.formatted('id')} AS f FROM raw) SELECT std_seq, {g.base_key('f')} AS base_key, {g.year_end('f')} AS year, {g.part_of('f')} AS part, lower(replace(f, ' ', '')) AS plain FROM f")
def base_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = data.standards(spark, sf_dir).select("std_seq", ids.format_standard_id(F.col("id")).alias("f"))
    c = F.col("f")
    return f.select("std_seq", ids.base_key(c).alias("base_key"), ids.year_at_end(c).alias("year"), ids.part(c).alias("part"), ids.normalize_id(c).alias("plain"))


@query(f"WITH {g.RAW}, {ID_ROWS}, b AS (SELECT i AS key, raw FROM v UNION ALL SELECT 1000 + std_seq, text FROM raw) SELECT key, {g.join(g.numbers('raw'))} AS numbers, {g.join(g.numbers('raw', g.LOOSE_RE))} AS loose, {g.part_of('raw', '(?i)part[\\s\\-]*(\\d+)')} AS part FROM b")
def extract_is_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.literal(spark, "key, raw", ID_TEXTS).select(F.col("key").cast("long").alias("key"), "raw")
    b = rows.unionByName(data.standards(spark, sf_dir).select((F.col("std_seq") + 1000).alias("key"), F.col("text").alias("raw")))
    x = F.col("raw")
    return b.select(
        "key", F.array_join(ids.is_numbers(x), "|").alias("numbers"), F.array_join(ids.is_numbers(x, ids.NUMBERS_LOOSE), "|").alias("loose"),
        ids.part(x, ids.PART_LOOSE).alias("part"),
    )


@query(f"WITH {g.RAW} SELECT std_seq, {g.join(g.references('text', 'id'))} AS related FROM raw")
def related_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ids.related_standards(F.col("text"), F.col("id"))
    return data.standards(spark, sf_dir).select("std_seq", F.array_join(own, "|").alias("related"))


@query(f"WITH {g.RAW}, {ID_ROWS}, b AS (SELECT i AS key, raw FROM v UNION ALL SELECT 1000 + std_seq, text FROM raw) SELECT key, 'IS ' || {g.group('raw', r'(?i)(?:superseded|replaced|revised)\s+by\s+IS\s+(\d+(?:\s*:\s*\d{4})?)')} AS superseded_by FROM b")
def superseded(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.literal(spark, "key, raw", ID_TEXTS).select(F.col("key").cast("long").alias("key"), "raw")
    b = rows.unionByName(data.standards(spark, sf_dir).select((F.col("std_seq") + 1000).alias("key"), F.col("text").alias("raw")))
    return b.select("key", ids.superseded_by(F.col("raw")).alias("superseded_by"))


#: Indexes and their folders by application, lane and state of the tables: an index is built once and asked many times, until a
#: table changes or its folder is dropped.
_BUILT: dict[tuple[str, str, str], tuple[str, index.Index]] = {}


def _built(spark: SparkSession, lane: str, sf_dir: str, corpus: Callable[[SparkSession, str], DataFrame]) -> index.Index:
    key = (spark.sparkContext.applicationId, lane, data.state(spark, sf_dir, "documents", "part", "embeddings"))
    if key not in _BUILT or not exists(spark, f"{_BUILT[key][0]}/stats"):
        path = shared_folder(spark, "index")
        _BUILT[key] = path, index.build(corpus(spark, sf_dir), data.vectors(spark, sf_dir, "doc_idx"), path)
    return _BUILT[key][1]


def scale_index(spark: SparkSession, sf_dir: str) -> index.Index:
    """The index over documents, with embeddings as vectors."""
    return _built(spark, "scale", sf_dir, data.scale_corpus)


BENCHMARK_Q = "q AS (SELECT item_id AS qid, text AS query FROM benchmark)"
PLAIN_TOKENS = f"qt AS (SELECT qid, query, {g.tokens('query')} AS w FROM q)"


@query(f"WITH {g.SCALE}, {g.LEXICAL}, {BENCHMARK_Q}, {PLAIN_TOKENS}, {g.bm25('qt')} SELECT qid, doc_idx, score::DOUBLE AS score, rank::INTEGER AS rank FROM lex")
def index_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical search of an index that was built of even documents and added the odd ones to."""
    corpus, vectors, uri = data.scale_corpus(spark, sf_dir), data.vectors(spark, sf_dir, "doc_idx"), shared_folder(spark, "segments")
    index.build(corpus.where("doc_idx % 2 = 0"), vectors, uri)
    idx = index.append(corpus.where("doc_idx % 2 <> 0"), vectors, uri)
    queries = data.scale_queries(spark, sf_dir)
    return search.lexical_ranks(queries, search.query_tokens(queries), idx)


def _scale(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, index.Index]:
    return data.scale_queries(spark, sf_dir), scale_index(spark, sf_dir)


@query(f"WITH {g.SCALE}, {g.LEXICAL} SELECT term, df::BIGINT AS df FROM vocab")
def doc_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.frequencies(index.tokens(data.scale_corpus(spark, sf_dir)))


@query(f"WITH {g.SCALE}, {g.LEXICAL} SELECT n::BIGINT AS n, round(avgdl, 6) AS avgdl, round(avg_idf, 6) AS avg_idf FROM stats")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _scale(spark, sf_dir)[1].stats
    return stats.select("n", F.round("avgdl", 6).alias("avgdl"), F.round("avg_idf", 6).alias("avg_idf"))


@query(f"WITH {g.SCALE}, {g.LEXICAL}, {BENCHMARK_Q}, {PLAIN_TOKENS}, {g.bm25('qt')} SELECT qid, doc_idx, score::DOUBLE AS score, rank::INTEGER AS rank FROM lex")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, idx = _scale(spark, sf_dir)
    return search.lexical_ranks(queries, search.query_tokens(queries), idx)


@query(f"WITH qv AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 20 = 0), {g.DENSE} SELECT qid, doc_idx, sim, rank::INTEGER AS rank FROM dense")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 20 asks; all are searched."""
    queries = data.vectors(spark, sf_dir, "qid").where("qid % 20 = 0")
    return search.dense_ranks(data.vectors(spark, sf_dir, "doc_idx"), queries)


@query(f"WITH {g.SCALE}, {g.LEXICAL}, {BENCHMARK_Q}, {g.EXPANSION} SELECT term, nbr AS neighbour, score, rnk::INTEGER AS rnk FROM exps")
def cooccur_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, idx = _scale(spark, sf_dir)
    terms = search.query_tokens(queries).select(F.explode("tokens").alias("term"))
    return idx.near(terms)


@query(f"WITH {g.SCALE}, {g.LEXICAL}, {BENCHMARK_Q}, {g.EXPANSION} SELECT qid, len(w)::BIGINT AS n_tokens, {g.join('w', ' ')} AS tokens FROM wide")
def synonym_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, idx = _scale(spark, sf_dir)
    wide = search.expand_tokens(search.query_tokens(queries), idx)
    return wide.select("qid", F.size("tokens").cast("long").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query(f"WITH {g.SCALE}, {g.LEXICAL}, {BENCHMARK_Q}, {PLAIN_TOKENS}, qe AS (SELECT qid, unnest(w) AS term FROM qt), {g.COVERAGE} SELECT qid, round(coverage, 6) AS coverage, w_sem::DOUBLE AS w_sem, w_lex::DOUBLE AS w_lex FROM cov")
def coverage_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, idx = _scale(spark, sf_dir)
    return search.coverage(search.query_tokens(queries), idx.vocab).withColumn("coverage", F.round("coverage", 6))


@query(f"WITH {g.SCALE}, {g.LEXICAL}, {g.SIGNALS} SELECT term, category, round(share, 6) AS share FROM sig")
def category_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scale(spark, sf_dir)[1].signals.withColumn("share", F.round("share", 6))


SCALE_QV = "qv AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id IN (SELECT qid FROM q))"


def _scale_vectors(spark: SparkSession, sf_dir: str, queries: DataFrame) -> DataFrame:
    return data.vectors(spark, sf_dir, "qid").join(queries.select("qid"), "qid", "left_semi")


@query(f"WITH {g.SCALE}, {g.LEXICAL}, {BENCHMARK_Q}, {PLAIN_TOKENS}, qe AS (SELECT qid, unnest(w) AS term FROM qt), {g.bm25('qt')}, {SCALE_QV}, {g.DENSE}, {g.COVERAGE}, {g.FUSION} SELECT qid, doc_idx, round(score, 6) AS score FROM fused")
def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, idx = _scale(spark, sf_dir)
    tokens = search.query_tokens(queries)
    lexical = search.lexical_ranks(queries, tokens, idx)
    dense = search.dense_ranks(idx.vectors, _scale_vectors(spark, sf_dir, queries))
    return search.fuse(dense, lexical, search.coverage(tokens, idx.vocab)).withColumn("score", F.round("score", 6))


HYBRID = f"{g.EXPANSION}, {g.bm25('wide')}, {g.DENSE}, {g.COVERAGE}, {g.FUSION}, {g.SIGNALS}, {g.BOOSTED}"


@query(f"WITH {g.SCALE}, {g.LEXICAL}, {BENCHMARK_Q}, {SCALE_QV}, {HYBRID} SELECT qid, doc_idx, rrf_score, rank::INTEGER AS rank FROM found")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, idx = _scale(spark, sf_dir)
    return search.hybrid(queries, _scale_vectors(spark, sf_dir, queries), idx)


DOMAIN_Q = f"{data.values('q0', 'qid, query', data.PUBLIC)}, q1 AS (SELECT qid, {g.normal_query('query')} AS n FROM q0), q AS (SELECT qid::BIGINT AS qid, {g.expanded('n')} AS query FROM q1)"
#: The stand-in for query vectors: the stored ones of the same numbers.
DOMAIN_QV = SCALE_QV


def domain_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scale_vectors(spark, sf_dir, data.public_queries(spark))


def domain_index(spark: SparkSession, sf_dir: str) -> index.Index:
    return _built(spark, "domain", sf_dir, data.domain_corpus)


@query(f"WITH {g.CORPUS} SELECT doc_idx, search_text FROM corpus")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.domain_corpus(spark, sf_dir).select("doc_idx", "search_text")


_PART = r"(?i)part\s*(\d+)"


@query(
    f"WITH {g.CORPUS}, {ID_ROWS}, b AS (SELECT v.i AS qid, c.doc_idx, 1.0 + 0.4 * len(list_intersect({g.numbers('v.raw')}, {g.numbers('c.search_text')})) AS base, "
    f"{g.part_of('v.raw', _PART)} AS qp, {g.part_of('c.search_text', _PART)} AS dp FROM v, corpus c) "
    "SELECT qid, doc_idx, round(base + CASE WHEN qp IS NULL OR dp IS NULL THEN 0 WHEN qp = dp THEN 0.3 ELSE -0.15 * base END, 6)::DOUBLE AS boost FROM b"
)
def exact_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boost alone: a few literal queries against all chunks."""
    facts = lambda x: (ids.is_numbers(F.col(x)), ids.part(F.col(x), ids.PART_OF_TEXT))
    mine, theirs = facts("query"), facts("search_text")
    asked = data.literal(spark, "qid, query", ID_TEXTS).select("qid", mine[0].alias("mine"), mine[1].alias("q"))
    chunks = data.domain_corpus(spark, sf_dir).select("doc_idx", theirs[0].alias("theirs"), theirs[1].alias("d"))
    boost = search.boost_of(*[F.col(c) for c in ("mine", "q", "theirs", "d")])
    return chunks.crossJoin(F.broadcast(asked)).select("qid", "doc_idx", F.round(boost, 6).alias("boost"))


@query(
    f"WITH {g.CORPUS}, {g.LEXICAL}, {DOMAIN_Q}, {PLAIN_TOKENS}, qe AS (SELECT qid, unnest(w) AS term FROM qt), {g.SIGNALS}, "
    f"det AS (SELECT qid, list_sort(list(DISTINCT category)) AS d FROM qe JOIN sig USING (term) GROUP BY qid), c AS (SELECT DISTINCT category FROM corpus) "
    f"SELECT q.qid, c.category, {g.join('det.d')} AS detected, (CASE WHEN det.d IS NULL THEN 1.0 WHEN len(list_filter(det.d, lambda z: contains(lower(c.category), z))) > 0 THEN 1.15 ELSE 0.92 END)::DOUBLE AS boost "
    f"FROM q CROSS JOIN c LEFT JOIN det ON det.qid = q.qid"
)
def category_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    idx = domain_index(spark, sf_dir)
    queries = data.public_queries(spark).select("qid", text.expand_query(F.col("query")).alias("query"))
    found = search.detected_categories(search.query_tokens(queries), idx.signals)
    categories = idx.corpus.select("category").distinct()  # few, by construction
    pairs = queries.select("qid").crossJoin(F.broadcast(categories)).join(found, "qid", "left")
    boost = search.category_boost(F.col("category"), F.col("detected"))
    return pairs.select("qid", "category", F.coalesce(F.array_join("detected", "|"), F.lit("")).alias("detected"), boost.alias("boost"))
