"""Ingest, enrichment, ranking, reports, evaluation, rationales, the client's computations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, text
from ..functions import lexicons as lex
from ..operators import client, enrich, evaluate, ingest, rank, rationale, reports, search
from ..sources.shared import stored
from . import data
from . import sqlgen as g
from .registry import query
from .search_queries import ASKED, BENCHMARK_Q, DOMAIN_Q, DOMAIN_QV, HYBRID, PLAIN_TOKENS, asked, domain_index, domain_vectors, scale_index

joined = lambda c: F.coalesce(F.array_join(c, "|"), F.lit(""))

# ---- ingest and enrichment ---------------------------------------------------------------------

#: Raw lines: page 1 begins before any id, has ids in several forms, a cross reference, a short standard.
LINES = [
    ("a", 1, 0, "Foreword of the collection"), ("a", 1, 1, "  IS 269 : 1989 - Ordinary Portland Cement  "), ("a", 1, 2, ""), ("a", 1, 3, "1. Scope: covers cement."),
    ("a", 1, 4, "see also IS 4031 for tests of fineness"), ("a", 1, 5, "and soundness"), ("a", 2, 0, "IS 383"), ("a", 2, 1, "   "),
    ("a", 2, 2, "IS 2185 (Part 2): 1983 Hollow blocks"), ("a", 2, 3, "dimensions of lightweight blocks"), ("b", 1, 0, "nothing here"), ("b", 1, 1, "is 455-1989: slag cement"),
    ("b", 1, 2, "composition and manufacture"),
]
#: And the lines of documents, of which some get an identifier in front.
DOCUMENT_LINES = (
    "SELECT 'd' || CAST(doc_id AS STRING) AS src_id, CAST(floor(k / 4) AS INT) AS page_no, CAST(k AS INT) AS line_no, CASE WHEN (doc_id + k) % 5 = 1 THEN 'IS ' || CAST(100 + (doc_id + k) % 900 AS STRING) "
    "|| CASE WHEN (doc_id + k) % 2 = 0 THEN ' (Part 2): 1983 - ' ELSE ' ' END || line WHEN (doc_id + k) % 11 = 3 THEN ' is  ' || CAST(doc_id % 1000 AS STRING) || '-1975 : ' || line ELSE line END AS raw FROM pieces"
)
LINE_ID = r"(?i)(IS\s+\d{1,5}(?:\s*\(Part\s+\d+\))?(?:\s*\(Sec\s+\d+\))?\s*[:\-]?\s*\d{4}|IS\s+\d{1,5})"
SEGMENTS = f"""
{data.values('l1', 'src_id, page_no, line_no, raw', LINES)},
pieces AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS k FROM documents),
l0 AS (SELECT * FROM l1 UNION ALL {DOCUMENT_LINES}),
l AS (SELECT src_id, page_no, line_no, {g.strip('raw')} AS line FROM l0 WHERE {g.strip('raw')} <> ''),
s AS (SELECT *, sum(CASE WHEN regexp_matches(line, {data.quoted(LINE_ID)}) THEN 1 ELSE 0 END) OVER (PARTITION BY src_id ORDER BY page_no, line_no) AS seg FROM l),
m AS (SELECT src_id, seg, string_agg(line, ' ' ORDER BY page_no, line_no) AS text, arg_min(line, page_no * 1000 + line_no) AS first FROM s WHERE seg > 0 GROUP BY ALL),
i AS (SELECT *, {g.strip(f"regexp_replace({g.strip(f'regexp_extract(first, {data.quoted(LINE_ID)}, 1)')}, '[:\\-]+$', '')")} AS id FROM m)
SELECT src_id, seg::BIGINT AS seg, id, trim(replace(first, id, ''), ': -') AS title, text FROM i WHERE length({g.strip('text')}) > 20
"""


@query("WITH " + SEGMENTS)
def segment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = data.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    rows = data.literal(spark, "src_id, page_no, line_no, raw", LINES).unionByName(spark.sql(DOCUMENT_LINES.replace("FROM pieces", "FROM {pieces}"), pieces=pieces))
    lines = rows.select("src_id", "page_no", "line_no", text.strip(F.col("raw")).alias("line")).where("line <> ''")
    return ingest.segment(lines)


@query(f"WITH {g.CHUNKS} SELECT doc_idx, id, title, text, category, {g.join('keywords')} AS keywords, part_number, standard_year FROM chunks WHERE is_summary_chunk")
def anchor_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = data.domain_chunks(spark, sf_dir).where("is_summary_chunk")
    return c.select("doc_idx", "id", "title", "text", "category", joined("keywords").alias("keywords"), "part_number", "standard_year")


@query(f"WITH {g.CHUNKS} SELECT doc_idx, id, text, {g.join('keywords')} AS keywords, chunk_index::INTEGER AS chunk_index FROM chunks WHERE NOT is_summary_chunk")
def sliding_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = data.domain_chunks(spark, sf_dir).where("not is_summary_chunk")
    return c.select("doc_idx", "id", "text", joined("keywords").alias("keywords"), "chunk_index")


@query(
    "WITH d AS (SELECT doc_id, text, 2 + CASE WHEN length(text) > 600 THEN ceil((length(text) - 600) / 800.0) ELSE 0 END AS n FROM documents) "
    "SELECT doc_id, n::BIGINT AS n_chunks, CASE WHEN n > 2 THEN length(substr(text, 601 + (n - 3)::INTEGER * 800, 1200)) ELSE 0 END::BIGINT AS last_len FROM d"
)
def document_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows over real texts: how many chunks a document makes, and the length of its last window."""
    docs = data.table(spark, sf_dir, "documents")
    c = ingest.chunks(docs.select(F.col("doc_id").alias("std_seq"), F.col("doc_id").cast("string").alias("id"), F.lit("").alias("title"), "text"))
    head = F.length("id") + 2  # id, empty title and their spaces come before a window's text
    last = F.max(F.when(F.col("chunk_index") > 0, F.struct("chunk_index", (F.length("text") - head).cast("long").alias("n"))))
    return c.groupBy(F.col("id").cast("long").alias("doc_id")).agg(F.count("*").alias("n_chunks"), F.coalesce(last["n"], F.lit(0)).alias("last_len"))


LOW = f"{g.RAW}, low AS (SELECT *, lower(text) AS l FROM raw)"


@query(f"WITH {LOW} SELECT std_seq, {g.category('l')} AS category FROM low")
def detect_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.standards(spark, sf_dir).select("std_seq", ingest.category_of(F.col("text")).alias("category"))


@query(f"WITH {LOW}, c AS (SELECT *, {g.category('l')} AS category FROM low), kw AS (SELECT std_seq, {g.keywords('l', 'category')} AS w FROM c) SELECT std_seq, {g.join(g.once('w'))} AS keywords FROM kw")
def extract_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.col("text")
    return data.standards(spark, sf_dir).select("std_seq", joined(ingest.keywords_of(body, ingest.category_of(body))).alias("keywords"))


@query(f"WITH {LOW} SELECT std_seq, {', '.join(f'{g.join(g.props(k))} AS {k}' for k in g.KINDS)} FROM low")
def tech_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = data.standards(spark, sf_dir).select("std_seq", enrich.technical_properties(F.col("text")).alias("p"))
    return p.select("std_seq", *[joined(f"p.{k}").alias(k) for k in g.KINDS])


@query(f"WITH {LOW} SELECT std_seq, {g.join(g.domains('l'))} AS domains FROM low")
def app_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.standards(spark, sf_dir).select("std_seq", joined(enrich.application_domains(F.col("text"))).alias("domains"))


@query(f"WITH {LOW} SELECT std_seq, {g.join('(' + g.has(lex.COMPOSITION_TERMS, 'l') + ')[1:12]')} AS composition FROM low")
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.standards(spark, sf_dir).select("std_seq", joined(enrich.composition_terms(F.col("text"))).alias("composition"))


@query(
    f"WITH {LOW} SELECT std_seq, list_contains({g.lst(lex.TEST_METHOD_STANDARDS)}, regexp_extract(id, '(?i)IS\\s*(\\d+)', 1)) OR "
    f"{g.n_has(lex.TEST_METHOD_INDICATORS, 'l')} >= 2 AS is_test_method FROM low"
)
def test_method_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return data.standards(spark, sf_dir).select("std_seq", enrich.is_test_method(F.col("text"), F.col("id")).alias("is_test_method"))


@query(
    f"WITH {g.ENRICHED} SELECT doc_idx, {g.join('related_standards')} AS related, {g.join('application_domains')} AS domains, {g.join('composition_terms')} AS composition, "
    f"{g.join(g.PROPS10)} AS properties, is_test_method, superseded_by FROM enriched"
)
def enriched_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = data.domain_enriched(spark, sf_dir)
    some = F.array().cast("array<string>")
    props = F.slice(F.flatten(F.array(*[F.coalesce(F.slice(F.col(f"technical_properties.{k}"), 1, 3), some) for k in g.KINDS])), 1, 10)
    return e.select(
        "doc_idx", joined("related_standards").alias("related"), joined("application_domains").alias("domains"), joined("composition_terms").alias("composition"),
        joined(props).alias("properties"), "is_test_method", "superseded_by",
    )


#: Damaged chunks beside the derived ones: every fifth loses something.
DAMAGED = (
    "SELECT doc_idx, CASE WHEN doc_idx % 5 = 1 THEN '' ELSE id END AS id, CASE WHEN doc_idx % 5 = 2 THEN 'short' ELSE text END AS text, "
    "CASE WHEN doc_idx % 5 = 3 THEN NULL ELSE category END AS category, keywords FROM chunks"
)


@query(
    f"WITH {g.CHUNKS}, d AS ({DAMAGED}) SELECT doc_idx, concat_ws(', ', CASE WHEN coalesce(id, '') = '' THEN 'Missing ID' END, "
    f"CASE WHEN length({g.strip('text')}) < 20 THEN 'Text too short or missing' END, CASE WHEN coalesce(category, '') = '' THEN 'Missing category' END, "
    "CASE WHEN coalesce(len(keywords), 0) = 0 THEN 'No keywords extracted' END, "
    "CASE WHEN length(text) - length(replace(text, '*', '')) > 50 OR length(text) - length(replace(text, '†', '')) > 20 THEN 'Possible text corruption (excessive symbols)' END) AS issues FROM d"
)
def chunk_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = spark.sql(DAMAGED.replace("FROM chunks", "FROM {chunks}"), chunks=data.domain_chunks(spark, sf_dir))
    return enrich.quality_issues(damaged).select("doc_idx", F.array_join("issues", ", ").alias("issues"))


# ---- ranking -----------------------------------------------------------------------------------

#: Ranked lists over the domain corpus: every twelve chunks, in order of doc_idx, are a query's list.
LISTS = (
    "SELECT CAST(floor(doc_idx / 12) AS BIGINT) AS qid, doc_idx % 12 + 1 AS rank, doc_idx, id, title, text, category, keywords, related_standards, standard_year, "
    "CASE WHEN doc_idx % 3 = 0 THEN 1.5 ELSE 1.0 END AS importance_weight, 'IS 383 part ' || CAST(CAST(floor(doc_idx / 12) AS BIGINT) % 4 AS STRING) AS query FROM enriched"
)
RANKED = f"{g.ENRICHED}, lists AS ({LISTS})"


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.sql(LISTS.replace("FROM enriched", "FROM {enriched}"), enriched=data.domain_enriched(spark, sf_dir))
    return rows.withColumn("importance_weight", F.col("importance_weight").cast("double"))


_LOOSE_PART = r"(?i)part[\s\-]*(\d+)"
RULE = (
    f"round((importance_weight * CASE WHEN len(list_intersect({g.numbers('query', g.LOOSE_RE)}, {g.numbers('id', g.LOOSE_RE)})) > 0 THEN 1.3 ELSE 1.0 END * "
    f"CASE WHEN {g.part_of('query', _LOOSE_PART)} IS NULL OR {g.part_of('id', _LOOSE_PART)} IS NULL THEN 1.0 WHEN {g.part_of('query', _LOOSE_PART)} = {g.part_of('id', _LOOSE_PART)} THEN 1.2 ELSE 0.8 END)::DOUBLE, 9)"
)
RULED = f"{RANKED}, sc0 AS (SELECT *, {RULE} AS score FROM lists), sc AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS rank FROM sc0)"


@query(f"WITH {RULED} SELECT qid, doc_idx, score, rank::INTEGER AS rank FROM sc")
def rule_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.rerank(ranked(spark, sf_dir)).select("qid", "doc_idx", "score", "rank")


_NAMED = "concat_ws(' ', id, title)"
PAIR = (
    "substr(trim(concat_ws(' ', nullif(trim(id), ''), nullif(trim(title), ''), nullif(trim(category), ''), "
    f"nullif({g.join('keywords[1:5]', ' ')}, ''), nullif({g.join('related_standards[1:3]', ' ')}, ''), nullif(substr(trim(text), 1, 120), ''))), 1, 250)"
)
OVERLAP = f"len(list_distinct(list_filter({g.tokens('query')}, lambda z: list_contains({g.tokens('pair')}, z))))::DOUBLE / 10"
BOOST = (
    f"importance_weight * CASE WHEN len(list_intersect({g.numbers('query')}, {g.numbers(_NAMED)})) > 0 THEN 1.2 ELSE 1.0 END * "
    f"CASE WHEN {g.part_of('query', _LOOSE_PART)} IS NULL OR {g.part_of(_NAMED, _LOOSE_PART)} IS NULL THEN 1.0 WHEN {g.part_of('query', _LOOSE_PART)} = {g.part_of(_NAMED, _LOOSE_PART)} THEN 1.1 ELSE 0.95 END"
)


def modelled(source: str) -> str:
    """md(..., score, rank) from ranked rows in `source`: the stand-in model on the first eight, boosted."""
    return (
        f"pr AS (SELECT *, {PAIR} AS pair FROM {source} WHERE rank <= 8), md0 AS (SELECT *, round(({OVERLAP} * {BOOST})::DOUBLE, 9) AS score FROM pr), "
        f"md AS (SELECT * EXCLUDE (rank), row_number() OVER (PARTITION BY qid ORDER BY score DESC, rank) AS rank FROM md0)"
    )


@query(f"WITH {RANKED}, {modelled('lists')} SELECT qid, doc_idx, pair, score, rank::INTEGER AS rank FROM md")
def metadata_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = rank.rerank(ranked(spark, sf_dir), rank.overlap_model)
    return found.select("qid", "doc_idx", rank.pair_text().alias("pair"), "score", "rank")


#: Scored lists: a gap, none, three rows, tops of zero and below, a late gap, one row.
SCORED = [
    (q, i + 1, float(s))
    for q, row in enumerate(
        [[10, 9, 8, 7.9, 5, 1], [10, 9.5, 9, 8.5, 8, 7.5, 7, 6.5, 6, 5.5], [3, 1, 0.5], [-1, -2, -3, -4], [0, 0, 0, -5, -6], [10, 5, 1, 0.9, 0.8, 0.7, 0.6, 0.5, 0.1], [1], [5, 1, 1, 1, 1, 1, 1, 0.2, 0]]
    )
    for i, s in enumerate(row)
]
TRUNCATE = """
g0 AS (SELECT *, count(*) OVER (PARTITION BY qid) AS n, first_value(score) OVER (PARTITION BY qid ORDER BY rank) AS top, abs(lag(score) OVER (PARTITION BY qid ORDER BY rank) - score) AS gap FROM {source}),
g1 AS (SELECT *, min(CASE WHEN rank BETWEEN 4 AND 8 AND gap > 0.15 * abs(top) THEN rank END) OVER (PARTITION BY qid) AS cut FROM g0),
kept AS (SELECT * EXCLUDE (n, top, gap, cut) FROM g1 WHERE CASE WHEN n <= 3 THEN true WHEN top <= 0 THEN rank <= 3 ELSE rank < coalesce(cut, 9) END)
"""


@query(
    f"WITH {RANKED}, {modelled('lists')}, {data.values('v', 'qid, rank, score', SCORED)}, s AS (SELECT qid::BIGINT AS qid, rank::BIGINT AS rank, score::DOUBLE AS score FROM v "
    f"UNION ALL SELECT qid + 1000, rank, score FROM md), {TRUNCATE.format(source='s')} SELECT qid, rank, score FROM kept"
)
def gap_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Literal lists, and the reranked ones of the domain corpus."""
    rows = data.literal(spark, "qid, rank, score", SCORED).select(F.col("qid").cast("long").alias("qid"), F.col("rank").cast("long").alias("rank"), F.col("score").cast("double").alias("score"))
    found = rank.rerank(ranked(spark, sf_dir), rank.overlap_model).select((F.col("qid") + 1000).alias("qid"), F.col("rank").cast("long").alias("rank"), "score")
    return rank.truncate(rows.unionByName(found))


DEDUP = f"""
n0 AS (SELECT *, {g.formatted('id')} AS std_id FROM @source),
n1 AS (SELECT *, {g.base_key('std_id')} AS k, {g.year_end('std_id')} AS y FROM n0 WHERE {g.valid('std_id')}),
n2 AS (SELECT *, row_number() OVER (PARTITION BY qid, k ORDER BY CASE WHEN y = standard_year THEN 0 ELSE 1 END, CASE WHEN y = standard_year THEN 0 ELSE -y END, rank) > 1 AS loser FROM n1),
n3 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, std_id ORDER BY loser, rank) AS o FROM n2) WHERE o = 1),
emitted AS (SELECT * FROM (SELECT qid, std_id, doc_idx, row_number() OVER (PARTITION BY qid ORDER BY loser, rank) AS pos FROM n3) WHERE pos <= 5)
"""


@query(f"WITH {RULED}, {DEDUP.replace('@source', 'sc')} SELECT qid, std_id, doc_idx, pos::INTEGER AS pos FROM emitted")
def version_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.version_dedup(rank.rerank(ranked(spark, sf_dir)))


PAD = f"""
short AS (SELECT qid, max(pos) AS n FROM emitted GROUP BY qid),
p0 AS (
  SELECT c.qid, {g.formatted('c.id')} AS std_id, c.doc_idx, c.rank, coalesce(s.n, 0) AS n FROM @candidates c JOIN @top t ON t.qid = c.qid LEFT JOIN short s ON s.qid = c.qid
  WHERE c.rrf_score >= 0.5 * abs(t.top)),
p1 AS (SELECT * FROM p0 WHERE coalesce(std_id, '') <> '' AND (qid, std_id) NOT IN (SELECT (qid, std_id) FROM emitted)),
p2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid, std_id ORDER BY rank) AS o FROM p1) WHERE o = 1),
p3 AS (SELECT qid, std_id, doc_idx, n + row_number() OVER (PARTITION BY qid ORDER BY rank) AS pos FROM p2),
padded AS (SELECT * FROM emitted UNION ALL SELECT * FROM p3 WHERE pos <= 5)
"""


@query(
    f"WITH {RANKED}, sc AS (SELECT * FROM lists WHERE rank <= 2), {DEDUP.replace('@source', 'sc')}, cand AS (SELECT qid, rank, doc_idx, id, 1.0 / rank AS rrf_score FROM lists), "
    f"tops AS (SELECT DISTINCT qid, 0.2 AS top FROM lists), {PAD.replace('@candidates', 'cand').replace('@top', 'tops')} SELECT qid, std_id, doc_idx, pos::INTEGER AS pos FROM padded"
)
def pad_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ranked(spark, sf_dir)
    candidates = rows.withColumn("rrf_score", F.lit(1.0) / F.col("rank"))
    top = rows.select("qid").distinct().withColumn("top", F.lit(0.2))
    return rank.pad(rank.version_dedup(rows.where("rank <= 2")), candidates, top)


RECOMMEND = (
    f"WITH {g.CORPUS}, {g.LEXICAL}, {DOMAIN_Q}, {DOMAIN_QV}, {HYBRID}, "
    "cand AS (SELECT f.qid, f.doc_idx, f.rank, f.rrf_score, c.* EXCLUDE (doc_idx), 1.0 AS importance_weight, q0.query FROM found f JOIN corpus c USING (doc_idx) JOIN q0 ON q0.qid = f.qid), "
    f"{modelled('cand')}, {TRUNCATE.format(source='md')}, tops AS (SELECT qid, score AS top FROM kept WHERE rank = 1), {DEDUP.replace('@source', 'kept')}, {PAD.replace('@candidates', 'cand').replace('@top', 'tops')} "
    "SELECT q.qid, coalesce((SELECT string_agg(std_id, '; ' ORDER BY pos) FROM padded p WHERE p.qid = q.qid), '') AS retrieved_standards FROM q"
)


@query(RECOMMEND)
def recommend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole pipeline over the domain corpus for the public queries, with the stand-in model."""
    found = rank.recommend(data.public_queries(spark), domain_vectors(spark, sf_dir), domain_index(spark, sf_dir))
    return found.select("qid", F.array_join("retrieved_standards", "; ").alias("retrieved_standards"))


# ---- reports -----------------------------------------------------------------------------------


@query(f"WITH {g.CHUNKS} SELECT coalesce(category, 'unknown') AS category, count(*)::BIGINT AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM chunks GROUP BY 1")
def category_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.category_histogram(data.domain_chunks(spark, sf_dir)).withColumn("pct", F.round(F.col("pct").cast("double"), 6))


@query(f"WITH {g.CHUNKS} SELECT part_number, count(*)::BIGINT AS n FROM chunks WHERE part_number IS NOT NULL GROUP BY 1")
def part_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.part_histogram(data.domain_chunks(spark, sf_dir))


@query(f"WITH {g.ENRICHED} SELECT domain, count(*)::BIGINT AS n FROM (SELECT unnest(application_domains) AS domain FROM enriched) GROUP BY 1 ORDER BY n DESC, domain LIMIT 10")
def domain_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.domain_histogram(data.domain_enriched(spark, sf_dir))


@query(
    f"WITH {g.ENRICHED} SELECT count(*)::BIGINT AS n_chunks, (count(*) FILTER (WHERE is_summary_chunk))::BIGINT AS n_anchor, (count(*) FILTER (WHERE NOT is_summary_chunk))::BIGINT AS n_content, "
    "count(part_number)::BIGINT AS n_multi_part, (count(*) FILTER (WHERE is_test_method))::BIGINT AS n_test_method, (count(*) FILTER (WHERE len(related_standards) > 0))::BIGINT AS n_with_refs FROM enriched"
)
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.chunk_counts(data.domain_enriched(spark, sf_dir))


@query(f"WITH {g.CHUNKS} SELECT doc_idx, id, category, {g.join('keywords[1:5]', ', ')} AS keywords, substr(text, 1, 150) AS text FROM chunks ORDER BY doc_idx LIMIT 3")
def chunk_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.sample(data.domain_chunks(spark, sf_dir))


_SHOWN = "list_filter([" + ", ".join(f"CASE WHEN len(p_{k}) > 0 THEN '{k}: ' || array_to_string(p_{k}[1:3], ', ') END" for k in g.KINDS) + "], lambda z: z IS NOT NULL)"


@query(
    f"WITH {g.ENRICHED} SELECT doc_idx, id, substr(title, 1, 60) AS title, category, part_number, standard_year, is_summary_chunk, is_test_method, {g.join('keywords[1:8]', ', ')} AS keywords, "
    f"{g.join('application_domains[1:3]', ', ')} AS application_domains, {g.join('composition_terms[1:6]', ', ')} AS composition_terms, {g.join('related_standards[1:5]', ', ')} AS related_standards, "
    f"{g.join('(' + _SHOWN + ')[1:2]', '; ')} AS properties, substr(text, 1, 150) AS text FROM enriched ORDER BY doc_idx LIMIT 3"
)
def enriched_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = data.domain_chunks(spark, sf_dir).orderBy("doc_idx").limit(3)  # what else they are is asked of these alone
    return reports.enriched_sample(enrich.enrich(first))


@query(
    f"WITH {g.CHUNKS} SELECT doc_idx, coalesce(id, 'unknown') AS id, concat_ws(', ', CASE WHEN length(text) < 20 THEN 'Text too short or missing' END, CASE WHEN len(keywords) = 0 THEN 'No keywords extracted' END, "
    "CASE WHEN length(text) - length(replace(text, '*', '')) > 50 THEN 'Possible text corruption (excessive symbols)' END) AS issues FROM chunks "
    "WHERE length(text) < 20 OR len(keywords) = 0 OR length(text) - length(replace(text, '*', '')) > 50 ORDER BY doc_idx LIMIT 5"
)
def first_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.first_issues(enrich.quality_issues(data.domain_chunks(spark, sf_dir)))


@query(
    f"WITH {RULED}, {DEDUP.replace('@source', 'sc')}, "
    "v AS (SELECT qid, k AS base_key, rank, std_id, count(*) OVER (PARTITION BY qid, k) AS n_versions, min(rank) OVER (PARTITION BY qid, k) AS f FROM n1), "
    "w AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY f) AS gr FROM v WHERE n_versions > 1) "
    "SELECT w.qid, base_key, rank::BIGINT AS rank, w.std_id, n_versions::BIGINT AS n_versions, e.std_id IS NOT NULL AS selected FROM w LEFT JOIN emitted e ON e.qid = w.qid AND e.std_id = w.std_id WHERE gr <= 5"
)
def dup_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rank.rerank(ranked(spark, sf_dir))
    return reports.duplicate_versions(rows, rank.version_dedup(rows))


@query(
    f"WITH {RULED}, {DEDUP.replace('@source', 'sc')} SELECT a.qid, a.n AS n_in, coalesce(b.n, 0) AS n_out, a.n - coalesce(b.n, 0) AS n_merged FROM "
    "(SELECT qid, count(*)::BIGINT AS n FROM sc GROUP BY qid) a LEFT JOIN (SELECT qid, count(*)::BIGINT AS n FROM emitted GROUP BY qid) b ON a.qid = b.qid"
)
def dedup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rank.rerank(ranked(spark, sf_dir))
    return reports.dedup_counts(rows, rank.version_dedup(rows))


# ---- evaluation --------------------------------------------------------------------------------

RUN = f"{data.values('r0', data.RUN_COLUMNS, data.RUN)}, r AS (SELECT id, query, string_split(expected, '; ') AS e, string_split(retrieved, '; ') AS g, latency::DOUBLE AS s FROM r0)"
_PLAIN = "list_transform({}, lambda z: lower(replace(z, ' ', '')))"
#: The published run, and lexical search of the benchmark: relevant is a document that holds the item's text.
RESULTS = (
    f"{RUN}, {g.SCALE}, {g.LEXICAL}, {BENCHMARK_Q}, {PLAIN_TOKENS}, {g.bm25('qt')}, "
    "jd AS (SELECT lex.qid, rank, doc_idx::VARCHAR AS d, contains(coalesce(documents.text, ''), q.query) AS relevant FROM lex JOIN q ON q.qid = lex.qid JOIN documents ON doc_id = doc_idx), "
    "results AS (SELECT id, query, e, g, s FROM r UNION ALL SELECT qid::VARCHAR, NULL, coalesce(list(d ORDER BY rank) FILTER (relevant), []), list(d ORDER BY rank), NULL::DOUBLE FROM jd GROUP BY qid)"
)
HITS = (
    f"{RESULTS}, h AS (SELECT id, coalesce(s, 0) AS s, len(list_intersect(({_PLAIN.format('g')})[1:3], {_PLAIN.format('e')})) > 0 AS hit, "
    f"list_position(list_transform(({_PLAIN.format('g')})[1:5], lambda z: list_contains({_PLAIN.format('e')}, z)), true) AS first FROM results)"
)


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, idx = data.scale_queries(spark, sf_dir), scale_index(spark, sf_dir)
    found = search.lexical_ranks(queries, search.query_tokens(queries), idx).select("qid", "rank", "doc_idx")
    # read twice; and a table of known size, so that the texts that it picks stay where they are
    found = stored(found, "found")
    docs = data.table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = evaluate.judged(found, docs, queries.withColumnRenamed("query", "sought"))
    return data.run_results(spark).unionByName(evaluate.as_results(judged))


@query(f"WITH {HITS} SELECT id, hit AS hit_at_3 FROM h")
def hit_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.hits(_results(spark, sf_dir)).select("id", "hit_at_3")


@query(f"WITH {HITS} SELECT id, round(CASE WHEN first > 0 THEN 1.0 / first ELSE 0 END, 6)::DOUBLE AS rr_at_5 FROM h")
def mrr_at_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.hits(_results(spark, sf_dir)).select("id", F.round("rr_at_5", 6).alias("rr_at_5"))


@query(
    f"WITH {HITS} SELECT count(*)::BIGINT AS n_queries, round(avg(hit::INTEGER) * 100, 6) AS hit_rate_3, round(avg(CASE WHEN first > 0 THEN 1.0 / first ELSE 0 END), 6)::DOUBLE AS mrr_5, round(avg(s), 6) AS avg_latency FROM h"
)
def eval_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.summary(_results(spark, sf_dir))
    return s.select("n_queries", *[F.round(c, 6).alias(c) for c in ("hit_rate_3", "mrr_5", "avg_latency")])


def _latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latencies to measure: events' values as seconds."""
    return data.table(spark, sf_dir, "events").select(F.abs("value").alias("latency_seconds"))


@query(
    "WITH v AS (SELECT coalesce(abs(value), 0.0) AS x FROM events), o AS (SELECT x, row_number() OVER (ORDER BY x) AS k, count(*) OVER () AS n FROM v) "
    "SELECT max(n)::BIGINT AS n, round(min(x), 6) AS min_s, round(max(x), 6) AS max_s, round(avg(x), 6) AS mean_s, round(max(CASE WHEN k = floor(n * 0.5) + 1 THEN x END), 6) AS median_s, "
    "round(max(CASE WHEN k = floor(n * 0.95) + 1 THEN x END), 6) AS p95_s, round(sum(x), 2) AS total_s FROM o"
)
def latency_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = evaluate.latency_statistics(_latencies(spark, sf_dir))
    return s.select("n", *[F.round(c, 6).alias(c) for c in ("min_s", "max_s", "mean_s", "median_s", "p95_s")], F.round("total_s", 2).alias("total_s"))


@query(f"WITH {RESULTS} SELECT len(g)::INTEGER AS n_standards, count(*)::BIGINT AS n_queries, round(count(*) * 100.0 / sum(count(*)) OVER (), 6)::DOUBLE AS pct FROM results GROUP BY len(g)")
def size_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.size_histogram(_results(spark, sf_dir)).withColumn("pct", F.round(F.col("pct").cast("double"), 6))


#: Results with faults: a repeated id, a blank standard, missing fields.
FAULTY = [("a", "q", "IS 1: 2000", "IS 1: 2000; ", 0.12345), ("a", "q", "IS 1: 2000", "IS 2: 2000", 0.2), (None, "q", "x", "IS 3: 2001;IS 4", 0.3), ("b", None, None, None, None), ("c", "q", "e", "IS 9", 1.0)]
#: And faults put into what heads the domain corpus' lists: the same columns, from ranked rows.
FAULTS = (
    "SELECT CASE WHEN qid % 7 = 3 THEN NULL ELSE 'p' || CAST(CAST(floor(qid / 3) AS BIGINT) AS STRING) END AS id, CASE WHEN qid % 5 = 2 THEN NULL ELSE query END AS query, CASE WHEN qid % 11 = 4 THEN NULL ELSE id END AS e, "
    "CASE WHEN qid % 6 = 1 THEN NULL WHEN qid % 6 = 2 THEN id || ';' WHEN qid % 6 = 3 THEN ' ;' || id || ';  ;x' ELSE id || ';' || title END AS g, "
    "CASE WHEN qid % 4 = 1 THEN NULL ELSE CAST(qid * 0.1234567 AS DOUBLE) END AS s FROM lists WHERE rank = 1"
)
FAULTY_SQL = f"{RANKED}, {data.values('f0', 'id, query, e, g, s', FAULTY)}, f AS (SELECT id, query, e, g, s::DOUBLE AS s FROM f0 UNION ALL {FAULTS}), r AS (SELECT id, query, e, string_split(g, ';') AS g, s FROM f)"


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = data.literal(spark, "id, query, e, g, s", FAULTY).withColumn("s", F.col("s").cast("double"))
    rows = rows.unionByName(spark.sql(FAULTS.replace("FROM lists", "FROM {lists}"), lists=ranked(spark, sf_dir)))
    return rows.select("id", "query", F.split("e", ";").alias("expected_standards"), F.split("g", ";").alias("retrieved_standards"), F.col("s").alias("latency_seconds"))


@query(
    f"WITH {FAULTY_SQL} SELECT id, 'Missing ''id'' field' AS issue FROM r WHERE id IS NULL UNION ALL SELECT id, 'Missing ''query'' field' FROM r WHERE query IS NULL UNION ALL "
    "SELECT id, 'Missing ''expected_standards'' field' FROM r WHERE e IS NULL UNION ALL SELECT id, 'Missing ''retrieved_standards'' field' FROM r WHERE g IS NULL UNION ALL "
    "SELECT id, 'Missing ''latency_seconds'' field' FROM r WHERE s IS NULL UNION ALL "
    "SELECT id, 'Invalid standard at position ' || j FROM (SELECT id, unnest(g) AS x, unnest(range(0, len(g))) AS j FROM r) WHERE trim(x) = '' UNION ALL "
    "SELECT id, 'Duplicate query ID' FROM (SELECT id, row_number() OVER (PARTITION BY id) AS k FROM r WHERE id IS NOT NULL) WHERE k > 1"
)
def validate_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.validation_issues(_faulty(spark, sf_dir))


@query(
    f"WITH {FAULTY_SQL} SELECT coalesce(id, 'unknown') AS id, coalesce(query, '') AS query, {g.join('list_filter(g, lambda z: trim(z) <> chr(0) AND length(trim(z)) > 0)')} AS retrieved, round_even(s, 4) AS latency_seconds FROM r"
)
def clean_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.clean_results(_faulty(spark, sf_dir)).select("id", "query", joined("retrieved_standards").alias("retrieved"), "latency_seconds")


@query(f"WITH {RULED}, f AS (SELECT qid, list(id ORDER BY rank) AS i FROM sc GROUP BY qid) SELECT qid, len(list_filter(i, lambda z: NOT {g.valid('z')})) = 0 AS all_valid, {g.join(f'list_filter(i, lambda z: NOT {g.valid("z")})')} AS invalid FROM f")
def format_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rank.rerank(ranked(spark, sf_dir)).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("r"))
    listed = rows.select("qid", F.transform("r", lambda s: s["id"]).alias("std_ids"))
    return evaluate.format_report(listed).withColumn("invalid", joined("invalid"))


@query(
    "WITH rel AS (SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)) SELECT b.item_id, count(rel.doc_id)::BIGINT AS n_relevant, min(rel.doc_id) AS first_doc "
    "FROM benchmark b LEFT JOIN rel USING (item_id) GROUP BY b.item_id"
)
def benchmark_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item's whole text: relevance for evaluation."""
    items = data.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("sought"))
    counts = evaluate.relevant(data.table(spark, sf_dir, "documents"), items).groupBy("sought").agg(F.count("doc_id").alias("n_relevant"), F.min("doc_id").alias("first_doc"))
    found = items.join(counts, "sought", "left")
    return found.select("item_id", F.coalesce("n_relevant", F.lit(0)).cast("long").alias("n_relevant"), "first_doc")


# ---- rationales --------------------------------------------------------------------------------

def _signals(low: str) -> str:
    sums = {c: " + ".join(f"CASE WHEN contains({low}, {data.quoted(p)}) THEN {w} ELSE 0 END" for p, w in s) for c, s in lex.CATEGORY_SIGNALS.items()}
    best = f"greatest({', '.join(f'({s})' for s in sums.values())})"
    return f"CASE WHEN {best} < 2 THEN NULL " + " ".join(f"WHEN ({s}) = {best} THEN {data.quoted(c)}" for c, s in sums.items()) + " END"


@query(f"WITH {ASKED}, n AS (SELECT qid, {g.normal_query('query')} AS n FROM q) SELECT qid, {_signals('n')} AS category FROM n")
def signal_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asked(spark, sf_dir)
    return rows.select("qid", text.query_category(F.col("query")).alias("category"))


_HINTS = g.phrases({p: ";".join(i) for p, i in lex.DOMAIN_HINTS.items()}, "n")


@query(f"WITH {ASKED}, n AS (SELECT qid, {g.normal_query('query')} AS n FROM q), h AS (SELECT qid, flatten(list_transform({_HINTS}, lambda z: string_split(z, ';'))) AS h FROM n) SELECT qid, {g.join(g.once('h'))} AS hints, '' AS hints_off FROM h")
def domain_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = asked(spark, sf_dir)
    q = F.col("query")
    return rows.select("qid", joined(text.domain_hints(q, True)).alias("hints"), joined(text.domain_hints(q)).alias("hints_off"))


_SCOPE = r"(?is)(?:1\.\s*)?Scope\s*[—\-:]+\s*(.+?)(?:\.|2\.\s|Note\s)"
_TERMS = f"(list_filter({g.once(g.words('lower(query)'))}, lambda z: length(z) > 3 AND NOT list_contains({g.lst(lex.RATIONALE_STOPWORDS)}, z) AND contains(lower(text), z)))[1:5]"


@query(
    f"WITH {data.values('q', 'qid, query', data.PUBLIC)}, {RANKED}, p AS (SELECT l.qid, l.rank, l.id, l.title, l.text, q.query FROM lists l JOIN q ON q.qid = l.qid % 10), "
    f"s AS (SELECT *, substr({g.sub(f'trim(regexp_extract(text, {data.quoted(_SCOPE)}, 1))', r'\s+', ' ')}, 1, 200) AS scope, {_TERMS} AS m FROM p) "
    "SELECT qid, id, rank::BIGINT AS rank, CASE WHEN scope <> '' THEN id || ' covers ' || scope || '.' WHEN length(title) > 5 THEN id || ' pertains to ' || title || '.' ELSE id || ' is a relevant Indian Standard.' END "
    "|| ' Matches your query on: ' || CASE WHEN len(m) > 0 THEN array_to_string(m, ', ') ELSE 'related specifications' END || '.' AS rationale, round(greatest(0.95 - (rank - 1) * 0.1, 0.3), 3)::DOUBLE AS confidence FROM s"
)
def template_rationale(spark: SparkSession, sf_dir: str) -> DataFrame:
    canned = data.public_queries(spark).withColumnRenamed("qid", "q")
    rows = ranked(spark, sf_dir).drop("query")
    return rationale.rationales(rows.join(F.broadcast(canned), F.col("qid") % 10 == F.col("q")))


#: Replies of a model: fenced, bare, with an unknown and a missing standard, broken, an object, none.
REPLIES = [
    (1, '```json\n[{"standard": "IS 269: 1989", "reason": "Covers it."}]\n```'), (2, '[{"standard":"IS269:1989","reason":"a"},{"standard":"IS 999: 1999","reason":"no"},{"standard":"IS 455: 1989"}]'),
    (3, "I think IS 269 fits."), (4, '{"standard": "IS 269: 1989"}'), (5, None), (6, "[]"), (7, '```\n[{"standard":"IS 455: 1989","reason":"slag"}]\n``` thanks'), (8, "[broken"),
]
EXPECTED_REPLIES = [
    (1, "IS 269: 1989=Covers it.|IS 455: 1989=Relevant Indian Standard for your query."), (2, "IS269:1989=a|IS 455: 1989=Relevant to your query."),
    (3, "IS 269: 1989=I think IS 269 fits.|IS 455: 1989=See above explanation."), (4, "IS 269: 1989=This standard covers Ordinary cement.|IS 455: 1989=Related BIS standard."),
    (5, "IS 269: 1989=This standard covers Ordinary cement.|IS 455: 1989=Related BIS standard."), (6, "IS 269: 1989=Relevant Indian Standard for your query.|IS 455: 1989=Relevant Indian Standard for your query."),
    (7, "IS 455: 1989=slag|IS 269: 1989=Relevant Indian Standard for your query."), (8, "IS 269: 1989=[broken|IS 455: 1989=See above explanation."),
]


#: Replies about the domain corpus' lists: an array that names the first standard, a sentence, or none.
MADE_REPLIES = (
    "SELECT qid + 1000 AS qid, a, b, c, CASE qid % 3 WHEN 0 THEN '[{\"standard\": \"' || a || '\", \"reason\": \"About ' || c || '\"}]' WHEN 1 THEN 'I think that ' || a || ' fits.' END AS reply FROM pairs"
)


@query(
    f"WITH {data.values('v', 'qid, items', EXPECTED_REPLIES)}, {RANKED}, named AS (SELECT qid, list(id ORDER BY rank) AS ids, arg_min(category, rank) AS c FROM lists GROUP BY qid), "
    f"pairs AS (SELECT qid, ({g.once('ids')})[1] AS a, ({g.once('ids')})[2] AS b, c FROM named), made AS ({MADE_REPLIES}) "
    "SELECT qid::BIGINT AS qid, items FROM v UNION ALL "
    "SELECT qid, CASE WHEN reply IS NULL THEN a || '=' || CASE WHEN length(c) > 5 THEN 'This standard covers ' || c || '.' ELSE 'Relevant Indian Standard matching your query.' END || '|' || b || '=Related BIS standard.' "
    "WHEN json_valid(reply) THEN json_extract_string(reply, '$[0].standard') || '=' || json_extract_string(reply, '$[0].reason') || '|' || b || '=Relevant Indian Standard for your query.' "
    "ELSE a || '=' || substr(reply, 1, 200) || '|' || b || '=See above explanation.' END FROM made WHERE b IS NOT NULL"
)
def llm_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies read back: literal ones, of which the SQL states what each must give, and made ones, which it parses."""
    shown = lambda items: F.array_join(F.transform(items, lambda i: F.concat(i["standard"], F.lit("="), i["reason"])), "|").alias("items")
    std_ids, titles = F.array(F.lit("IS 269: 1989"), F.lit("IS 455: 1989")), F.array(F.lit("Ordinary cement"))
    rows = data.literal(spark, "qid, reply", REPLIES).select(F.col("qid").cast("long").alias("qid"), shown(rationale.parse_reply(F.col("reply"), std_ids, titles)))
    lists = ranked(spark, sf_dir).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "category"))).alias("r"))
    names = F.array_distinct(F.transform("r", lambda x: x["id"]))
    pairs = lists.where(F.size(names) > 1).select("qid", names[0].alias("a"), names[1].alias("b"), F.element_at("r", 1)["category"].alias("c"))
    made = spark.sql(MADE_REPLIES.replace("{", "{{").replace("}", "}}").replace("FROM pairs", "FROM {pairs}"), pairs=pairs)
    return rows.unionByName(made.select("qid", shown(rationale.parse_reply(F.col("reply"), F.array("a", "b"), F.array("c")))))


# ---- the client --------------------------------------------------------------------------------

CANNED = data.values("c0", "ord, id, query, k, e, r, latency, category", [(i, a, q, "; ".join(k), "; ".join(e), "; ".join(r), t, c) for i, (a, q, k, e, r, t, c) in enumerate(lex.CANNED)])
CANNED_SQL = f"{CANNED}, canned AS (SELECT ord, id, query, string_split(k, '; ') AS keywords, string_split(e, '; ') AS expected, string_split(r, '; ') AS retrieved, latency::DOUBLE AS latency, category FROM c0)"
MATCH = f"""
{ASKED}, {CANNED_SQL},
sc AS (
  SELECT q.qid, c.id, c.ord, coalesce(list_sum(list_transform(list_filter(c.keywords, lambda z: contains(lower(q.query), lower(z))), lambda z: 2 * len(string_split(z, ' ')))), 0)
    + len(list_filter(regexp_split_to_array(lower(c.query), '\\s+'), lambda z: length(z) > 4 AND list_contains(regexp_split_to_array(lower(q.query), '\\s+'), z))) AS score
  FROM q CROSS JOIN canned c),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, ord) AS k FROM sc) WHERE k = 1)
"""


@query(f"WITH {MATCH} SELECT qid, CASE WHEN score >= 3 THEN id END AS matched_id, score::INTEGER AS score FROM best")
def match_canned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.match(asked(spark, sf_dir), client.canned(spark))


#: Datasets to show: the canned ones, and the domain corpus' lists.
KNOWN = (
    f"{CANNED_SQL}, {RANKED}, by_list AS (SELECT qid, list(id ORDER BY rank) AS ids, list(category ORDER BY rank)[1] AS category, list(keywords ORDER BY rank)[1] AS keywords, any_value(query) AS query FROM lists GROUP BY qid), "
    f"known AS (SELECT * FROM canned UNION ALL SELECT (1000 + qid)::INTEGER, 'L' || qid, query, keywords, ({g.once('ids')})[2:2], ({g.once('ids')})[1:1 + (qid % 5)::INTEGER], qid / 100.0, category FROM by_list)"
)


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = F.struct("rank", "id", "category", "keywords")
    lists = ranked(spark, sf_dir).groupBy("qid").agg(F.array_sort(F.collect_list(row)).alias("r"), F.first("query").alias("query"))
    names = F.array_distinct(F.transform("r", lambda x: x["id"]))
    first = F.element_at("r", 1)
    made = lists.select(
        (F.col("qid") + 1000).cast("int").alias("ord"), F.concat(F.lit("L"), F.col("qid").cast("string")).alias("id"), "query", first["keywords"].alias("keywords"), F.slice(names, 2, 1).alias("expected"),
        F.slice(names, F.lit(1), (F.col("qid") % 5 + 1).cast("int")).alias("retrieved"), (F.col("qid") / 100.0).alias("latency"), first["category"].alias("category"),
    )
    return client.canned(spark).unionByName(made)


CATALOGUE = data.values("shelf", "id, title, category, description", lex.CATALOGUE)
CARDS = (
    f"{KNOWN}, {CATALOGUE}, each AS (SELECT id AS qid, keywords, expected, retrieved, unnest(retrieved) AS std_id, unnest(range(0, len(retrieved))) AS i FROM known), "
    f"cards AS (SELECT qid, std_id, coalesce(title, std_id) AS title, CASE WHEN list_contains(expected, std_id) THEN {data.quoted(client.PRIMARY)} ELSE '' END || coalesce(description, {data.quoted(client.UNKNOWN_TEXT)}) AS rationale, "
    "greatest(round(CASE WHEN list_contains(expected, std_id) THEN 0.97 - i * 0.04 ELSE 0.75 - i * 0.06 END, 2), 0.3)::DOUBLE AS confidence, (i + 1)::INTEGER AS rank, coalesce(category, 'general') AS category, "
    "list_contains(expected, std_id) AS is_primary, list_filter(retrieved, lambda z: z <> std_id) AS related, keywords[1:4] AS kw FROM each LEFT JOIN shelf ON shelf.id = std_id)"
)


@query(f"WITH {CARDS} SELECT qid, std_id, title, rationale, confidence, rank, category, is_primary, {g.join('related')} AS related, {g.join('kw')} AS matched FROM cards")
def result_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = client.cards(_known(spark, sf_dir), client.catalogue(spark))
    return cards.select(*[c for c in cards.columns if not c.endswith(("standards", "keywords"))], joined("related_standards").alias("related"), joined("matched_keywords").alias("matched"))


@query(
    f"WITH {MATCH}, m AS (SELECT q.qid, trim(q.query) AS t, c.* EXCLUDE (query) FROM q JOIN best b ON b.qid = q.qid LEFT JOIN canned c ON c.id = b.id AND b.score >= 3) "
    "SELECT qid, coalesce(latency, 0.87)::DOUBLE AS latency_seconds, t AS original_query, trim(regexp_replace(lower(t), '[^a-z0-9 ]', '', 'g')) AS normalized_query, CASE WHEN id IS NULL THEN 'BIS standard compliance' ELSE array_to_string(keywords, ', ') END AS expanded_query, "
    "coalesce(category, 'general') AS detected_category, CASE WHEN id IS NULL THEN 20 ELSE 25 END AS candidates_retrieved, 10 AS candidates_reranked, CASE WHEN id IS NULL THEN 4 ELSE len(retrieved)::INTEGER END AS candidates_output, id AS matched_dataset_id, expected[1] AS primary_standard FROM m"
)
def answer_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return client.answer_meta(asked(spark, sf_dir), client.canned(spark))


FALLBACK_CARDS = data.values("fb", "std_id, title, rationale, confidence, rank, category, is_primary", [tuple(str(v).lower() if isinstance(v, bool) else v for v in c[:7]) for c in client.FALLBACK_CARDS])


@query(
    f"WITH {MATCH}, {CARDS.removeprefix(CANNED_SQL + ', ')}, {FALLBACK_CARDS}, m AS (SELECT qid AS asked, CASE WHEN score >= 3 THEN id END AS mid FROM best) "
    "SELECT asked AS qid, std_id, title, rationale, confidence, rank, category, is_primary FROM m JOIN cards ON cards.qid = mid UNION ALL "
    "SELECT asked, std_id, title, rationale, confidence::DOUBLE, rank::INTEGER, category, is_primary = 'true' FROM m, fb WHERE mid IS NULL"
)
def answer_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = client.answer_cards(asked(spark, sf_dir), client.canned(spark), client.catalogue(spark))
    return found.drop("related_standards", "matched_keywords")


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cards = client.cards(_known(spark, sf_dir), client.catalogue(spark))
    return cards.select("qid", "rank", F.col("std_id").alias("id"), "title", "related_standards")


@query(
    f"WITH {CARDS}, a AS (SELECT *, (rank - 1) * 2 * pi() / count(*) OVER (PARTITION BY qid) AS angle FROM cards), n AS (SELECT qid, std_id, angle, unnest(related[1:2]) AS rel, unnest(range(0, least(len(related), 2))) AS j FROM a) "
    "SELECT DISTINCT qid, 'query' AS id, 'Query' AS label, 150.0::DOUBLE AS x, 150.0::DOUBLE AS y, 'query' AS type, 30 AS radius FROM cards UNION ALL "
    "SELECT qid, std_id, std_id, round(150 + 90 * cos(angle), 6), round(150 + 90 * sin(angle), 6), 'primary', 25 FROM a UNION ALL "
    "SELECT qid, std_id || '-' || rel, rel, round(150 + 150 * cos(angle + CASE WHEN j = 0 THEN 0.4 ELSE -0.4 END), 6), round(150 + 150 * sin(angle + CASE WHEN j = 0 THEN 0.4 ELSE -0.4 END), 6), 'secondary', 18 FROM n"
)
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = client.graph(_placed(spark, sf_dir))[0]
    return nodes.select("qid", "id", "label", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "type", "radius")


@query(
    f"WITH {CARDS}, n AS (SELECT qid, std_id, unnest(related[1:2]) AS rel FROM cards) SELECT qid, 'query' AS source, std_id AS target FROM cards UNION ALL SELECT qid, std_id, std_id || '-' || rel FROM n"
)
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = client.graph(_placed(spark, sf_dir))
    return client.resolved_edges(nodes, edges).select("qid", "source", "target")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, text DESC)::INTEGER AS pos FROM conversations WHERE role = 'user'")
def history_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as query histories, newest first."""
    asked = data.table(spark, sf_dir, "conversations").where("role = 'user'")
    asked = asked.select(F.col("conv_id").alias("user"), F.col("turn").alias("ts"), F.col("text").alias("seq"))
    return client.history(asked).select(F.col("user").alias("conv_id"), F.col("ts").alias("turn"), "pos")


_RAW_TERMS = f"list_filter(regexp_split_to_array(regexp_replace(query, '[^\\w\\s:-]', ' ', 'g'), '\\s+'), lambda z: length(z) > 2 AND NOT list_contains({g.lst(lex.TERM_STOPWORDS)}, lower(z)))"


@query(
    f"WITH {ASKED}, t AS (SELECT qid, query, {_RAW_TERMS} AS w FROM q), l AS (SELECT *, list_transform(w, lambda z: lower(z)) AS lw FROM t) "
    "SELECT qid, coalesce(array_to_string(list_filter(w, lambda z, j: list_position(lw, lower(z)) = j), '|'), '') AS terms, "
    "coalesce(nullif(regexp_extract(trim(query), '(?s)^(.*?[.!?])\\s', 1), ''), trim(query)) AS first_sentence, trim(regexp_replace(lower(query), '[^a-z0-9 ]', '', 'g')) AS plain, "
    "coalesce(nullif(regexp_replace(regexp_replace(substr(trim(query), 1, 48), '[^a-zA-Z0-9-_ ]', '', 'g'), '\\s+', '_', 'g'), ''), 'BIS_Export') AS file_part FROM l"
)
def client_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("query")
    return asked(spark, sf_dir).select(
        "qid", joined(text.expanded_terms(q)).alias("terms"), text.first_sentence(q).alias("first_sentence"), text.plain_query(q).alias("plain"), text.safe_file_part(q).alias("file_part"),
    )


@query(
    f"WITH {CARDS} SELECT qid, rank, CASE WHEN rank = 1 THEN 'high' WHEN rank <= 3 THEN 'medium' ELSE 'low' END AS tone, least(greatest(confidence * 2 - 0.5, 0), 1)::DOUBLE AS clamped, "
    "CASE WHEN len(related) > 0 THEN array_to_string(related[1:2], ' · ') || CASE WHEN len(related) > 2 THEN '  +' || (len(related) - 2) ELSE '' END END AS preview, greatest(len(related) - 3, 0)::INTEGER AS more FROM cards"
)
def card_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = client.cards(_known(spark, sf_dir), client.catalogue(spark))
    more = text.take_with_more(F.col("related_standards"), 3)["more"]
    return c.select("qid", "rank", text.tone(F.col("rank")).alias("tone"), text.clamp01(F.col("confidence") * 2 - 0.5).alias("clamped"), text.preview(F.col("related_standards")).alias("preview"), more.alias("more"))


@query(f"WITH {ASKED}, {data.values('k', 'a, b', list(lex.LEGACY_SYNONYMS.items()))} SELECT qid, lower(query) || coalesce((SELECT string_agg(' ' || b, '' ORDER BY rowid) FROM (SELECT a, b, row_number() OVER () AS rowid FROM k) WHERE contains(lower(q.query), a)), '') AS expanded FROM q")
def legacy_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asked(spark, sf_dir).select("qid", text.legacy_expand(F.col("query")).alias("expanded"))


@query(f"WITH {g.RAW} SELECT std_seq, {g.group('id', r'(?i)IS\s*(\d+)')} AS number, {g.part_of('text', r'(?i)part\s*(\d+)')} AS part_in_text, try_cast({g.group('text', r'\b(19\d{2}|20\d{2})\b')} AS INTEGER) AS year FROM raw")
def id_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = data.standards(spark, sf_dir)
    return s.select(
        "std_seq", text.full(ids.standard_number(F.col("id"))).alias("number"), ids.part(F.col("text"), ids.PART_OF_TEXT).alias("part_in_text"), ids.year_anywhere(F.col("text")).alias("year"),
    )
