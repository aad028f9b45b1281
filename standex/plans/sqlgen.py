"""DuckDB SQL for the oracles, put together from expressions. Written apart from the Spark side."""

from __future__ import annotations

from ..functions import lexicons as lex
from .data import NUMBERS, STANDARDS, TERMS, quoted

BLANK = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def lst(terms: list) -> str:
    return "[" + ", ".join(quoted(t) for t in terms) + "]"


def strip(x: str) -> str:
    return f"trim({x}, {BLANK})"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(to)}, 'g')"


def has(terms: list[str], low: str) -> str:
    return f"list_filter({lst(terms)}, lambda q: contains({low}, q))"


def n_has(terms: list[str], low: str) -> str:
    return f"len({has(terms, low)})"


def once(x: str) -> str:
    """First occurrences, in order."""
    return f"list_filter({x}, lambda q, j: list_position({x}, q) = j)"


def join(x: str, sep: str = "|") -> str:
    return f"coalesce(array_to_string({x}, {quoted(sep)}), '')"


def tokens(x: str) -> str:
    t = sub(f"lower({x})", r"is\s*(\d+)", r"is\1 \1")
    t = sub(t, r"\(part\s*(\d+)\)", r"part\1 part \1")
    t = sub(t, r"\(sec\s*(\d+)\)", r"sec\1 sec \1")
    t = sub(t, r"[^\p{L}\p{N}_\s\-]", " ")
    return f"list_filter(regexp_split_to_array({t}, '\\s+'), lambda q: length(q) > 1 AND NOT list_contains({lst(lex.STOPWORDS)}, q))"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda q: q <> '')"


def normal_query(x: str) -> str:
    q = f"lower({strip(x)})"
    for typo, fix in lex.TYPO_FIXES.items():
        q = f"replace({q}, {quoted(typo)}, {quoted(fix)})"
    q = sub(q, r"\bis[\-\s]*(\d)", r"is \1")
    q = sub(q, r"\(part\s*(\d+)\)", r"part \1")
    q = sub(q, r"part[\-\s]*(\d)", r"part \1")
    q = sub(q, r"sec[\-\s]*(\d)", r"sec \1")
    return f"trim({sub(q, r'\s+', ' ')})"


def phrases(pairs: dict[str, str], q: str, most: int | None = None) -> str:
    """Values of the phrases found, longest first."""
    order = sorted(range(len(pairs)), key=lambda i: -len(list(pairs)[i]))
    keys, vals = list(pairs), list(pairs.values())
    hit = f"list_filter({lst([keys[i] for i in order])}, lambda p: contains({q}, p))"
    named = f"list_transform({hit}, lambda p: {lst([vals[i] for i in order])}[list_position({lst([keys[i] for i in order])}, p)])"
    return f"({named})[1:{most}]" if most else named


def expanded(q: str) -> str:
    """From a normalised query; q should be a column."""
    short = ", ".join(f"CASE WHEN regexp_matches({q}, {quoted(rf'\b{a}\b')}) THEN {quoted(b)} END" for a, b in lex.ABBREVIATIONS.items())
    parts = f"concat_ws(' ', {q}, {short}, array_to_string({phrases(lex.EXPANSIONS, q, 3)}, ' '))"
    return f"array_to_string(({once(words(parts))})[1:5 * len({words(q)})], ' ')"


def group(x: str, pattern: str, g: int = 1) -> str:
    return f"nullif(regexp_extract({x}, {quoted(pattern)}, {g}), '')"


RAW_ID = r"(?i)IS\s*(\d+)(?:\s*\(?\s*Part\s*(\d+)\s*\)?)?(?:\s*[:\-]?\s*(\d{4}))?"


def _case(x: str, pairs: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in pairs.items()) + " END"


def formatted(x: str) -> str:
    t = strip(x)
    num, part, year = (group(t, RAW_ID, g) for g in (1, 2, 3))
    known = f"CASE WHEN {part} IS NULL THEN {_case(num, lex.KNOWN_YEARS)} ELSE coalesce({_case(f'{num} || {quoted("-")} || {part}', lex.KNOWN_PART_YEARS)}, {_case(num, lex.KNOWN_YEARS)}) END"
    y = f"coalesce({year}, {known})"
    return f"CASE WHEN {x} = '' THEN {x} WHEN {num} IS NULL THEN {t} ELSE 'IS ' || {num} || coalesce(' (Part ' || {part} || ')', '') || coalesce(': ' || {y}, '') END"


def valid(x: str) -> str:
    return f"regexp_matches({x}, '(?i)^IS\\s+\\d+(?:\\s+\\(Part\\s+\\d+\\))?\\s*:\\s*\\d{{4}}$')"


def base_key(x: str) -> str:
    num = group(x, r"(?i)IS\s+(\d+)")
    return f"CASE WHEN {num} IS NULL THEN lower({x}) ELSE concat_ws('_part', {num}, {group(x, r'(?i)\(Part\s+(\d+)\)')}) END"


def year_end(x: str) -> str:
    return f"try_cast({group(x, r':\s*(\d{4})\s*$')} AS INTEGER)"


def part_of(x: str, pattern: str = r"(?i)\(Part\s+(\d+)\)") -> str:
    return f"try_cast({group(x, pattern)} AS INTEGER)"


NUMBERS_RE = r"(?i)\bIS\s*(\d{1,5}(?:\s*\(Part\s*\d+\))?(?:\s*\(Sec\s*\d+\))?)\b"
LOOSE_RE = r"(?i)\bIS\s*(\d{1,5}(?:\s*\(Part\s*\d+\))?)"


def numbers(x: str, pattern: str = NUMBERS_RE) -> str:
    found = f"regexp_extract_all({x}, {quoted(pattern)}, 1)"
    raw = f"list_transform({found}, lambda q: lower({sub('q', r'\s+', '')}))"
    num = f"list_transform({found}, lambda q: {sub('string_split(q, ' + quoted('(') + ')[1]', r'[^\d]', '')})"
    return f"list_sort(list_distinct(list_concat({raw}, {num})))"


def references(x: str, own: str) -> str:
    found = f"regexp_extract_all({x}, {quoted(r'(?i)IS\s+(\d{1,5}(?:\s*\(Part\s+\d+\))?(?:\s*:\s*\d{4})?)')}, 1)"
    named = f"list_transform({found}, lambda q: 'IS ' || trim({sub('q', r'\s+', ' ')}))"
    number = lambda v: f"regexp_extract({v}, {quoted(r'(?i)IS\s*(\d+)')}, 1)"
    return f"list_sort(list_distinct(list_filter({named}, lambda q: {number('q')} <> {number(own)})))[1:15]"


def category(low: str) -> str:
    counts = {c: n_has(k, low) for c, k in lex.CATEGORY_KEYWORDS.items()}
    best = f"greatest({', '.join(counts.values())})"
    return f"CASE WHEN {best} < 2 THEN 'general' " + " ".join(f"WHEN {n} = {best} THEN {quoted(c)}" for c, n in counts.items()) + " END"


def keywords(low: str, cat: str) -> str:
    own = [f"CASE WHEN {cat} = {quoted(c)} THEN {has(t, low)} ELSE [] END" for c, t in lex.TECHNICAL_TERMS.items()]
    other = [f"CASE WHEN {cat} <> {quoted(c)} THEN {has(t, low)} ELSE [] END" for c, t in lex.TECHNICAL_TERMS.items()]
    parts = [f"CASE WHEN {cat} <> 'general' THEN [{cat}] ELSE [] END", *own, *other, has(lex.DOMAIN_NOUNS, low)]
    return _concat(parts)


def _concat(parts: list[str]) -> str:
    out = parts[0]
    for p in parts[1:]:
        out = f"list_concat({out}, {p})"
    return out


def domains(low: str) -> str:
    rows = ", ".join(f"{{'n': -{n_has(t, low)}, 'o': {i}, 'd': {quoted(d)}}}" for i, (d, t) in enumerate(lex.APPLICATION_DOMAINS.items()))
    return f"list_transform((list_sort(list_filter([{rows}], lambda q: q.n < 0)))[1:3], lambda q: q.d)"


#: The domain corpus step by step, each a common table expression.
RAW = f"{NUMBERS}, {TERMS}, raw AS ({STANDARDS})"
CHUNKS = f"""
{RAW},
low AS (SELECT *, lower(text) AS l FROM raw),
cat AS (SELECT *, {category('l')} AS category FROM low),
key0 AS (SELECT *, {keywords('l', 'category')} AS k0 FROM cat),
key AS (SELECT *, {once('k0')} AS keys FROM key0),
body AS (
  SELECT *, list_concat([
      concat_ws(' ', nullif(id, ''), nullif(title, ''), CASE WHEN category <> 'general' THEN category END, nullif(array_to_string(keys[1:15], ' '), '')),
      substr(text, 1, 600)],
    CASE WHEN length(text) > 600 THEN list_transform(range(0, length(text) - 600, 800), lambda s: id || ' ' || title || ' ' || substr(text, 601 + s, 1200)) ELSE [] END) AS bodies,
    sum(2 + CASE WHEN length(text) > 600 THEN ceil((length(text) - 600) / 800.0) ELSE 0 END) OVER (ORDER BY std_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
  FROM key),
chunks AS (
  SELECT (coalesce(before, 0) + j)::BIGINT AS doc_idx, id, title, bodies[j + 1] AS text, category,
    CASE WHEN j = 0 THEN keys[1:20] ELSE keys[1:10] END AS keywords, {part_of('id')} AS part_number,
    try_cast({group('id', r'\b(19\d{2}|20\d{2})\b')} AS INTEGER) AS standard_year, j = 0 AS is_summary_chunk,
    CASE WHEN j > 0 THEN j - 1 END AS chunk_index
  FROM (SELECT *, unnest(range(0, len(bodies))) AS j FROM body))
"""


def props(kind: str) -> str:
    return f"({has(lex.TECHNICAL_PROPERTIES[kind], 'l')})[1:10]"


KINDS = list(lex.TECHNICAL_PROPERTIES)
ENRICHED = f"""
{CHUNKS},
clow AS (SELECT *, lower(text) AS l FROM chunks),
enriched AS (
  SELECT * EXCLUDE (l), {references('text', 'id')} AS related_standards, {', '.join(f'{props(k)} AS p_{k}' for k in KINDS)},
    {domains('l')} AS application_domains, ({has(lex.COMPOSITION_TERMS, 'l')})[1:12] AS composition_terms,
    list_contains({lst(lex.TEST_METHOD_STANDARDS)}, regexp_extract(id, '(?i)IS\\s*(\\d+)', 1)) OR {n_has(lex.TEST_METHOD_INDICATORS, 'l')} >= 2 AS is_test_method,
    'IS ' || {group('text', r'(?i)(?:superseded|replaced|revised)\s+by\s+IS\s+(\d+(?:\s*:\s*\d{4})?)')} AS superseded_by
  FROM clow)
"""
PROPS10 = "(" + _concat([f"p_{k}[1:3]" for k in KINDS]) + ")[1:10]"
CORPUS = f"""
{ENRICHED},
corpus AS (
  SELECT *, concat_ws(' ', nullif(id, ''), nullif(title, ''), nullif(text, ''), nullif(category, ''), nullif({join('keywords[1:20]', ' ')}, ''),
    nullif({join('related_standards[1:10]', ' ')}, ''), nullif({join('composition_terms[1:10]', ' ')}, ''),
    nullif({join('application_domains[1:5]', ' ')}, ''), nullif({join(PROPS10, ' ')}, '')) AS search_text
  FROM enriched)
"""
SCALE = "corpus AS (SELECT doc_id AS doc_idx, '' AS id, '' AS title, text, lang AS category, concat_ws(' ', text, lang) AS search_text FROM documents)"
#: From corpus: tokens, postings, vocabulary, statistics.
LEXICAL = f"""
tok AS (SELECT doc_idx, {tokens('search_text')} AS w FROM corpus),
post AS (SELECT doc_idx, dl, term, count(*) AS tf FROM (SELECT doc_idx, len(w) AS dl, unnest(w) AS term FROM tok) GROUP BY ALL),
vocab AS (SELECT term, count(*) AS df FROM post GROUP BY term),
size AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok),
stats AS (SELECT n, avgdl, (SELECT avg(ln(n - df + 0.5) - ln(df + 0.5)) FROM vocab) AS avg_idf FROM size)
"""
#: From q(qid, query): expanded query tokens, scores, ranks, fusion, boosts.
EXPANSION = f"""
qt AS (SELECT qid, query, {tokens('query')} AS w FROM q),
qe AS (SELECT qid, w, unnest(w) AS term, unnest(range(0, len(w))) AS pos FROM qt),
qterm AS (SELECT DISTINCT term FROM qe),
pairs AS (
  SELECT a.term, b.term AS nbr, count(*) AS cnt FROM post a JOIN qterm USING (term) JOIN post b ON a.doc_idx = b.doc_idx AND a.term <> b.term GROUP BY ALL),
scored AS (
  SELECT p.term, p.nbr, round(cnt * ln((n + 1) / (df + 1)), 6) AS score FROM pairs p JOIN vocab v ON p.nbr = v.term, size WHERE df <= 0.6 * n),
exps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, nbr) AS rnk FROM scored) WHERE rnk <= 6),
more AS (
  SELECT qid, nbr, min(pos * 10 + rnk) AS o FROM qe JOIN exps USING (term) WHERE NOT list_contains(w, nbr) GROUP BY qid, nbr),
took AS (SELECT qid, nbr, o, row_number() OVER (PARTITION BY qid ORDER BY o) AS k FROM more),
wide AS (
  SELECT qt.qid, list_concat(w, coalesce((SELECT list(nbr ORDER BY o) FROM took WHERE took.qid = qt.qid AND k <= len(w)), [])) AS w FROM qt)
"""


def bm25(source: str) -> str:
    """scores(qid, doc_idx, score) and lex(qid, doc_idx, score, rank) from tokens in `source`."""
    return f"""
wt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest(w) AS term FROM {source}) GROUP BY ALL),
wi AS (
  SELECT qid, term, qtf, CASE WHEN r < 0 THEN 0.25 * avg_idf ELSE r END AS idf
  FROM (SELECT qid, term, qtf, avg_idf, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM wt JOIN vocab USING (term), stats)),
bm AS (
  SELECT qid, doc_idx, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM post JOIN wi USING (term), stats GROUP BY qid, doc_idx),
lex AS (
  SELECT * FROM (
    SELECT q.qid, c.doc_idx, coalesce(score, 0) AS score, row_number() OVER (PARTITION BY q.qid ORDER BY coalesce(score, 0) DESC, c.doc_idx DESC) AS rank
    FROM q CROSS JOIN (SELECT doc_idx FROM corpus) c LEFT JOIN bm ON bm.qid = q.qid AND bm.doc_idx = c.doc_idx) WHERE rank <= 20)
"""


#: From qv(qid, embedding): dense ranks over the vectors.
DENSE = """
sims AS (
  SELECT qid, vec_id AS doc_idx, round(list_inner_product(e.embedding::DOUBLE[], qv.embedding::DOUBLE[]), 9) AS sim FROM embeddings e, qv),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, doc_idx) AS rank FROM sims) WHERE rank <= 20)
"""
COVERAGE = """
cov0 AS (
  SELECT qt.qid, CASE WHEN len(w) = 0 THEN 1.0 ELSE (SELECT count(*) FROM qe JOIN vocab USING (term) WHERE qe.qid = qt.qid)::DOUBLE / len(w) END AS coverage FROM qt),
cov AS (
  SELECT qid, coverage, CASE WHEN coverage < 0.4 THEN 2.0 WHEN coverage < 0.7 THEN 1.7 ELSE 1.5 END AS w_sem,
    CASE WHEN coverage < 0.4 THEN 0.6 WHEN coverage < 0.7 THEN 0.8 ELSE 1.0 END AS w_lex FROM cov0)
"""
FUSION = """
fused AS (
  SELECT coalesce(d.qid, x.qid) AS qid, coalesce(d.doc_idx, x.doc_idx) AS doc_idx, coalesce(w_sem / (40 + d.rank), 0) + coalesce(w_lex / (40 + x.rank), 0) AS score
  FROM dense d FULL JOIN lex x ON d.qid = x.qid AND d.doc_idx = x.doc_idx JOIN cov ON cov.qid = coalesce(d.qid, x.qid))
"""
SIGNALS = """
tc AS (
  SELECT term, category, count(*) AS cnt FROM (SELECT DISTINCT doc_idx, term FROM post) p
  JOIN (SELECT doc_idx, lower(trim(category)) AS category FROM corpus WHERE coalesce(trim(category), '') <> '') c USING (doc_idx) GROUP BY ALL),
sig AS (SELECT * FROM (SELECT term, category, cnt / sum(cnt) OVER (PARTITION BY term) AS share FROM tc) WHERE share > 0.25)
"""
_PART = r"(?i)part\s*(\d+)"
BOOSTED = f"""
det AS (SELECT qid, list_sort(list(DISTINCT category)) AS detected FROM qe JOIN sig USING (term) GROUP BY qid),
facts AS (
  SELECT f.qid, f.doc_idx, f.score, c.category, d.detected, {part_of('q.query', _PART)} AS qp, {part_of('c.search_text', _PART)} AS dp,
    1.0 + 0.4 * len(list_intersect({numbers('q.query')}, {numbers('c.search_text')})) AS base
  FROM fused f JOIN corpus c USING (doc_idx) JOIN q ON q.qid = f.qid LEFT JOIN det d ON d.qid = f.qid),
boosted AS (
  SELECT qid, doc_idx, round(score * (base + CASE WHEN qp IS NULL OR dp IS NULL THEN 0 WHEN qp = dp THEN 0.3 ELSE -0.15 * base END)
    * CASE WHEN detected IS NULL THEN 1.0 WHEN len(list_filter(detected, lambda z: contains(lower(category), z))) > 0 THEN 1.15 ELSE 0.92 END, 9) AS rrf_score
  FROM facts),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rrf_score DESC, doc_idx) AS rank FROM boosted) WHERE rank <= 20)
"""
