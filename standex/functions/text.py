"""Text functions, Column to Column. Built-in expressions only: they stay inside generated code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex

#: What Python's strip() removes, in ASCII.
BLANK = " \t\n\x0b\x0c\r"


def literals(terms: list[str]) -> Column:
    return F.array(*[F.lit(t) for t in terms])


def strip(x: Column, chars: str = BLANK) -> Column:
    return F.btrim(x, F.lit(chars))


def full(x: Column) -> Column:
    """Null for the empty string: concat_ws then leaves it out."""
    return F.nullif(x, F.lit(""))


def split_words(x: Column) -> Column:
    """Words between white space; the empty array for a blank text."""
    return F.filter(F.split(strip(x), r"\s+"), lambda w: w != "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once. Spark computes what stands in a lambda anew for each element."""
    return F.transform(F.array(value), body)[0]


def found(terms: list[str], text: Column) -> Column:
    """The terms that occur in the text as substrings, in their own order. The text is read once a term, so it should be
    a column, or bound by let()."""
    return F.filter(literals(terms), lambda t: F.contains(text, t))


def tokenize(x: Column) -> Column:
    """Search tokens: lower case, ids and parts also as one word, stop words and single characters out."""
    t = F.lower(x)
    t = F.regexp_replace(t, r"is\s*(\d+)", "is$1 $1")
    t = F.regexp_replace(t, r"\(part\s*(\d+)\)", "part$1 part $1")
    t = F.regexp_replace(t, r"\(sec\s*(\d+)\)", "sec$1 sec $1")
    return F.filter(F.split(t, r"[^\p{L}\p{N}_\-]+"), lambda w: (F.length(w) > 1) & ~w.isin(lex.STOPWORDS))


def normalize_query(x: Column) -> Column:
    q = F.lower(strip(x))
    for typo, fix in lex.TYPO_FIXES.items():
        q = F.replace(q, F.lit(typo), F.lit(fix))
    q = F.regexp_replace(q, r"\bis[\-\s]*(\d)", "is $1")
    q = F.regexp_replace(q, r"\(part\s*(\d+)\)", "part $1")
    q = F.regexp_replace(q, r"part[\-\s]*(\d)", "part $1")
    q = F.regexp_replace(q, r"sec[\-\s]*(\d)", "sec $1")
    return strip(F.regexp_replace(q, r"\s+", " "))


def longest_first(pairs: dict[str, str] | dict[str, list[str]], q: Column, most: int | None = None) -> Column:
    """Values of the phrases that occur in q, longest phrase first, then in the map's order."""
    rows = [
        F.struct(F.lit(-len(p)).alias("n"), F.lit(i).alias("ord"), F.lit(p).alias("phrase"), (literals(v) if isinstance(v, list) else F.lit(v)).alias("value"))
        for i, (p, v) in enumerate(pairs.items())
    ]
    hit = F.array_sort(F.filter(F.array(*rows), lambda s: F.contains(q, s["phrase"])))
    hit = F.slice(hit, 1, most) if most else hit
    return F.transform(hit, lambda s: s["value"])


def expand_normalized(q: Column) -> Column:
    """The expansion of a query that is normalised already."""
    short = [F.when(q.rlike(rf"\b{a}\b"), F.lit(full_form)) for a, full_form in lex.ABBREVIATIONS.items()]
    parts = F.concat_ws(" ", q, *short, F.array_join(longest_first(lex.EXPANSIONS, q, 3), " "))
    words = F.array_distinct(split_words(parts))  # keeps first occurrences; all parts are lower case
    return F.array_join(F.slice(words, 1, F.size(split_words(q)) * 5), " ")


def expand_query(x: Column) -> Column:
    """Normalised query, abbreviations spelled out, contexts of the three longest phrases; each
    word once, at most five times the query's words."""
    return expand_normalized(normalize_query(x))


def legacy_expand(x: Column) -> Column:
    """The older expansion by substrings. It injects identifiers; nothing here uses it."""
    q = F.lower(x)
    return F.concat(q, *[F.when(F.contains(q, F.lit(a)), F.lit(f" {b}")).otherwise("") for a, b in lex.LEGACY_SYNONYMS.items()])


def list_to_string(x: Column, most: int = 15) -> Column:
    """The first items that aren't empty, stripped, joined by a space."""
    kept = F.filter(F.slice(x, 1, most), lambda v: v.isNotNull() & (v != ""))
    return F.coalesce(F.array_join(F.transform(kept, lambda v: strip(v)), " "), F.lit(""))


def first_best(scores: list[tuple[str, Column]], least: int) -> Column:
    """The name with the highest score, the first on ties; null if that is below `least`."""
    rows = [F.struct(s.alias("score"), F.lit(-i).alias("ord"), F.lit(name).alias("name")) for i, (name, s) in enumerate(scores)]
    best = F.array_max(F.array(*rows))
    return F.when(best["score"] >= least, best["name"])


def query_category(x: Column) -> Column:
    """Category by weighted phrases, null below a weight of 2."""
    return category_of_normalized(normalize_query(x))


def category_of_normalized(q: Column) -> Column:
    def weight(signals: list[tuple[str, int]]) -> Column:
        return sum((F.when(F.contains(q, F.lit(p)), w).otherwise(0) for p, w in signals), F.lit(0))

    return first_best([(name, weight(s)) for name, s in lex.CATEGORY_SIGNALS.items()], 2)


def domain_hints(x: Column, enabled: bool = False) -> Column:
    """Hinted standards, longest phrase first, each once; none unless enabled."""
    if not enabled:
        return F.array().cast("array<string>")
    return F.array_distinct(F.flatten(longest_first(lex.DOMAIN_HINTS, normalize_query(x))))


def scope(text: Column) -> Column:
    """A text's scope statement, white space collapsed, at most 200 characters; else empty."""
    found_scope = F.regexp_extract(text, r"(?is)(?:1\.\s*)?Scope\s*[—\-:]+\s*(.+?)(?:\.|2\.\s|Note\s)", 1)
    return F.substring(F.regexp_replace(strip(found_scope), r"\s+", " "), 1, 200)


def matched_terms(query: Column, text: Column, most: int = 5) -> Column:
    """Query words of more than 3 characters that occur in the text, in the query's order."""
    words = F.array_except(split_words(F.lower(query)), literals(lex.RATIONALE_STOPWORDS))
    return let(F.lower(text), lambda low: F.slice(F.filter(words, lambda w: (F.length(w) > 3) & F.contains(low, w)), 1, most))


def plain_query(x: Column) -> Column:
    """The client's normal form: lower case, only a-z, 0-9 and spaces."""
    return strip(F.regexp_replace(F.lower(x), "[^a-z0-9 ]", ""))


def expanded_terms(x: Column) -> Column:
    """Distinct terms (letter case aside) of more than 2 characters, stop words out."""
    raw = split_words(F.regexp_replace(x, r"[^\w\s:-]", " "))
    stop = literals(lex.TERM_STOPWORDS)
    kept = F.filter(raw, lambda w: (F.length(w) > 2) & ~F.array_contains(stop, F.lower(w)))
    low = F.transform(kept, lambda w: F.lower(w))
    return F.filter(kept, lambda w, i: F.array_position(low, F.lower(w)) == i + 1)


def first_sentence(x: Column) -> Column:
    t = strip(x)
    head = F.regexp_extract(t, r"(?s)^(.*?[.!?])\s", 1)
    return F.when(head == "", t).otherwise(head)


def preview(ids: Column) -> Column:
    """'a · b  +n' of a list of ids; null if empty."""
    clean = F.filter(F.transform(ids, lambda s: F.regexp_replace(s, "^(.*?) : ", "$1:")), lambda s: s != "")
    more = F.size(clean) - 2
    text = F.concat(F.array_join(F.slice(clean, 1, 2), " · "), F.when(more > 0, F.concat(F.lit("  +"), more.cast("string"))).otherwise(""))
    return F.when(F.size(clean) > 0, text)


def take_with_more(items: Column, limit: int) -> Column:
    """(shown, more): the first items, and how many there are besides."""
    return F.struct(F.slice(items, 1, limit).alias("shown"), F.greatest(F.size(items) - limit, F.lit(0)).alias("more"))


def tone(rank: Column) -> Column:
    return F.when(rank == 1, "high").when(rank <= 3, "medium").otherwise("low")


def safe_file_part(x: Column) -> Column:
    """A file name's part from a query; a default name where nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(F.substring(strip(F.coalesce(x, F.lit(""))), 1, 48), "[^a-zA-Z0-9-_ ]", ""), r"\s+", "_")
    return F.coalesce(full(kept), F.lit("BIS_Export"))


def clamp01(x: Column) -> Column:
    return F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
