"""Functions over identifiers of standards, Column to Column."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex
from .text import full, strip

# Patterns of identifiers.
RAW_ID = r"(?i)IS\s*(\d+)(?:\s*\(?\s*Part\s*(\d+)\s*\)?)?(?:\s*[:\-]?\s*(\d{4}))?"
VALID_ID = r"(?i)^IS\s+\d+(?:\s+\(Part\s+\d+\))?\s*:\s*\d{4}$"
LINE_ID = r"(?i)(IS\s+\d{1,5}(?:\s*\(Part\s+\d+\))?(?:\s*\(Sec\s+\d+\))?\s*[:\-]?\s*\d{4}|IS\s+\d{1,5})"
NUMBERS = r"(?i)\bIS\s*(\d{1,5}(?:\s*\(Part\s*\d+\))?(?:\s*\(Sec\s*\d+\))?)\b"
NUMBERS_LOOSE = r"(?i)\bIS\s*(\d{1,5}(?:\s*\(Part\s*\d+\))?)"
REFERENCE = r"(?i)IS\s+(\d{1,5}(?:\s*\(Part\s+\d+\))?(?:\s*:\s*\d{4})?)"
SUPERSEDED = r"(?i)(?:superseded|replaced|revised)\s+by\s+IS\s+(\d+(?:\s*:\s*\d{4})?)"
# A number, a year at the end or anywhere, white space and other than digits, what precedes a bracket.
NUMBER_OF_ID, NUMBER_OF_TEXT = r"(?i)IS\s+(\d+)", r"(?i)IS\s*(\d+)"
YEAR_AT_END, YEAR_ANYWHERE = r":\s*(\d{4})\s*$", r"\b(19\d{2}|20\d{2})\b"
SPACES, NOT_DIGITS, BEFORE_BRACKET = r"\s+", r"[^\d]", r"^([^(]*)"
# A part's number in an id, in a text, and in what the reranker reads.
PART_OF_ID, PART_OF_TEXT, PART_LOOSE = r"(?i)\(Part\s+(\d+)\)", r"(?i)part\s*(\d+)", r"(?i)part[\s\-]*(\d+)"


def extract(x: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, or null."""
    return full(F.regexp_extract(x, pattern, group))


def _table(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(v) for v in chain.from_iterable(pairs.items())])


def known_year(num: Column, part: Column) -> Column:
    """A standard's year by number and part, else by number, else empty."""
    by_number = F.coalesce(F.try_element_at(_table(lex.KNOWN_YEARS), num), F.lit(""))
    by_part = F.try_element_at(_table(lex.KNOWN_PART_YEARS), F.concat(num, F.lit("-"), part))
    return F.when(part.isNotNull(), F.coalesce(by_part, by_number)).otherwise(by_number)


def format_standard_id(x: Column) -> Column:
    """Canonical 'IS n[ (Part p)][: yyyy]'; texts without an id come back stripped."""
    text = strip(x)
    num, part, year = (extract(text, RAW_ID, g) for g in (1, 2, 3))
    year = F.coalesce(year, full(known_year(num, part)))
    made = F.concat(
        F.lit("IS "), num,
        F.when(part.isNotNull(), F.concat(F.lit(" (Part "), part, F.lit(")"))).otherwise(""),
        F.when(year.isNotNull(), F.concat(F.lit(": "), year)).otherwise(""),
    )
    return F.when(x == "", x).when(num.isNull(), text).otherwise(made)


def normalize_id(x: Column) -> Column:
    return F.lower(F.replace(F.coalesce(x, F.lit("")), F.lit(" "), F.lit("")))


def is_valid(x: Column) -> Column:
    return x.rlike(VALID_ID)


def base_key(x: Column) -> Column:
    """Number, and part if any: versions of one standard share it."""
    num = extract(x, NUMBER_OF_ID)
    return F.when(num.isNull(), F.lower(x)).otherwise(F.concat_ws("_part", num, extract(x, PART_OF_ID)))


def year_at_end(x: Column) -> Column:
    return extract(x, YEAR_AT_END).try_cast("int")


def year_anywhere(x: Column) -> Column:
    return extract(x, YEAR_ANYWHERE).try_cast("int")


def part(x: Column, pattern: str = PART_OF_ID) -> Column:
    return extract(x, pattern).try_cast("int")


def standard_number(x: Column) -> Column:
    return F.regexp_extract(x, NUMBER_OF_TEXT, 1)


def is_numbers(x: Column, pattern: str = NUMBERS) -> Column:
    """The identifiers in a text: each without white space, and its bare number; sorted."""
    all_of = F.regexp_extract_all(x, F.lit(pattern), F.lit(1))
    each = F.transform(
        all_of,
        lambda m: F.array(
            F.lower(F.regexp_replace(m, SPACES, "")), F.regexp_replace(F.regexp_extract(m, BEFORE_BRACKET, 1), NOT_DIGITS, "")
        ),
    )
    return F.array_sort(F.array_distinct(F.filter(F.flatten(each), lambda v: v != "")))


def related_standards(text: Column, own_id: Column, most: int = 15) -> Column:
    """Other standards that a text mentions, in order of their names."""
    refs = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(1))
    named = F.transform(refs, lambda m: F.concat(F.lit("IS "), strip(F.regexp_replace(m, SPACES, " "))))
    own = standard_number(own_id)
    return F.slice(F.array_sort(F.array_distinct(F.filter(named, lambda r: standard_number(r) != own))), 1, most)


def superseded_by(text: Column) -> Column:
    return F.concat(F.lit("IS "), extract(text, SUPERSEDED))
