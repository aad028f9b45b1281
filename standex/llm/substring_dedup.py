"""Substring dedup by hashing lines, sentence by sentence, or paragraphs.

A text's units are the sentences of its lines (or, with paragraphs, the blocks between empty lines), so that a
passage pasted into the middle of a paragraph is found as well as one that is a paragraph. A unit is
normalised (lower case, white space collapsed) and hashed to 128 bits. Digests are grouped over all
documents; the occurrence that ranks first (least document id, then position) is original, all others
are repeats. A run of repeats without another unit between them is removed if it has RUN_WORDS words or more,
and its offsets in the original text (code points) are returned: so passages go, and what is short and common
(a greeting, a license line) stays where it stands alone.

The texts are hashed once, into a table. The group keeps one number a digest, added up before the shuffle;
the units are then held against a bitmap of the digests that repeat, and only those left are shuffled to
meet them. A very common line is thus no hot key in the aggregation, and AQE may split it in the join.

Known loss: of a passage pasted between other words, the first and last sentence, fused with these, stay.

Defined results: null and empty texts have no units. Documents with equal ids count as one document for what is
original, though a unit that its own text had before is a repeat; a null id ranks last. Repeated rows get equal
results. Texts of any length are hashed whole. Columns named n_removed, spans and n_chars_removed must not be
among those given.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import KEY, facts_of, only_of, row_key, stored, widened

#: Words of the shortest run of repeats that is removed.
RUN_WORDS = 20
_LINE = re.compile(r"[^\n]+")
_SENTENCE = re.compile(r"[^.!?\n]*[.!?]+[\"')\]]*\s*|[^.!?\n]+")
_PARAGRAPH = re.compile(r"(?:[^\n]+\n?)+")


def units(text: str, paragraphs: bool = False) -> Iterator[tuple[bytes, int, int, int]]:
    """(digest, start, end, words) of each unit with a word, in order."""
    if paragraphs:
        spans = (m.span() for m in _PARAGRAPH.finditer(text))
    else:
        spans = (m.span() for line in _LINE.finditer(text) for m in _SENTENCE.finditer(text, *line.span()))
    for start, end in spans:
        if words := text[start:end].split():
            yield xxhash.xxh3_128_digest(" ".join(words).lower().encode("utf-8", "replace")), start, end, len(words)


def hashed_units(docs: DataFrame, paragraphs: bool = False) -> DataFrame:
    """(h1, h2, KEY, at, start, end, words, again) of every unit: at counts a text's units; again: it occurred
    before in its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, rows, numbers, again = [], [], [], []
            for r, text in enumerate(batch.column(1).to_pylist()):
                seen = set()
                for k, (digest, a, b, n) in enumerate(units(text, paragraphs) if text else []):
                    digests.append(digest)
                    rows.append(r)
                    numbers.append((k, a, b, n))
                    again.append(digest in seen)
                    seen.add(digest)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            at, own = np.asarray(rows, np.int64), np.asarray(numbers, np.int32).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0].copy()), pa.array(h[:, 1].copy()), pa.array(np.asarray(batch.column(0))[at]), pa.array(np.asarray(batch.column(2))[at]),
                 *[pa.array(c.copy()) for c in own.T], pa.array(again, pa.bool_())],
                ["h1", "h2", *KEY, "at", "start", "end", "words", "again"],
            )

    own = row_key()
    keyed = docs.select(own[KEY[0]].alias(KEY[0]), "text", own[KEY[1]].alias(KEY[1]))
    return keyed.mapInArrow(run, f"h1 long, h2 long, {KEY[0]} long, {KEY[1]} long, at int, start int, end int, words int, again boolean")


def repeats(docs: DataFrame, paragraphs: bool = False) -> DataFrame:
    """(KEY, at, start, end, words) of every unit that isn't the first of its kind."""
    every = stored(hashed_units(docs, paragraphs), "units")
    own = [*KEY, "at", "start", "end", "words"]
    firsts = every.groupBy("h1", "h2").agg(F.min(KEY[0]).alias("first"), F.max(KEY[0]).alias("last")).where("first < last")
    firsts = stored(firsts.select("h1", "h2", "first"), "firsts")
    later = only_of(every.where(~F.col("again")), firsts, "h1", "h2").join(firsts, ["h1", "h2"]).where(F.col(KEY[0]) > F.col("first"))
    return every.where("again").select(*own).unionByName(later.select(*own))


def runs(found: list[dict], least: int = RUN_WORDS) -> list[tuple[int, int, int]]:
    """(start, end, units) of the runs of repeats (at, start, end, words) that have enough words."""
    out: list[tuple[int, int, int]] = []
    open_run: list[int] = []  # the place of the next unit, start, end, units, words
    for at, start, end, words in [*sorted({(x["at"], x["start"], x["end"], x["words"]) for x in found}), (-1, 0, 0, 0)]:
        if open_run and open_run[0] == at:
            open_run = [at + 1, open_run[1], end, open_run[3] + 1, open_run[4] + words]
            continue
        if open_run and open_run[4] >= least:
            out.append((open_run[1], open_run[2], open_run[3]))
        open_run = [at + 1, start, end, 1, words]
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; of a line that goes whole, so does its end."""
    parts, at = [], 0
    for a, b in spans:
        parts.append(text[at:a])
        at = b
        if (a == 0 or text[a - 1] == "\n") and text[b : b + 1] == "\n":
            at = b + 1
    parts.append(text[at:])
    return "".join(parts)


def dedup(docs: DataFrame, paragraphs: bool = False, least: int = RUN_WORDS) -> DataFrame:
    """docs with its text replaced by what stays, with n_removed (units), spans (of the original
    text) and n_chars_removed."""
    names = [c for c in docs.columns if c != "text"]
    # the repeats of a document: no more than it has units
    found = repeats(docs, paragraphs).groupBy(*KEY).agg(F.collect_list(F.struct("at", "start", "end", "words")).alias("_sx_found"))
    found = stored(found.where(_enough(least)), "found")
    joined = facts_of(docs.withColumns(row_key()), found, *KEY).select(*names, "text", "_sx_found")
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n, out, chars = [], [], [], []
            for text, repeated in zip(batch.column(len(names)).to_pylist(), batch.column(len(names) + 1).to_pylist(), strict=True):
                own = runs(repeated or [], least)
                kept.append(without(text, [(a, b) for a, b, _ in own]) if own else text)
                n.append(sum(k for _, _, k in own))
                out.append([{"start": a, "end": b} for a, b, _ in own])
                chars.append(sum(b - a for a, b, _ in own))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(kept, pa.string()), pa.array(n, pa.int64()), pa.array(out, kind), pa.array(chars, pa.int64())],
                [*names, "text", "n_removed", "spans", "n_chars_removed"],
            )

    span = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    schema = widened(
        docs.select(*names).schema, ("text", T.StringType()), ("n_removed", T.LongType()), ("spans", span), ("n_chars_removed", T.LongType())
    )
    return joined.mapInArrow(run, schema)


def _enough(least: int) -> Column:
    """Whether all repeats of a document together have enough words; where not, none of their runs has."""
    return F.aggregate("_sx_found", F.lit(0).cast("long"), lambda acc, x: acc + x["words"]) >= least
