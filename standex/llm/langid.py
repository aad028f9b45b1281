"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the 1-, 2- and 3-grams of a text's letters and the marks on them (lower case; every run of
other characters is one space), hashed to BUCKETS. Training counts them per language over all labelled
rows: each partition adds up numpy counters and emits its non-zero cells, Spark sums those. The
log-probability matrix (languages x BUCKETS, float32) is a broadcast of a size that does not depend
on the corpus. Scoring adds, for a batch of texts, the matrix columns of their n-grams. More than
MAX_LANGUAGES labels are scored in blocks of that many: each block is a pass over the texts that
carries the best language and the sum of the likelihoods so far, and is checkpointed.

The n-grams of a text aren't independent, so the plain posterior is 0 or 1 for all but the shortest texts.
The score is the posterior of a text of at most EVIDENCE n-grams of the same mix, against the languages learned
and an unknown one in which all n-grams are equally likely: a text in two languages, or in none of those
learned, has a low score at any length. The language predicted is the likeliest of those learned.

Defined results: a text that is null or has no letter is ``und`` with score 0. So is everything
when no row is labelled. Ties go to the first language by code point. Texts of any length are read whole,
in pieces that share the n-grams across each cut. Repeated rows get equal results. Extra columns are not
read; columns named lang_pred and score must not be among those given.
"""

from __future__ import annotations

import itertools
import math
import unicodedata
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialise, stored

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
MAX_LANGUAGES = 400
SMOOTHING = 0.5
UNDETERMINED = "und"
#: N-grams that count in full towards the score.
EVIDENCE = 48
#: Of a text in an unknown language: the log-probability of an n-gram, and the prior's.
UNKNOWN, UNKNOWN_PRIOR = -math.log(BUCKETS), math.log(0.01)
#: Code points worked on at once; longer texts are taken in pieces of this size.
BLOCK = 1 << 17
#: Kinds of characters: neither, a mark (on a letter: vowel signs, tones, accents), a letter.
BREAK, MARK, LETTER = 0, 1, 2

_KINDS: np.ndarray | None = None


def _kind(c: str) -> int:
    return LETTER if c.isalpha() else MARK if unicodedata.category(c) in ("Mn", "Mc") else BREAK


def _kinds(points: np.ndarray) -> np.ndarray:
    global _KINDS
    if _KINDS is None:
        _KINDS = np.fromiter((_kind(chr(i)) for i in range(0x10000)), np.uint8, 0x10000)
    out = _KINDS[np.minimum(points, 0xFFFF)]
    for i in np.flatnonzero(points > 0xFFFF):
        out[i] = _kind(chr(points[i]))
    return out


def _blocks(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """Texts, in lower case, in blocks of at most BLOCK characters, with the index of each. A longer text
    is cut; its pieces are blocks of their own, in order."""
    at: list[int] = []
    block: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        low = text.lower() if text else ""
        if block and size + len(low) > BLOCK:
            yield at, block
            at, block, size = [], [], 0
        if len(low) > BLOCK:
            yield from (([i], [low[k : k + BLOCK]]) for k in range(0, len(low), BLOCK))
        elif low:
            at.append(i)
            block.append(low)
            size += len(low)
    if block:
        yield at, block


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index of the text, bucket) of every n-gram, and the indexes of texts with a letter, block by
    block, in the order of the texts."""
    last, tail, broken = -1, np.zeros(0, np.uint32), True  # what a cut text's next piece goes on from
    for at, block in _blocks(texts):
        points = np.frombuffer("".join(block).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.asarray(at, np.int64), [len(x) for x in block])
        kind = _kinds(points)
        goes_on = at[0] == last
        if not goes_on:
            tail, broken = tail[:0], True
        first = np.empty(len(points), bool)
        first[0] = True
        first[1:] = owner[1:] != owner[:-1]
        solid = kind != BREAK
        # a character that isn't solid stays as a space if the one before it is
        keep = solid.copy()
        keep[1:] |= solid[:-1] & ~first[1:]
        keep[0] |= goes_on and not broken
        points, owner, old = np.where(solid, points, np.uint32(32))[keep], owner[keep], len(tail)
        points, owner = np.concatenate([tail, points]), np.concatenate([np.full(old, at[0]), owner])
        rows, cells = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        h = np.zeros(len(points), np.uint32)
        for n in ORDERS:
            if n > len(points):
                break
            h = h[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] + np.uint32(n)
            new = max(old - n + 1, 0)  # n-grams that end in the tail are counted already
            whole = owner[new : len(h)] == owner[new + n - 1 :]
            mixed = (h[new:] ^ (h[new:] >> np.uint32(15))) * np.uint32(0x9E3779B1)
            rows.append(owner[new : len(h)][whole])
            cells.append((mixed >> np.uint32(16))[whole])
        last, tail, broken = at[-1], points[owner == at[-1]][1 - max(ORDERS) :], not solid[-1]
        lettered = np.unique(np.repeat(np.asarray(at, np.int64), [len(x) for x in block])[kind == LETTER])
        yield np.concatenate(rows), np.concatenate(cells).astype(np.int64), lettered


def train_counts(labelled: DataFrame) -> DataFrame:
    """(lang, bucket, n) over a frame of (text, lang)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            texts = batch.column(0).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                total = totals.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                total[BUCKETS] += len(own)  # the last cell counts documents
                for _, cells, _ in features(own):
                    total[:BUCKETS] += np.bincount(cells, minlength=BUCKETS)
        for lang, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                ["lang", "bucket", "n"],
            )

    counts = labelled.select("text", "lang").mapInArrow(count, "lang string, bucket int, n long")
    return counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """langs, in code-point order, and the matrix buckets x languages; priors apart."""

    def __init__(self, langs: list[str], matrix: np.ndarray, prior: np.ndarray, rest: Iterable[Model] = ()):
        """rest: the models of the languages after langs, made as they are asked for."""
        self.langs, self.matrix, self.prior, self.rest = langs, matrix, prior, rest

    @staticmethod
    def fit(labelled: DataFrame) -> Model:
        """Learns from all rows of (text, lang) whose lang isn't null."""
        # At most MAX_LANGUAGES x (BUCKETS + 1) cells come to the driver at once, whatever the corpus' size.
        counts = train_counts(labelled.where(F.col("lang").isNotNull()))
        rows = _cells(counts).limit(MAX_LANGUAGES + 1).toArrow()
        if rows.num_rows <= MAX_LANGUAGES:
            return Model.of_cells(rows, None)
        del rows
        counts = stored(counts, "languages")
        sizes = counts.where(F.col("bucket") == BUCKETS).select("lang", "n").toArrow().to_pydict()
        langs, total = sorted(sizes["lang"], key=str.encode), sum(sizes["n"])

        def block(k: int) -> Model:
            own = F.col("lang").between(langs[k], langs[min(k + MAX_LANGUAGES, len(langs)) - 1])  # in the order of UTF-8 as well
            return Model.of_cells(_cells(counts.where(own)).toArrow(), total)

        first = block(0)
        first.rest = _Blocks(block, range(MAX_LANGUAGES, len(langs), MAX_LANGUAGES))
        return first

    @staticmethod
    def of_cells(rows: pa.Table, total: int | None) -> Model:
        """Of the cells (lang, b, n) of some languages, a row and two lists each, which go from Arrow to the matrix one
        language at a time; total: the labelled documents of all, if these aren't all."""
        langs = rows["lang"].to_pylist()
        order = sorted(range(len(langs)), key=lambda i: langs[i].encode())
        matrix, count = np.zeros((BUCKETS, len(langs)), np.float32), np.zeros(len(langs))
        for k, i in enumerate(order):
            own = np.zeros(BUCKETS + 1)
            own[rows["b"][i].values.to_numpy(zero_copy_only=False)] = rows["n"][i].values.to_numpy(zero_copy_only=False)
            seen = own[:BUCKETS] + SMOOTHING
            matrix[:, k], count[k] = np.log(seen / seen.sum()), own[BUCKETS]
        return Model([langs[i] for i in order], matrix, np.log(count / (total or count.sum())) if langs else count)

    @staticmethod
    def of_any() -> Model:
        """Tells apart only texts with a letter (language "", score 1) and others."""
        return Model([""], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihoods, texts x languages; of each text its n-grams and whether it has a letter."""
        sums = np.zeros((len(texts), len(self.langs)))
        grams = np.zeros(len(texts), np.int64)
        found = np.zeros(len(texts), bool)
        for rows, cells, lettered in features(texts):
            found[lettered] = True
            if not len(rows):
                continue
            # the n-grams of a text, bucket by bucket: a sparse row of counts
            code, n = np.unique(rows * BUCKETS + cells, return_counts=True)
            row, cell = code // BUCKETS, code % BUCKETS
            start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            for k in range(len(self.langs)):
                sums[row[start], k] += np.add.reduceat(self.matrix[cell, k].astype(float) * n, start)
            grams[row[start]] += np.add.reduceat(n, start)
        return sums + self.prior, grams, found

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        if not self.langs:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        sums, grams, found = self.sums(texts)
        best, most, weight = sums.argmax(axis=1), sums.max(axis=1), EVIDENCE / np.maximum(grams, EVIDENCE)
        with np.errstate(over="ignore"):
            unknown = np.exp((UNKNOWN_PRIOR + UNKNOWN * grams - most) * weight)
        share = 1 / (np.exp((sums - most[:, None]) * weight[:, None]).sum(axis=1) + unknown)
        return [self.langs[b] if f else UNDETERMINED for b, f in zip(best, found, strict=True)], np.where(found, share, 0.0)


class _Blocks:
    """Models made as they are iterated over, any number of times."""

    def __init__(self, make: Callable[[int], Model], starts: range):
        self.make, self.starts = make, starts

    def __iter__(self) -> Iterator[Model]:
        return map(self.make, self.starts)

    def __len__(self) -> int:
        return len(self.starts)


def _cells(counts: DataFrame) -> DataFrame:
    return counts.groupBy("lang").agg(F.collect_list("bucket").alias("b"), F.collect_list("n").alias("n"))


#: Carried from block to block: the best language, its log-likelihood, all weighted likelihoods' sum over that one, n-grams, any letter.
_STATE = {"_sx_best": "string", "_sx_top": "double", "_sx_sum": "double", "_sx_grams": "long", "_sx_any": "boolean"}


def _in_blocks(docs: DataFrame, model: Model, at: int) -> DataFrame:
    names = docs.columns
    schema = T.StructType([*docs.schema.fields, *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in _STATE.items())).fields])
    start = {"_sx_best": F.lit(None), "_sx_top": F.lit(float("-inf")), "_sx_sum": F.lit(0.0), "_sx_grams": F.lit(0), "_sx_any": F.lit(False)}
    state = docs.withColumns({k: v.cast(_STATE[k]) for k, v in start.items()})
    for block in itertools.chain([model], model.rest):
        shipped = docs.sparkSession.sparkContext.broadcast((block.langs, block.matrix, block.prior))

        def further(batches: Iterator[pa.RecordBatch], shipped: Broadcast = shipped) -> Iterator[pa.RecordBatch]:
            own = Model(*shipped.value)
            for batch in batches:
                if not batch.num_rows:
                    continue
                before, top, total = batch.column(len(names)).to_pylist(), *(batch.column(len(names) + k).to_numpy() for k in (1, 2))
                sums, grams, found = own.sums(batch.column(at).to_pylist())
                weight = EVIDENCE / np.maximum(grams, EVIDENCE)
                best, most = sums.argmax(axis=1), np.maximum(top, sums.max(axis=1))
                langs = [own.langs[b] if new else x for b, new, x in zip(best, sums.max(axis=1) > top, before, strict=True)]
                total = total * np.exp((top - most) * weight) + np.exp((sums - most[:, None]) * weight[:, None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[: len(names)], pa.array(langs, pa.string()), pa.array(most), pa.array(total), pa.array(grams), pa.array(found)], schema.names
                )

        state = materialise(state.mapInArrow(further, schema))
        shipped.unpersist()
    found, grams = F.col("_sx_any"), F.col("_sx_grams")
    unknown = F.exp((UNKNOWN_PRIOR + UNKNOWN * grams - F.col("_sx_top")) * EVIDENCE / F.greatest(grams, F.lit(EVIDENCE)))
    score = 1 / (F.col("_sx_sum") + unknown)
    return state.select(*names, F.when(found, F.col("_sx_best")).otherwise(UNDETERMINED).alias("lang_pred"), F.when(found, score).otherwise(0.0).alias("score"))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred and score after its columns (which must not hold those names). Only the texts go
    to Python; the other columns wait in the JVM."""
    if model.rest:
        return _in_blocks(docs, model, docs.columns.index(text))
    shipped = docs.sparkSession.sparkContext.broadcast((model.langs, model.matrix, model.prior))

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(*shipped.value)
        for batch in batches:
            langs, scores = own.score(batch.to_pylist())
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    found = docs.withColumn("_sx_found", predict(F.col(text)))
    return found.select(*docs.columns, F.col("_sx_found.lang_pred").alias("lang_pred"), F.col("_sx_found.score").alias("score"))


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, mod 5, is 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 5 == 0


def fit_on_documents(docs: DataFrame) -> Model:
    return Model.fit(docs.where(~held_out() & F.col("lang").isNotNull()).select("text", "lang"))
