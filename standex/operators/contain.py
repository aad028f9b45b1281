"""Containment join: which texts hold which patterns, as contains() says, without trying each pattern on each text.

Each pattern is filed under one window of Q bytes of its own, the one that is rarest in a few texts (a guide to speed
alone). The windows of a text are looked up once, all lengths Q that patterns need, and only patterns whose
window the text has are sought in it. UTF-8 never confuses the inside of a code point with its beginning, so bytes
hold a pattern where the characters do.

Patterns are counted before they are broadcast. More than BOUND bytes of them are dealt out by hash to blocks: each
block reads the texts once, its pairs are written, and its broadcast goes before the next begins.

Defined results: null texts and null patterns are in no pair; the empty pattern is held by every text; each row of
texts counts for itself, and equal patterns are one. Texts of any length are read whole, a piece at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Lengths of windows in bytes, the longest that a pattern has first.
Q = (8, 4, 2, 1)
#: Bytes of patterns that are broadcast at once.
BOUND = 64 << 20
#: Texts, and bytes of each, by which rare windows are told.
SAMPLE, SAMPLE_BYTES = 1_000, 1 << 14
#: Cells of the filter of windows, and bytes of a text that are looked up at once.
CELLS, PIECE = 20, 1 << 20
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _windows(data: np.ndarray, q: int) -> np.ndarray:
    """The windows of q bytes, as numbers."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    return np.ascontiguousarray(sliding_window_view(data, q)).view(f"<u{q}").ravel().astype(np.uint64)


def _cells(windows: np.ndarray) -> np.ndarray:
    return (windows * _MIX >> np.uint64(64 - CELLS)).astype(np.int64)


def _length(pattern: bytes) -> int:
    """The length of the pattern's windows; 0 for the empty one."""
    return next((q for q in Q if q <= len(pattern)), 0)


def _binary(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary()).to_pylist() if pa.types.is_large_string(column.type) else column.cast(pa.binary()).to_pylist()


def frequent(texts: DataFrame, body: str) -> np.ndarray:
    """How often the windows of each cell are in a few texts; one array of a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELLS, np.int64)
        for batch in batches:
            for text in _binary(batch.column(0)):
                data = np.frombuffer((text or b"")[:SAMPLE_BYTES], np.uint8)
                for q in Q:
                    total += np.bincount(_cells(_windows(data, q)), minlength=1 << CELLS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["cell", "n"])

    found = texts.select(body).limit(SAMPLE).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << CELLS, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out


class Patterns:
    """Patterns by the window that each is filed under."""

    def __init__(self, patterns: list[bytes], often: np.ndarray) -> None:
        self.empty = b"" in patterns
        self.filed: dict[int, dict[int, list[bytes]]] = {}
        for pattern in patterns:
            if q := _length(pattern):
                windows = _windows(np.frombuffer(pattern, np.uint8), q)
                rarest = int(windows[often[_cells(windows)].argmin()])
                self.filed.setdefault(q, {}).setdefault(rarest, []).append(pattern)
        self.cells = {}
        for q, of in self.filed.items():
            self.cells[q] = np.zeros(1 << CELLS, bool)
            self.cells[q][_cells(np.array(list(of), np.uint64))] = True

    def held(self, text: bytes) -> list[bytes]:
        found = [b""] if self.empty else []
        data = np.frombuffer(text, np.uint8)
        for q, of in self.filed.items():
            met: set[int] = set()
            for at in range(0, len(data), PIECE):
                windows = _windows(data[at : at + PIECE + q - 1], q)
                met.update(np.unique(windows[self.cells[q][_cells(windows)]]).tolist())
            found += [p for window in met for p in of.get(window, ()) if p in text]
        return found


def _pairs(texts: DataFrame, body: str, keep: list[str], shipped: Broadcast, pattern: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, text in enumerate(_binary(batch.column(0))):
                if text is not None:
                    held = shipped.value.held(text)
                    rows += [i] * len(held)
                    found += held
            kept = batch.select(range(1, batch.num_columns)).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(found, pa.binary()).cast(pa.string())], [*keep, pattern])

    kinds = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in keep)
    return texts.select(F.col(body).alias("_body"), *keep).mapInArrow(run, f"{kinds}, `{pattern}` string")


def holding(texts: DataFrame, body: str, keep: list[str], patterns: DataFrame, pattern: str, bound: int = BOUND) -> DataFrame:
    """The columns `keep` of each row of texts, with each pattern (a string column of patterns) that it holds."""
    spark = texts.sparkSession
    known = patterns.where(F.col(pattern).isNotNull()).select(pattern).distinct()
    size = known.agg(F.coalesce(F.sum(F.octet_length(pattern) + 100), F.lit(0)).alias("n")).first()["n"]
    often = frequent(texts, body)

    def ship(block: DataFrame) -> Broadcast:
        return spark.sparkContext.broadcast(Patterns([r.encode() for r in block.toArrow()[pattern].to_pylist()], often))

    if size <= bound:
        return _pairs(texts, body, keep, ship(known), pattern)
    blocks = int(-(-2 * size // bound))
    uri, dealt = shared_folder(spark, "holding"), _dealt(F.col(pattern), blocks)
    for k in range(blocks):
        shipped = ship(known.where(dealt == k))
        _pairs(texts, body, keep, shipped, pattern).write.mode("append").parquet(uri)
        shipped.destroy()
    return spark.read.parquet(uri)


def _dealt(pattern: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(pattern), F.lit(blocks))
