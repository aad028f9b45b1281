"""Line dedup over hashes: a line found in two documents stays only in the first of them.

1. Each text is cut at \\n; a line's key is the line stripped of ASCII white space with A-Z in lower
   case. Keys of at least MIN_POINTS code points become (hash of 128 bits, document, position).
2. The rows are range-partitioned and sorted by hash, document and position. A very common line
   may span several partitions: no hash has to fit into one task.
3. Each partition is streamed with constant memory: rows of a hash whose document isn't the hash's
   first are dropped. Where a hash goes on from the partition before, its first document isn't
   known yet, so rows of the partition's own first document are marked provisional; one boundary
   row for each partition settles them afterwards.
4. A document's dropped positions become a zlib-compressed bitmap of the lines it keeps. No text is
   shuffled for that; apply_bitmaps() cuts the texts.

Defined results: a null or empty text is one empty line, kept. Documents with equal doc_id count
as one document. A null doc_id sorts last. Repeated rows get equal results. Texts and lines of any length are
read whole. Extra columns go through with_bitmaps(), but none may be named keep.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEY, as_bytes, facts_of, materialise, row_key, stored

MIN_POINTS = 10
SPACE = b" \t\n\x0b\x0c\r"
DROPPED, PROVISIONAL, BOUNDARY = 0, 1, 2


def line_key(line: bytes, least: int = MIN_POINTS) -> bytes | None:
    """The key of a line, or None where it is too short to count."""
    key = line.strip(SPACE).lower()
    if len(key) < least or len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least:
        return None
    return key


def hashed_lines(docs: DataFrame, least: int = MIN_POINTS) -> DataFrame:
    """(h1, h2, document, position) of every line that counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, hashes = np.asarray(batch.column(0)), as_bytes(batch.column(1)), np.asarray(batch.column(2))
            digests, rows, at = [], [], []
            for r, text in enumerate(texts):
                for k, line in enumerate((text or b"").split(b"\n")):
                    if (key := line_key(line, least)) is not None:
                        digests.append(xxhash.xxh3_128_digest(key))
                        rows.append(r)
                        at.append(k)
            h = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            rows = np.asarray(rows, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (h[:, 0].copy(), h[:, 1].copy(), ids[rows], hashes[rows], np.asarray(at, np.int32))],
                ["h1", "h2", *KEY, "pos"],
            )

    keyed = docs.select(row_key()[KEY[0]].alias(KEY[0]), "text", row_key()[KEY[1]].alias(KEY[1]))
    return keyed.mapInArrow(run, f"h1 long, h2 long, {KEY[0]} long, {KEY[1]} long, pos int")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over sorted rows: what is dropped, what is provisional, and one boundary row at the end."""
    part = TaskContext.get().partitionId()
    current: tuple[int, int] | None = None  # the hash being read and its first document here
    owner = 0
    head: tuple[int, int, int] | None = None  # the partition's first hash and that hash's first document
    in_head = True
    for batch in batches:
        h1, h2, d, t, pos = (np.asarray(c) for c in batch.columns)
        n = len(h1)
        if not n:
            continue
        new = np.empty(n, bool)
        new[0] = (int(h1[0]), int(h2[0])) != current
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if head is None:
            head = (int(h1[0]), int(h2[0]), int(d[0]))
        group = np.cumsum(new)  # 0: goes on from the batch before
        first = np.r_[owner, d[new]][group]
        kind = np.where(d != first, DROPPED, -1)
        if in_head:
            own = (h1 == head[0]) & (h2 == head[1])
            kind[own & (kind < 0)] = PROVISIONAL
            in_head = bool(own.all())
        current, owner = (int(h1[-1]), int(h2[-1])), int(first[-1])
        out = kind >= 0
        if out.any():
            m = int(out.sum())
            yield _events(kind[out], d[out], t[out], pos[out], np.full(m, part), h1[out], h2[out], np.zeros(m))
    if head is not None:
        # document: first of the head's hash; hash: the head's; then the tail's hash and its first document
        yield _events([BOUNDARY], [head[2]], [owner], [0], [part], [head[0]], [head[1]], [0])
        yield _events([BOUNDARY], [owner], [owner], [1], [part], [current[0]], [current[1]], [0])


def _events(kind, d, t, pos, part, h1, h2, _unused) -> pa.RecordBatch:
    as64 = lambda x: pa.array(np.asarray(x, np.int64))
    as32 = lambda x: pa.array(np.asarray(x, np.int32))
    return pa.RecordBatch.from_arrays(
        [as32(kind), as64(d), as64(t), as32(pos), as32(part), as64(h1), as64(h2)], ["kind", *KEY, "pos", "part", "h1", "h2"]
    )


def settle(boundaries: list[tuple[int, int, int, int, int]]) -> dict[int, int]:
    """From (part, which, h1, h2, first document) rows: the true first document of the hash with
    which a partition begins, for the partitions whose first hash began in an earlier one."""
    ends = {}
    for part, which, h1, h2, d in boundaries:
        ends.setdefault(part, {})[which] = ((h1, h2), d)
    out: dict[int, int] = {}
    tail, owner = None, 0
    for part in sorted(ends):
        (head, d), (last, last_d) = ends[part][0], ends[part][1]
        if head == tail:
            out[part] = owner
            owner = owner if last == head else last_d
        else:
            owner = last_d
        tail = last
    return out


def dropped_lines(docs: DataFrame, least: int = MIN_POINTS) -> DataFrame:
    """(document, position) of every line to drop."""
    by = ["h1", "h2", *KEY, "pos"]
    lines = hashed_lines(docs, least).repartitionByRange(*by).sortWithinPartitions(*by)
    schema = f"kind int, {KEY[0]} long, {KEY[1]} long, pos int, part int, h1 long, h2 long"
    events = materialise(lines.mapInArrow(_stream, schema))
    # two rows for each shuffle partition, whatever the corpus' size
    ends = events.where(F.col("kind") == BOUNDARY).select("part", "pos", "h1", "h2", KEY[0]).collect()
    dropped = events.where(F.col("kind") == DROPPED).select(*KEY, "pos")
    late = settle([tuple(r) for r in ends])
    if late:
        spark = docs.sparkSession
        truth = spark.createDataFrame(list(late.items()), "part int, owner long")
        more = events.where(F.col("kind") == PROVISIONAL).join(F.broadcast(truth), "part")
        dropped = dropped.unionByName(more.where(F.col(KEY[0]) != F.col("owner")).select(*KEY, "pos"))
    return dropped


def bitmap(dropped: np.ndarray) -> bytes:
    """Bit k is 1 if line k stays; lines after the last byte stay."""
    bits = np.ones(8 * (int(dropped.max()) // 8 + 1), np.uint8)
    bits[dropped] = 0
    return zlib.compress(np.packbits(bits, bitorder="little").tobytes(), 6)


def keep_bitmaps(docs: DataFrame, least: int = MIN_POINTS) -> DataFrame:
    """(document, n_dropped, keep): the compressed bitmap of each document that loses lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [np.asarray(x, np.int64) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array([len(x) for x in at], pa.int64()), pa.array([bitmap(x) for x in at], pa.binary())],
                [*KEY, "n_dropped", "keep"],
            )

    # a set, so that repeated rows count once; it is no larger than its document
    own = dropped_lines(docs, least).groupBy(*KEY).agg(F.collect_set("pos").alias("at"))
    return own.mapInArrow(run, f"{KEY[0]} long, {KEY[1]} long, n_dropped long, keep binary")


def cut(text: bytes | None, keep: bytes | None) -> tuple[int, int, bytes]:
    """Lines before dropping, lines dropped, kept text."""
    lines = (text or b"").split(b"\n")
    if keep is None:
        return len(lines), 0, text or b""
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), bitorder="little")[: len(lines)]
    stays = np.ones(len(lines), bool)
    stays[: len(bits)] = bits
    kept = [x for x, s in zip(lines, stays, strict=True) if s]
    return len(lines), len(lines) - len(kept), b"\n".join(kept)


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with KEY and keep; keep is null where a document loses nothing. The texts of such aren't shuffled.
    The bitmaps are read twice, so they are kept as a table."""
    return facts_of(docs.withColumns(row_key()), stored(bitmaps.select(*KEY, "keep"), "bitmaps"), *KEY)
