"""SimHash near-duplicates: fingerprints, pigeonhole blocks, verified links, classes.

fingerprints(): 64 bits by majority over the XXH64 (seed 42) of a text's 4-word shingles, in numpy
per Arrow batch; texts of any length are taken 65,536 shingles at a time.

links(): with at most D differing bits, fingerprints cut into K blocks agree in at least K - D of
them, so each fingerprint is filed under every choice of K - D blocks. Equal keys meet in one
sorted run; inside a run, Hamming distances are verified. All pairs of a run are never emitted:
a run yields a spanning forest of its links, which has the same classes. K grows with the number
of fingerprints so that runs of unrelated ones stay short; any K gives the same classes. Runs of
more than RUN fingerprints are dealt out again as pairs of chunks, exactly and in bounded memory.

Exact copies share a fingerprint and are one node, so a group of copies costs one row here.

similar_classes(): near duplicates of a similarity. Where five-word shingles are 0.8 alike, fingerprints
of them differ in ten bits of 64, too many for blocks; those of the distinct words in four. So each text
gets VIEWS fingerprints of its distinct words, under different hashes, and texts within D bits in any of
these meet in a block as above. Only those that have such a neighbour get a wide fingerprint too (1,024 bits
of their distinct shingles) and are filed again with it: they are linked if it differs in at most WIDE bits.

Defined results: no words (null, empty) is fingerprint 0, linked like any other; in similar_classes()
such texts are one class of their own. Texts of any length are hashed whole. A null doc_id takes part but
is never a class's name unless the class has no other (then null). Repeated rows share a class.
The columns that are added must not be in the frame given.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT, KEY, as_bytes, materialise, split_join, widened
from .graph import components

DISTANCE = 4
SHINGLE = 4
SEED = 42
#: Words of a shingle of similar_classes(), its fingerprints of distinct words, and the longs of a wide one.
WORDS, VIEWS, LONGS = 5, 4, 16
#: Bits of the wide fingerprint that may differ. At a similarity of 0.8 the mean is 1,024 x acos(2 x 0.8 / 1.8) / pi
#: = 155 with a deviation of 11.5; one deviation more takes five of six such pairs.
WIDE = 167
#: Digests that are unpacked at once.
PIECE = 1 << 14
#: Fingerprints of one key that a single task compares; larger runs are split into pairs of chunks.
RUN = 20_000


def fingerprint(text: bytes | None) -> int:
    words = text.lower().split() if text else []  # bytes: A-Z only, and \x20 \x09-\x0D
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = max(1, len(words) - SHINGLE + 1)
    ends = ends[min(SHINGLE, len(words)) - 1 :]
    votes = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, n, 1 << 16):
        pairs = zip(starts[k : k + (1 << 16)].tolist(), ends[k : k + (1 << 16)].tolist(), strict=False)
        h = np.array([digest(joined[a:b], SEED) for a, b in pairs], np.dtype("<u8"))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.dtype("<u8"))[0])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column fp (64 bits in a long) instead of its text."""
    names = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in as_bytes(batch.column(len(names)))], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fps.view(np.int64))], [*names, "fp"])

    kept = docs.select(*names, text)
    schema = widened(docs.select(*names).schema, ("fp", T.LongType()))
    return kept.mapInArrow(run, schema)


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def near(rows: np.ndarray, row: np.ndarray, distance: int, wide: int | None) -> np.ndarray:
    """Which rows are linked to the other(s): column 0 is a fingerprint, the rest the wide one, if any."""
    found = popcount(rows[:, 0] ^ row[..., 0]) <= distance
    if wide is not None and found.any():
        other = row[found] if row.ndim == 2 else row
        found[found] = popcount(rows[found, 1:] ^ other[..., 1:]).sum(axis=1, dtype=np.int64) <= wide
    return found


def forest(rows: np.ndarray, names: np.ndarray, distance: int, wide: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b), by name, that join what the links between rows join. Each found member is
    compared only with those not yet reached, so a dense group costs about one pass."""
    out_a, out_b = [], []
    while len(rows) > 1:
        frontier, rows, names = [(rows[0], names[0])], rows[1:], names[1:]
        while frontier and len(rows):
            x, name = frontier.pop()
            found = near(rows, x, distance, wide)
            if found.any():
                out_a.append(np.full(int(found.sum()), name, np.uint64))
                out_b.append(names[found])
                frontier.extend(zip(rows[found], names[found], strict=True))
                rows, names = rows[~found], names[~found]
    if not out_a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate(out_a), np.concatenate(out_b)


def _array(column: pa.Array) -> np.ndarray:
    """A column of longs, or of wide fingerprints as rows of longs."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(-1, LONGS)
    return np.asarray(column)


def _runs(distance: int, wide: int | None = None):
    """Over rows sorted by key: verified links of each run of equal keys. Pairs are vectorised. A row is
    its key and a fingerprint, which is also its name; with wide: that, the wide one, and a name."""
    tail = 1 if wide is None else 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(columns: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
            n = len(columns[0])
            if n < 2:
                return
            values = [c.view(np.uint64) for c in columns[-tail:]]
            rows, names = np.column_stack(values[:2]) if wide is not None else values[0][:, None], values[-1]
            new = np.zeros(n, bool)
            new[0] = True
            for k in columns[:-tail]:
                new[1:] |= k[1:] != k[:-1]
            start = np.flatnonzero(new)
            size = np.diff(np.r_[start, n])
            two = start[size == 2]
            two = two[near(rows[two], rows[two + 1], distance, wide)]
            a, b = [names[two]], [names[two + 1]]
            for s, k in zip(start[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                own, at = np.unique(names[s : s + k], return_index=True)
                x, y = forest(rows[s : s + k][at], own, distance, wide)
                a.append(x)
                b.append(y)
            u, v = np.concatenate(a), np.concatenate(b)
            differ = u != v
            if differ.any():
                yield pa.RecordBatch.from_arrays([pa.array(u[differ].view(np.int64)), pa.array(v[differ].view(np.int64))], ["src", "dst"])

        held: tuple[np.ndarray, ...] | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = tuple(_array(c) for c in batch.columns)
            if held is not None:
                columns = tuple(np.concatenate(x) for x in zip(held, columns, strict=True))
            n = len(columns[0])
            last = np.ones(n, bool)  # the rows of the last key wait for the next batch
            for k in columns[:-tail]:
                last &= k == k[-1]
            cut = n - int(last[::-1].argmin()) if not last.all() else 0
            yield from links(tuple(c[:cut] for c in columns))
            held = tuple(c[cut:] for c in columns)
        if held is not None:
            yield from links(held)

    return run


def blocks_for(n: int, distance: int = DISTANCE) -> int:
    """Blocks such that a key of unrelated fingerprints holds few of them on average."""
    k = distance + 2
    while k < distance + 7 and n > 2 * 2 ** (64 * (k - distance) // k):
        k += 1
    return k


def keys(fp: Column, blocks: int, distance: int = DISTANCE) -> Column:
    """The keys of a fingerprint: each choice of blocks, masked, with the choice's number mixed in."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - distance):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        masks.append(mask - (1 << 64) if mask >= 1 << 63 else mask)
    return F.array(*[F.struct(F.lit(i).alias("choice"), fp.bitwiseAND(F.lit(m)).alias("block")) for i, m in enumerate(masks)])


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int | None = None, run: int = RUN) -> DataFrame:
    """Verified links (src, dst) between the distinct fingerprints of column fp."""
    blocks = blocks or blocks_for(distinct.count(), distance)
    filed = distinct.select(F.explode(keys(F.col("fp"), blocks, distance)).alias("k"), "fp").select("k.choice", "k.block", "fp")
    return _filed_links(filed, _runs(distance), run)


def _filed_links(filed: DataFrame, compare, run: int = RUN) -> DataFrame:
    """Links inside the runs of equal (choice, block); what follows these two columns is compared."""
    rest = filed.columns[2:]
    large = filed.groupBy("choice", "block").agg(F.count("*").alias("n")).where(F.col("n") > run)
    large = materialise(large.withColumn("parts", F.ceil(F.col("n") / run).cast("int")))
    schema = "src long, dst long"
    if large.isEmpty():
        ordinary = filed
    else:
        ordinary = filed.join(large, ["choice", "block"], "left_anti")
    out = ordinary.repartition("choice", "block").sortWithinPartitions("choice", "block").mapInArrow(compare, schema)
    if not large.isEmpty():
        # chunk pairs (i, j): each row of a large run goes to every pair that holds its chunk
        part = F.pmod(F.xxhash64(rest[-1]), F.col("parts")).cast("int")
        pairs = filed.join(large, ["choice", "block"]).withColumn("own", part)
        other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
        pairs = pairs.withColumn("other", other).select(
            "choice", "block", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *rest
        )
        by = ["choice", "block", "i", "j"]
        out = out.unionByName(pairs.repartition(*by).sortWithinPartitions(*by).mapInArrow(compare, schema))
    return out


def classes(docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(docs without text, fp, class, component_id): component_id is the smallest doc_id reachable,
    class the smallest fingerprint."""
    marked = materialise(fingerprints(docs))
    # one row a fingerprint, with the smallest id that has it: copies are counted before any shuffle
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    joined = components(links(nodes.select("fp"), distance))
    named = nodes.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("class", F.coalesce("component", "fp"))
    least = named.groupBy("class").agg(F.min("least").alias("component_id"))
    names = split_join(named, least, "class", HOT).select("fp", "class", "component_id")
    return marked.join(names, "fp")


def _majority(digests: np.ndarray) -> bytes:
    """The bits set in over half of the rows (of longs)."""
    rows = digests.view(np.uint8)
    votes = np.zeros(8 * rows.shape[1], np.int64)
    for k in range(0, len(rows), PIECE):
        votes += np.unpackbits(rows[k : k + PIECE], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * votes > len(rows), bitorder="little").tobytes()


def _mixed(h: np.ndarray, n: int) -> np.ndarray:
    """n hashes of each hash, by splitmix64."""
    z = h[:, None] + np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _hashes(parts: Iterable) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(x, SEED) for x in parts), np.uint64)


def views(text: bytes | None) -> tuple[int, ...]:
    """A hash of the words in order, and VIEWS fingerprints of the distinct ones."""
    words = text.lower().split() if text else []
    if not words:
        return (0,) * (VIEWS + 1)
    found = _majority(_mixed(_hashes(set(words)), VIEWS))
    return (xxhash.xxh3_64_intdigest(b" ".join(words), SEED), *np.frombuffer(found, np.uint64).tolist())


def wide_fingerprint(text: bytes | None) -> bytes:
    """LONGS x 64 bits of the distinct shingles of WORDS words."""
    words = text.lower().split() if text else []
    if not words:
        return bytes(8 * LONGS)
    joined = memoryview(b" ".join(words))
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    ends = ends[min(WORDS, len(words)) - 1 :]
    return _majority(_mixed(np.unique(_hashes(joined[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=False))), LONGS))


VIEW = [f"_sx_v{i}" for i in range(VIEWS)]


def with_views(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with node (the hash of its words) and the columns VIEW instead of its text."""
    names = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([views(t) for t in as_bytes(batch.column(len(names)))], np.uint64).reshape(-1, VIEWS + 1).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c.copy()) for c in found.T]], [*names, "node", *VIEW])

    schema = widened(docs.select(*names).schema, *[(c, T.LongType()) for c in ("node", *VIEW)])
    return docs.select(*names, text).mapInArrow(run, schema)


def with_wide(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with wide instead of its text."""
    names = [c for c in docs.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [wide_fingerprint(t) for t in as_bytes(batch.column(len(names)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.binary())], [*names, "wide"])

    return docs.select(*names, text).mapInArrow(run, widened(docs.select(*names).schema, ("wide", T.BinaryType())))


def neighbours(nodes: DataFrame, distance: int, blocks: int, run: int = RUN) -> DataFrame:
    """Those of the rows (node, VIEW) that have another within `distance` bits in any view."""
    asked = []
    for name in VIEW:
        values = materialise(nodes.groupBy(F.col(name).alias("fp")).agg(F.count("*").alias("n")))
        found = links(values.select("fp"), distance, blocks, run)
        both = found.select(F.explode(F.array("src", "dst")).alias("fp")).unionByName(values.where("n > 1").select("fp"))
        asked.append(nodes.join(both.distinct(), F.col(name) == F.col("fp"), "left_semi").select("node"))
    return nodes.join(reduce(DataFrame.unionByName, asked).distinct(), "node", "left_semi")


def similar_links(nodes: DataFrame, distance: int = DISTANCE, wide: int = WIDE, blocks: int = DISTANCE + 2, run: int = RUN) -> DataFrame:
    """Verified links (src, dst) between rows (node, VIEW, wide). The choices of different views don't meet."""
    filed = []
    for i, name in enumerate(VIEW):
        each = nodes.select(F.explode(keys(F.col(name), blocks, distance)).alias("k"), F.col(name).alias("fp"), "wide", "node")
        filed.append(each.select((F.col("k.choice") + i * 1000).alias("choice"), "k.block", "fp", "wide", "node"))
    return _filed_links(reduce(DataFrame.unionByName, filed), _runs(distance, wide), run)


def similar_classes(docs: DataFrame, distance: int = DISTANCE, wide: int = WIDE) -> DataFrame:
    """(docs without text, class) of a frame with the columns KEY and text: rows of one class are joined by
    links of similar texts. The text is read once for all rows, and again for those with a neighbour."""
    names = [c for c in docs.columns if c != "text"]
    marked = materialise(with_views(docs))
    # texts of the same words are one node, and the first of them speaks for all
    nodes = materialise(marked.groupBy("node").agg(F.min(F.struct(*KEY)).alias("k"), *[F.first(c).alias(c) for c in VIEW]))
    blocks = blocks_for(nodes.count(), distance)
    some = materialise(neighbours(nodes, distance, blocks).select("node", *[F.col(f"k.{c}").alias(c) for c in KEY], *VIEW))
    # rows repeated with the same id and text have one wide fingerprint
    read = with_wide(docs.select(*KEY, "text").join(some.select(*KEY), list(KEY), "left_semi")).dropDuplicates(list(KEY))
    known = materialise(some.join(read, list(KEY)).select("node", *VIEW, "wide"))
    joined = components(similar_links(known, distance, wide, blocks))
    # nodes without links, by far the most, are classes of their own
    of = joined.select("node", F.col("component").alias("class"))
    return marked.select(*names, "node").join(of, "node", "left").select(*names, F.coalesce("class", "node").alias("class"))
