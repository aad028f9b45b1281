"""Interleaved document sequences: ordered text and media with payloads resolved by digest.

sequences(): an HTML document becomes an array of structs (position, kind, text, media, caption), in page
order; kind is text or media, media is the reference's digest (or its address), and the caption
is the figure's, else the image's alt. resolve(): the digests that a document refers to, each once, meet the
store, and what it knows of them returns to the structs' places; texts don't travel. A digest that more than
HOT documents refer to is split: its facts are repeated, and the documents dealt out among them. A reference
without a payload stays, unresolved, or is an error if so asked.

The store holds each payload as a lossless 8-bit greyscale PNG of WIDTH columns; store_media()
writes it to the shared folder and read_media() reads the stored bytes back, checks them and
computes the payload's digests and features. Only those go on: no payload is shuffled.

Features: rows x columns, a 64-bit average hash (segment means against their mean), mean and
entropy of the samples.

document_media() makes an HTML document of each text: its first line, a figure of the whole text (the caption
says how many lines that has), its last line, and the figure's image once more.

Defined results: a null or empty text is one block of padding. Equal texts give equal values.
Texts of any length are one image. Repeated rows are resolved alike; a store is unique by digest. Extra columns
aren't read by document_media() and stay in sequences() and resolve().
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT, KEY, as_bytes, row_key, shared_folder, split_join, stored, widened
from .html import BLOCK, Node, parse

UNIT = 576
FILL = 255
WIDTH = 24
TAIL = 32
LEVEL = 6
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
MEDIA_TAGS = frozenset(["img", "audio", "video", "source", "embed"])
_SKIPPED = frozenset(["head", "script", "style", "template", "noscript"])

ITEM = "struct<position:int,kind:string,text:string,media:string,caption:string>"


def payload_of(text: bytes | None) -> bytes:
    text = text or b""
    units = max(1, -(-len(text) // UNIT))
    return text + bytes([FILL]) * (units * UNIT - len(text))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode(payload: bytes, width: int = WIDTH) -> bytes:
    """The payload as an 8-bit greyscale PNG; its length is a multiple of the width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def decode(media: bytes) -> tuple[bytes, int, int]:
    """(payload, rows, columns); raises ValueError where the file isn't whole."""
    if media[:8] != _SIGNATURE:
        raise ValueError("not a PNG")
    at, width, height, data = 8, 0, 0, []
    while at < len(media):
        (n,), kind = struct.unpack(">I", media[at : at + 4]), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack(">I", media[at + 8 + n : at + 12 + n])[0]:
            raise ValueError("bad checksum")
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("unexpected filter")
    return lines[:, 1:].tobytes(), height, width


def feature(payload: bytes, rows: int, columns: int) -> str:
    x = np.frombuffer(payload, np.uint8)
    edges = np.linspace(0, len(x), 65).astype(np.int64)[:-1]
    sums = np.add.reduceat(x, edges, dtype=np.int64)
    sizes = np.diff(np.r_[edges, len(x)])
    above = sums * len(x) > int(x.sum(dtype=np.int64)) * sizes
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    bits = int("".join("1" if b else "0" for b in above), 2)
    return f"{rows}x{columns}:{bits:016x}:{x.mean():.4f}:{abs(float(-(share * np.log2(share)).sum())):.4f}"


def store_media(texts: DataFrame, uri: str, text: str = "text") -> None:
    """Writes the media of every text to a table at uri, as (media binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # one file a text; equal neighbours are encoded once
            last: tuple[bytes | None, bytes] | None = None
            out = []
            for t in as_bytes(batch.column(0)):
                if last is None or last[0] != t:
                    last = (t, encode(payload_of(t)))
                out.append(last[1])
                if len(out) == 256:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["media"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["media"])

    texts.select(text).mapInArrow(run, "media binary").write.option("compression", "uncompressed").parquet(uri)


FACTS = [
    ("payload_sha256", T.StringType()), ("payload_bytes", T.LongType()), ("tail_crc32", T.LongType()),
    ("media_bytes", T.LongType()), ("media_sha256", T.StringType()), ("feature", T.StringType()),
]


def read_media(stored: DataFrame) -> DataFrame:
    """One row for each payload of the stored media, read back: FACTS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column(0).to_pylist():
                payload, height, width = decode(media)
                rows.append(
                    (hashlib.sha256(payload).hexdigest(), len(payload), zlib.crc32(payload[-TAIL:]), len(media),
                     hashlib.sha256(media).hexdigest(), feature(payload, height, width))
                )
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(FACTS)
            kinds = [pa.int64() if isinstance(k, T.LongType) else pa.string() for _, k in FACTS]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [n for n, _ in FACTS])

    facts = stored.select("media").mapInArrow(run, widened(T.StructType([]), *FACTS))
    # equal payloads have equal facts: any of them will do, and copies meet before the shuffle
    return facts.groupBy("payload_sha256").agg(*[F.first(n).alias(n) for n, _ in FACTS[1:]])


def digest(text: Column) -> Column:
    """The SHA-256 of a text's payload, as the reference in a document names it."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    n = F.octet_length(data)
    pad = F.when(n == 0, F.lit(UNIT)).otherwise(F.pmod(-n, F.lit(UNIT)))
    return F.sha2(F.concat(data, F.unhex(F.repeat(F.lit(f"{FILL:02X}"), pad))), 256)


def items_of(html: str | None) -> list[dict]:
    """The document's sequence: text between media, and media with their captions, in page order."""
    out: list[dict] = []
    text: list[str] = []

    def flush() -> None:
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            out.append({"position": len(out), "kind": "text", "text": joined, "media": None, "caption": None})

    stack: list[Node | str] = [parse(html or "")]
    captions: dict[int, str] = {}
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            text.append(x)
            continue
        if x.tag in _SKIPPED:
            continue
        if x.tag == "figure":
            own = [n for n in x.walk() if n.tag == "figcaption"]
            joined = " ".join(" ".join(c for n in own for m in n.walk() for c in m.children if isinstance(c, str)).split())
            for n in x.walk():
                if n.tag in MEDIA_TAGS:
                    captions[id(n)] = joined
        if x.tag == "figcaption" and _in_figure_with_media(x):
            continue  # it goes with its media
        if x.tag in MEDIA_TAGS:
            a = x.attributes()
            if source := a.get("src", "").strip():
                flush()
                caption = captions.get(id(x)) or " ".join(a.get("alt", "").split()) or None
                media = source.removeprefix("sha256:")
                out.append({"position": len(out), "kind": "media", "text": None, "media": media, "caption": caption})
        if x.tag in BLOCK:
            text.append(" ")
            stack.append(" ")
        stack.extend(reversed(x.children))
    flush()
    return out


def _in_figure_with_media(node: Node) -> bool:
    up = node.parent
    while up is not None and up.tag != "figure":
        up = up.parent
    return up is not None and any(n.tag in MEDIA_TAGS for n in up.walk())


def sequences(docs: DataFrame, html: str = "html", name: str = "sequence") -> DataFrame:
    """docs with its html replaced by the sequence."""
    names = [c for c in docs.columns if c != html]
    kind = pa.list_(
        pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("media", pa.string()), ("caption", pa.string())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [items_of(x) for x in batch.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], [*names, name])

    schema = widened(docs.select(*names).schema, (name, T._parse_datatype_string(f"array<{ITEM}>")))
    return docs.select(*names, html).mapInArrow(run, schema)


def resolve(documents: DataFrame, store: DataFrame, key: list[str], name: str = "sequence", strict: bool = False) -> DataFrame:
    """documents with `fact` in each item of their sequence; strict: a media item without one raises. Rows
    of one key are expected to have one sequence."""
    media = F.array_distinct(F.transform(F.filter(name, lambda x: x["kind"] == "media"), lambda x: x["media"]))
    refs = documents.select(*key, F.explode(media).alias("digest")).distinct()
    facts = store.select(F.col("payload_sha256").alias("digest"), F.struct("*").alias("fact"))
    # no more than its document has media
    known = split_join(refs, facts, "digest", HOT).groupBy(*key).agg(F.collect_list("fact").alias("_sx_facts"))

    def placed(x: Column) -> Column:
        fact = F.get(F.filter("_sx_facts", lambda f: f["payload_sha256"] == x["media"]), F.lit(0))
        if strict:
            lost = F.raise_error(F.concat(F.lit("no payload of "), x["media"])).cast(store_type)
            fact = F.when((x["kind"] == "media") & fact.isNull(), lost).otherwise(fact)
        return F.struct(*[x[c].alias(c) for c in ("position", "kind", "text", "media", "caption")], fact.alias("fact"))

    store_type = T.StructType(store.schema.fields)
    joined = documents.join(known, key, "left").withColumn("_sx_facts", F.coalesce("_sx_facts", F.array().cast(T.ArrayType(store_type))))
    return joined.withColumn(name, F.transform(name, placed)).select(*documents.columns)


def documents_as_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, KEY, sequence) of each row of (doc_id, text)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    safe = lambda x: F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    source = F.concat(F.lit("sha256:"), digest(F.col("text")))
    html = F.concat(
        F.lit("<article><p>"), safe(F.substring_index(text, "\n", 1)), F.lit('</p><figure><img src="'), source, F.lit('"><figcaption>Text of '),
        lines.cast("string"), F.lit(" lines</figcaption></figure><p>"), safe(F.substring_index(text, "\n", -1)),
        F.lit('</p><img alt="The same" src="'), source, F.lit('"></article>'),
    )
    n = F.octet_length(text).cast("long")
    return sequences(docs.select("doc_id", n.alias("n_bytes"), *[v.alias(k) for k, v in row_key().items()], html.alias("html")))


def document_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, FACTS, position, caption, n_items, n_media) of every row of (doc_id, text): its text's media, and
    where its document refers to it first."""
    spark = docs.sparkSession
    uri = shared_folder(spark, "media")
    store_media(docs, uri)
    facts = stored(read_media(spark.read.schema("media binary").parquet(uri)), "facts")
    # a place, its kind and caption are all that is asked: the texts between stay where they are
    item = lambda x: F.struct(*[x[c].alias(c) for c in ("position", "kind")], F.lit(None).cast("string").alias("text"), x["media"].alias("media"), x["caption"].alias("caption"))
    light = documents_as_media(docs).withColumn("sequence", F.transform("sequence", item))
    found = resolve(stored(light, "sequences"), facts, list(KEY), strict=True)
    media = F.filter("sequence", lambda x: x["kind"] == "media")
    first = F.element_at(media, 1)
    return found.select(
        "doc_id", "n_bytes", *[first["fact"][n].alias(n) for n, _ in FACTS], first["position"].alias("position"), first["caption"].alias("caption"),
        F.size("sequence").alias("n_items"), F.size(media).alias("n_media"),
    )
