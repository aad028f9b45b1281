"""WARC archives: written as one gzip stream a file, normalised to one member a record, read by offset.

write_archives(): records become WARC/1.1 files, each a monolithic gzip stream of about ARCHIVE bytes
of records. normalise() is the converter for such files, ours or others': it inflates a file once,
front to back, holding one record at a time, writes every record again as a gzip member of its own,
and beside the archive a sidecar (JSON lines) with each member's offset and length.
read_records() then opens archives by their sidecars, member by member.

Files are written by the tasks to the shared folder under names of their own; the manifest of a
step is checkpointed, and only files it lists are ever read, so a task that is run again leaves a
stray file at most. The folder's store must be one that pyarrow opens (file, hdfs, s3, gs).

deduplicated(): of records with equal payloads of at least LEAST bytes, that with the smallest id is the
response and the others are revisits, stored without their payload. Only digests are shuffled for
that; ids and digests
meet the table of repeated digests, very common ones split, and only payloads that refer to another are shuffled.

Defined results: a null html is an empty payload. A record is held whole, however long; its archive is not, nor
is its sidecar. Archives that end inside a member or a record, or whose payloads aren't what their headers say,
raise ValueError. Extra columns aren't read. Rows repeated with the smallest id are all
responses. A null id is never the response of others unless no id is known (then all are
responses). No pages give no archives.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, facts_of, materialise, only_of, split_join, stored

LEAST = 100
#: Bytes of records after which a task begins a new archive.
ARCHIVE = 64 << 20
READ = 1 << 20
CRLF = b"\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed value: archives are written with one date, so that reruns give equal files.
DATE = "2000-01-01T00:00:00Z"
MANIFEST = "archive string, sidecar string, n_records long, n_bytes long"
RECORD = (
    "archive string, offset long, length long, page_id long, uri string, record_type string, refers_to long, "
    "payload_digest string, payload_bytes long"
)


def open_store(uri: str):
    """(pyarrow file system, path) of a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(page_id: int | None, uri: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A WARC record; a revisit if refers_to is given."""
    digest = hashlib.sha256(payload).hexdigest()
    block = HTTP if refers_to is not None else HTTP + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {uri} {digest}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if uri:
        head.append("WARC-Target-URI: " + "".join(uri.split()))
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + CRLF * 2 + block + CRLF * 2


def headers_of(data: bytes) -> dict[str, str]:
    """A record's headers, names in lower case."""
    lines = data[: data.index(CRLF * 2)].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    out: dict[str, str] = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def payload_of(data: bytes, headers: dict[str, str]) -> bytes:
    """A record's payload: its block after the HTTP head."""
    start = data.index(CRLF * 2) + 4
    block = data[start : start + int(headers["content-length"])]
    return block.partition(CRLF * 2)[2] if headers.get("content-type", "").startswith("application/http") else block


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without a time stamp."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def inflated(source) -> Iterator[bytes]:
    """A gzip file's content in pieces of at most READ bytes, through one or several members, read once.
    Zeros after a member are padding. A file that ends inside a member raises ValueError."""
    z, begun = zlib.decompressobj(31), False
    while data := source.read(READ):
        while data:
            if not begun and not (data := data.lstrip(b"\0")):
                break
            begun = True
            out = z.decompress(data, READ)
            if out:
                yield out
            data = z.unconsumed_tail
            if z.eof:
                data, z, begun = z.unused_data, zlib.decompressobj(31), False
            elif not data:  # all is read, but some may wait for its turn
                while out := z.decompress(b"", READ):
                    yield out
                if z.eof:
                    data, z, begun = z.unused_data, zlib.decompressobj(31), False
    if begun:
        raise ValueError("the archive ends inside a gzip member")


def records_in(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a WARC stream; holds one record and one piece."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                while held[:2] == CRLF:
                    del held[:2]
                end = held.find(CRLF * 2)
                if end < 0:
                    break
                need = end + 4 + int(headers_of(bytes(held[: end + 4]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("the archive ends inside a record")


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE, level: int = 4) -> DataFrame:
    """Writes (page_id, uri, payload, refers_to) to archives in folder; returns their manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_store(folder)
        fs.create_dir(path, recursive=True)
        sink, done = None, []

        def close() -> None:
            sink.write(z.flush())
            sink.close()
            done.append((f"{folder}/{name}", None, n, size))

        for batch in batches:
            for page_id, uri, text, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if sink is None:
                    name, n, size = f"raw-{uuid.uuid4().hex}.warc.gz", 0, 0
                    sink, z = fs.open_output_stream(f"{path}/{name}", compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                data = record(page_id, uri, (text or "").encode(), refers_to)
                sink.write(z.compress(data))
                n, size = n + 1, size + len(data)
                if size >= archive_bytes:
                    close()
                    sink = None
        if sink is not None:
            close()
        yield _manifest(done)

    return materialise(records.select("page_id", "uri", "payload", "refers_to").mapInArrow(run, MANIFEST))


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
    kinds = [pa.string(), pa.string(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["archive", "sidecar", "n_records", "n_bytes"]
    )


def normalise(manifest: DataFrame, folder: str, level: int = 6) -> DataFrame:
    """Writes each archive again with a member a record, and its sidecar; returns the new manifest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = open_store(folder)
        fs.create_dir(path, recursive=True)
        for batch in batches:
            done = []
            for source in batch.column(0).to_pylist():
                name = f"normal-{uuid.uuid4().hex}.warc.gz"
                theirs, at = open_store(source)
                offset = n = 0
                with (
                    theirs.open_input_stream(at, compression=None) as data,
                    fs.open_output_stream(f"{path}/{name}", compression=None) as out,
                    fs.open_output_stream(f"{path}/{name}.index.jsonl", compression=None) as index,
                ):
                    for rec in records_in(inflated(data)):
                        packed, head = member(rec, level), headers_of(rec)
                        out.write(packed)
                        entry = {
                            "offset": offset,
                            "length": len(packed),
                            "id": head.get("warc-record-id"),
                            "type": head.get("warc-type"),
                            "uri": head.get("warc-target-uri"),
                        }
                        index.write(json.dumps(entry, ensure_ascii=False).encode() + b"\n")
                        offset, n = offset + len(packed), n + 1
                done.append((f"{folder}/{name}", f"{folder}/{name}.index.jsonl", n, offset))
            yield _manifest(done)

    return materialise(_spread(manifest).mapInArrow(run, MANIFEST))


def _spread(manifest: DataFrame) -> DataFrame:
    """Archives dealt out anew: what one task wrote needn't be read by one task."""
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(parts)


def read_records(manifest: DataFrame) -> DataFrame:
    """RECORD for each member of the normalised archives, found by the sidecar's offsets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, sidecar in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fs, path = open_store(archive)
                _, side = open_store(sidecar)
                rows = []
                with fs.open_input_file(path) as data, fs.open_input_stream(side, compression=None) as f:
                    for line in io.BufferedReader(f):
                        e = json.loads(line)
                        data.seek(e["offset"])
                        rec = zlib.decompress(data.read(e["length"]), 31)
                        rows.append((archive, e["offset"], e["length"], *_facts(rec)))
                        if len(rows) == 5000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    return _spread(manifest).mapInArrow(run, RECORD)


def _facts(rec: bytes) -> tuple:
    head = headers_of(rec)
    number = lambda name: int(head[name]) if name in head else None
    kind = head["warc-type"]
    digest, size = head["warc-payload-digest"].removeprefix("sha256:"), number("x-payload-length")
    if kind == "response":
        payload = payload_of(rec, head)
        found = hashlib.sha256(payload).hexdigest()
        if found != digest or len(payload) != size:
            raise ValueError(f"the payload of {head['warc-record-id']} isn't what its header says")
    return number("x-page-id"), head.get("warc-target-uri"), kind, number("x-refers-to-page-id"), digest, size


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in RECORD.split(", ")]
    kinds = [pa.int64() if x.endswith("long") else pa.string() for x in RECORD.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def deduplicated(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, uri, payload, refers_to) of (page_id, url, html)."""
    payload = F.coalesce("html", F.lit(""))
    digest = F.when(F.octet_length(payload) >= least, F.sha2(payload.cast("binary"), 256))
    keyed = pages.select("page_id", F.col("url").alias("uri"), payload.alias("payload"), F.coalesce("page_id", F.lit(NULL_ID)).alias("_sx_id"), digest.alias("_sx_digest"))
    digests = keyed.where("_sx_digest is not null").select("page_id", "_sx_id", "_sx_digest")
    first = digests.groupBy("_sx_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    repeated = stored(first.where("n > 1 and refers_to is not null").select("_sx_digest", "refers_to"), "repeated")
    # who refers to whom is settled without the payloads; then only those of pages that refer to another move
    again = split_join(only_of(digests, repeated, "_sx_digest"), repeated, "_sx_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    again = stored(again.select("_sx_id", "_sx_digest", "refers_to").distinct(), "again")
    return facts_of(keyed, again, "_sx_id", "_sx_digest").select("page_id", "uri", "payload", "refers_to")
