"""op5: archives, the normaliser, revisits."""

import gzip
import io
import zlib

import oracle
import pytest
from conftest_llm import save

from standex.llm import queries, sql, warc
from standex.llm.common import shared_folder


def test_against_sql(spark, small):
    assert oracle.rows_of(queries.op5_warc(spark, small)) == oracle.rows_in(oracle.connect(small), sql.WARC)


def test_copies_revisit_the_smallest(spark, tmp_path):
    big, other = "<p>" + "x" * 200, "<p>" + "é" * 60
    rows = [(5, big), (3, big), (9, big), (7, other), (8, other), (1, "tiny"), (2, "tiny"), (4, None), (6, ""), (3, big), (None, big), (10, "z" * 50_000)]
    sf = save(spark.createDataFrame([(i, "http://a b/é", h) for i, h in rows], "page_id long, url string, html string").selectExpr("*", "1 as n"), tmp_path, "pages")
    got = sorted((r.page_id or 0, r.payload_bytes, r.record_type, r.refers_to or 0) for r in queries.op5_warc(spark, sf).collect())
    n, m = len(big), len(other.encode())
    assert got == sorted(
        [(5, n, "revisit", 3), (3, n, "response", 0), (3, n, "response", 0), (9, n, "revisit", 3), (0, n, "revisit", 3), (7, m, "response", 0), (8, m, "revisit", 7),
         (1, 4, "response", 0), (2, 4, "response", 0), (4, 0, "response", 0), (6, 0, "response", 0), (10, 50_000, "response", 0)]
    )


def test_no_pages(spark, tmp_path):
    sf = save(spark.createDataFrame([], "page_id long, url string, html string"), tmp_path, "pages")
    assert queries.op5_warc(spark, sf).count() == 0


def test_members_stand_alone_and_index_finds_them(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (1 + i * 50), None) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id long, uri string, payload string, refers_to long").repartition(2)
    raw = warc.write_archives(df, shared_folder(spark, "t-raw"), archive_bytes=50_000)
    assert raw.count() > 2
    for r in raw.collect():  # one gzip stream a file
        z = zlib.decompressobj(31)
        data = open(r.archive.removeprefix("file://"), "rb").read()
        z.decompress(data)
        assert z.eof and not z.unused_data
    normal = warc.normalise(raw, shared_folder(spark, "t-norm"))
    found = warc.read_records(normal).collect()
    assert sorted(r.page_id for r in found) == list(range(40))
    for r in found[:5]:
        with open(r.archive.removeprefix("file://"), "rb") as f:
            f.seek(r.offset)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\n")


def test_normaliser_reads_any_cut_and_many_members():
    recs = [warc.record(i, "u", bytes([65 + i]) * (i * 7), None) for i in range(9)]
    for parts in ([b"".join(recs)], recs, [b"".join(recs[:4]), b"".join(recs[4:])]):
        packed = b"".join(gzip.compress(p) for p in parts)
        assert list(warc.records_in(warc.inflated(io.BytesIO(packed)))) == recs
    whole = b"".join(recs)
    for step in (1, 3, 1000):
        assert list(warc.records_in(whole[i : i + step] for i in range(0, len(whole), step))) == recs
    with pytest.raises(ValueError):
        list(warc.records_in([whole[:-50]]))


class Source:
    """A file that gives n bytes at a time at most."""

    def __init__(self, data, n):
        self.data, self.n, self.at = data, n, 0

    def read(self, n):
        self.at += min(n, self.n)
        return self.data[self.at - min(n, self.n) : self.at]


@pytest.mark.parametrize("step", [1, 7, 1000, 1 << 20])
def test_inflating_whole_and_cut_streams(step):
    content = [b"abc" * 5000, b"", b"x", bytes(range(256)) * 100]
    data = warc.member(content[0]) + warc.member(content[1]) + warc.member(content[2]) + bytes(512) + warc.member(content[3])
    assert b"".join(warc.inflated(Source(data, step))) == b"".join(content)
    assert b"".join(warc.inflated(Source(data + bytes(9), step))) == b"".join(content)
    for cut in (1, 4, 8, 12):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.inflated(Source(data[:-cut], step)))
    assert list(warc.inflated(Source(b"", step))) == []


def test_inflating_is_bounded():
    bomb = warc.member(bytes(50_000_000), 9)
    assert len(bomb) < 60_000
    sizes = [len(x) for x in warc.inflated(Source(bomb, 1 << 20))]
    assert sum(sizes) == 50_000_000 and max(sizes) <= warc.READ
