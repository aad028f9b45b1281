"""Readers, writers, the command line."""

import json

import pytest

from standex import __main__ as cli
from standex import schemas
from standex.functions import lexicons as lex
from standex.plans import data
from standex.sources import io


def test_array_round_trip(spark, tmp_path):
    path = f"{tmp_path}/r.json"
    io.write_array(data.run_results(spark), path)
    assert len(json.load(open(path))) == 10
    assert io.read_results(spark, path).count() == 10


def test_first_existing_path_is_read(spark, tmp_path):
    (tmp_path / "b.json").write_text('[{"id": "é", "keywords": ["a"]}, {"id": "y"}]')
    got = io.read_chunks(spark, f"{tmp_path}/a.json", f"{tmp_path}/b.json").orderBy("id").collect()
    assert [r.id for r in got] == ["y", "é"] and got[1].keywords == ["a"] and got[0].text is None
    with pytest.raises(FileNotFoundError):
        io.read_chunks(spark, f"{tmp_path}/none.json")


def test_malformed_json_raises(spark, tmp_path):
    (tmp_path / "x.json").write_text("[{broken")
    with pytest.raises(Exception, match="Malformed|MALFORMED"):
        io.read_array(spark, f"{tmp_path}/x.json", schemas.QUERY).collect()


def test_documents_by_parser(spark, tmp_path):
    (tmp_path / "d.txt").write_text("page one\fpage two")
    got = io.read_documents(spark, f"{tmp_path}/d.txt", io.plain_text).collect()
    assert [(r.page_no, r.text) for r in got] == [(0, "page one"), (1, "page two")]


def test_literal_relation_keeps_order(spark):
    got = io.literal(spark, lex.CATEGORY_KEYWORDS).collect()
    assert [r.term for r in got] == [t for ts in lex.CATEGORY_KEYWORDS.values() for t in ts]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "src").mkdir()
    body = "IS 269: 1989 Ordinary Portland Cement 33 grade\nportland cement fineness soundness\nIS 383: 1970 Coarse aggregate\ncoarse aggregate gravel sand crushed stone\n"
    (tmp_path / "src" / "s.txt").write_text(body)
    assert cli.main(["ingest", f"{tmp_path}/src", f"{tmp_path}/chunks"]) == 0
    assert cli.main(["enrich", f"{tmp_path}/chunks", f"{tmp_path}/rich"]) == 0
    numbered = lambda df: sorted((r.doc_idx, r.id, r.text) for r in df.collect())
    assert numbered(io.read_chunks(spark, f"{tmp_path}/rich")) == numbered(spark.read.parquet(f"{tmp_path}/chunks"))
    queries = [{"id": "q1", "query": "33 grade portland cement", "expected_standards": ["IS 269: 1989"]}]
    (tmp_path / "q.json").write_text(json.dumps(queries))
    assert cli.main(["infer", "-i", f"{tmp_path}/q.json", "-o", f"{tmp_path}/out.json", "--chunks", f"{tmp_path}/rich"]) == 0
    assert json.load(open(f"{tmp_path}/out.json"))[0]["retrieved_standards"][0] == "IS 269: 1989"
    assert cli.main(["evaluate", "--results", f"{tmp_path}/out.json"]) == 0
    assert "100.0" in capsys.readouterr().out
    assert cli.main(["infer", "-i", f"{tmp_path}/q.json", "-o", f"{tmp_path}/new/out.json", "--sequential", "--chunks", f"{tmp_path}/none", f"{tmp_path}/rich"]) == 0
    again = json.load(open(f"{tmp_path}/new/out.json"))[0]
    assert again["retrieved_standards"][0] == "IS 269: 1989" and again["latency_seconds"] > 0 and "1 of 1" in capsys.readouterr().err
    assert cli.main(["analyze", f"{tmp_path}/rich"]) == 0


def test_settings_come_from_the_session_then_the_environment(spark, monkeypatch):
    monkeypatch.setenv("MODEL", "of the environment")
    assert io.environment(spark, "MODEL") == "of the environment" and io.environment(spark, "UNSET", "x") == "x"
    spark.conf.set("spark.standex.model", "of the session")
    assert io.environment(spark, "MODEL") == "of the session"
