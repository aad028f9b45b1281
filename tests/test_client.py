"""Exports, prompts, the fallback's cards."""

import json

from pyspark.sql import functions as F

from standex.config import Settings
from standex.operators import client, rank, rationale


def test_export(spark):
    rows = [("q", " my query/1 ", 2, "IS 2: 2000", "b"), ("q", " my query/1 ", 1, "IS 1: 2000", "é")]
    df = spark.createDataFrame(rows, "qid string, query string, rank int, id string, title string")
    got = client.export(df, F.lit("2020-01-01T00:00:00Z")).first()
    assert got.filename_part == "my_query1"
    assert json.loads(got.payload) == {
        "generated_on": "2020-01-01T00:00:00Z", "query": " my query/1 ",
        "results": [{"rank": 1, "id": "IS 1: 2000", "title": "é"}, {"rank": 2, "id": "IS 2: 2000", "title": "b"}],
    }


def test_unmatched_queries_get_the_fallback(spark):
    asked = spark.createDataFrame([(1, "zzz"), (2, "33 grade ordinary portland cement")], "qid int, query string")
    got = client.answer_cards(asked, client.canned(spark), client.catalogue(spark)).collect()
    assert [r.std_id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == 1] == [c[0] for c in client.FALLBACK_CARDS]
    assert [r.std_id for r in sorted(got, key=lambda r: r["rank"]) if r.qid == 2][0] == "IS 269: 1989"


def test_edges_without_a_node_are_dropped(spark):
    nodes = spark.createDataFrame([("q", "query", 0.0, 0.0), ("q", "a", 1.0, 1.0)], "qid string, id string, x double, y double")
    edges = spark.createDataFrame([("q", "query", "a"), ("q", "a", "gone")], "qid string, source string, target string")
    assert [(r.source, r.target) for r in client.resolved_edges(nodes, edges).collect()] == [("query", "a")]


def test_prompt_takes_five_documents(spark):
    docs = [(f"IS {i}: 2000", "t", "x" * 400) for i in range(7)]
    df = spark.createDataFrame([("why", ["IS 0: 2000"], docs)], "q string, ids array<string>, docs array<struct<id:string,title:string,text:string>>")
    got = df.select(rationale.prompt(F.col("q"), F.col("ids"), F.col("docs")).alias("p")).first().p
    assert "- IS 0: 2000" in got and "IS 4: 2000" in got and "IS 5: 2000" not in got and "x" * 301 not in got


def test_one_pair_can_be_scored(spark):
    row = ("q", "IS 269 cement", 1, "IS 269: 1989", "Cement", "portland cement", "cement", ["fineness"], [], 2.0)
    schema = "qid string, query string, rank int, id string, title string, text string, category string, keywords array<string>, related_standards array<string>, importance_weight double"
    got = rank.rerank(spark.createDataFrame([row], schema), rank.overlap_model).first()
    assert abs(got.score - 0.3 * 2.0 * 1.2) < 1e-9


def test_settings_follow_the_code():
    got = Settings().as_dict()
    assert got["rerank_candidates"] == rank.CANDIDATES == 8 and got["lexicon_sizes"]["expansion_map"] == 72
