"""The containment join, and benchmark_relevance of items of every length, against DuckDB."""

import random

import duckdb
import pytest

from standex.operators import contain, evaluate
from standex.plans import domain_queries
from standex.plans.registry import ORACLES

DOCS = [
    (1, "alpha beta gamma delta epsilon zetas and more"), (2, "one two"), (3, ""), (4, None), (5, "xalpha beta gamma delta epsilon zeta, eta theta"),
    (6, "pre alpha beta gamma delta epsilon zeta eta thetas"), (None, "one two"), (7, "one  two\nthree"), (7, "one two three"),
]
ITEMS = [
    (1, "alpha beta gamma delta epsilon zeta"), (2, "one two"), (3, ""), (4, None), (5, "alpha beta gamma delta epsilon zeta eta theta"), (6, "eta"), (7, " "),
    (8, "lpha beta gamma delta epsilon"), (9, "two\nthree"), (10, "not there"), (11, "alpha beta gamma delta epsilon zeta eta"), (12, "ne tw"),
]


@pytest.mark.parametrize("bound", [contain.BOUND, 300])
def test_items_of_every_length(spark, tmp_path, monkeypatch, bound):
    monkeypatch.setattr(evaluate.relevant, "__defaults__", (bound,))
    con = duckdb.connect()
    for name, rows, schema in (("documents", DOCS, "doc_id long, text string"), ("benchmark", ITEMS, "item_id long, text string")):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    got = domain_queries.benchmark_relevance(spark, str(tmp_path))
    assert "NestedLoop" not in got._jdf.queryExecution().toString() and "Cartesian" not in got._jdf.queryExecution().toString()
    assert sorted(tuple(r) for r in got.select("item_id", "n_relevant", "first_doc").collect()) == sorted(con.execute(ORACLES["benchmark_relevance"]).fetchall())


@pytest.mark.parametrize(("bound", "piece"), [(contain.BOUND, contain.PIECE), (2_000, 16)])
def test_join_equals_contains(spark, monkeypatch, bound, piece):
    """Patterns of 0 to 40 characters over few letters, one of them of two bytes and one of four, cut from texts or not."""
    monkeypatch.setattr(contain, "PIECE", piece)
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("ab é\U0001f600") for _ in range(n))
    texts = [None, "", *[some(rng.randrange(1, 120)) for _ in range(60)]]
    patterns = {None, "", *[some(rng.randrange(1, 6)) for _ in range(40)]}
    for _ in range(60):
        t = rng.choice(texts[2:])
        at = rng.randrange(len(t))
        patterns.add(t[at : at + rng.randrange(1, 41)])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, texts[5])], "d long, t string").repartition(3)
    got = contain.holding(docs, "t", ["d"], spark.createDataFrame([(p,) for p in patterns] * 2, "p string"), "p", bound)
    want = [(i, p) for i, t in [*enumerate(texts), (1, texts[5])] for p in patterns if t is not None and p is not None and p in t]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert contain.holding(docs.limit(0), "t", ["d"], docs.selectExpr("t as p"), "p").count() == 0
    assert contain.holding(docs, "t", ["d"], docs.selectExpr("t as p").limit(0), "p").count() == 0
