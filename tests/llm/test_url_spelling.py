import random
import re
import zlib
from collections import Counter

import oracle
import pytest
from conftest_llm import save

from standex.llm import queries, spelling, sql, url_filter

RULES = [*queries.URL_RULES, ("a.org", "", "block"), ("a.org", "/x", "allow"), ("b.a.org", "/", "block"), ("org", "/x/y/zz", "block"), ("B.a.ORG", "/x/", "allow"), ("b.a.org", "/x/", "block")]
URLS = [
    None, "", "no scheme", "://", "http://", "https://Example.ORG/es/1?x=/en/1#y", "http://example.org/en/12", "http://example.org", "http://notexample.org/es/", "http://w.example.com/de/", "http://x.com/d",
    "http://a.org", "http://a.org/x?y", "http://c.b.a.org/x/y/zz/1", "http://c.b.a.org?/x/", "http://q.org/x/y/zzz", "http://org:80/x", "http://u@org/x#://y", "ftp://a.org//x", "http://a.org./x", "http://É.ORG/é/", "http://a\n.org/\nx?\n",
    "http://org/" + "x/y/zz/" * 20_000,
]


def plain_verdict(url, rules):
    """Every rule tried on every URL."""
    host = path = ""
    if url and "://" in url:
        host, path = re.fullmatch(r"(?s)([^/?#]*)([^?#]*).*", url.split("://", 1)[1]).groups()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(h.lower().count("."), len(p), v, h.lower() + p) for h, p, v in rules if ("." + host).endswith("." + h.lower()) and path.startswith(p)]
    _, _, verdict, rule = max(fits, default=(0, 0, "allow", None))
    return host, path, rule, verdict


def test_op11_edges_against_every_rule_both_ways(spark, tmp_path):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(5, URLS[5])], "page_id long, url string").selectExpr("*", "'x' as Host_name")
    rules = url_filter.rule_table(spark, RULES + [(None, "/", "block"), ("org", None, "block"), ("org", "/", None), ("org", "/", "perhaps")])
    want = sorted((i, *plain_verdict(u, RULES)) for i, u in [*enumerate(URLS), (5, URLS[5])])
    for bound in (url_filter.BOUND, 0):
        got = url_filter.judge(pages, rules, bound=bound)
        assert got.columns == ["page_id", "url", "Host_name", "host", "path", "rule", "verdict"]
        assert sorted((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()) == want
    nothing = url_filter.judge(pages, rules.limit(0), "block").collect()
    assert {(r["rule"], r["verdict"]) for r in nothing} == {(None, "block")}
    assert url_filter.judge(pages.limit(0), rules).count() == 0
    with pytest.raises(ValueError, match="already has"):
        url_filter.judge(pages.selectExpr("*", "1 as RULE"), rules)
    folder = save(pages.withColumnRenamed("Host_name", "rule"), tmp_path, "pages")
    assert oracle.rows_of(queries.op11_url_filter(spark, folder)) == oracle.rows_in(oracle_of(folder, "pages"), sql.URL_FILTER)


def oracle_of(folder, table):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{folder}/{table}.parquet/*.parquet')")
    return con


def test_op11_against_sql(spark, small):
    assert oracle.rows_of(queries.op11_url_filter(spark, small)) == oracle.rows_in(oracle.connect(small), sql.URL_FILTER)


def plain_words(rows, every=97):
    count = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def plain_near(words):
    """By trying every edit of every word."""
    letters = {c for w in words for c in w}
    found = {}
    for w in words:
        cuts = [w[:i] + w[i + 1 :] for i in range(len(w))]
        tried = {*cuts, *[w[:i] + c + w[i:] for i in range(len(w) + 1) for c in letters], *[w[:i] + c + w[i + 1 :] for i in range(len(w)) for c in letters]} - {w}
        found[w] = tried & words.keys()
    return found


def plain_groups(words):
    near = plain_near(words)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda o: (-words[o], o), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words.get(form[w])))
    return sorted(out)


def named(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def test_op12_against_every_edit_and_sql(spark, small):
    got = queries.op12_spelling(spark, small)
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()
    assert named(got) == plain_groups(plain_words([tuple(r) for r in docs]))
    assert oracle.rows_of(got) == oracle.rows_in(oracle.connect(small), sql.SPELLING)


def test_op12_larger_table_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert oracle.rows_of(queries.op12_spelling(spark, folder)) == oracle.rows_in(oracle.connect(folder), sql.SPELLING)


@pytest.mark.parametrize("run", [spelling.RUN, 6])
def test_op12_dense_words_in_one_run_or_in_chunks(spark, run):
    """Words of few letters, so that most have many near ones; ties, repeated letters, a long chain of forms."""
    rng = random.Random(run)
    words = {"".join(rng.choice("abé") for _ in range(rng.choice((5, 5, 6, 7)))): rng.randint(3, 40) for _ in range(500)}
    words |= {"aaaaa" + "b" * i + "aaaa": 3 * 2**i for i in range(12)} | {"x" * 200: 3, "x" * 201: 9, "𝒳" * 5 + "é": 4, "𝒳" * 5: 8}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert named(spelling.grouped(df, run=run)) == plain_groups(words)


def test_op12_edges(spark, edge, empty, tmp_path):
    rows = [tuple(r) for r in edge.select("doc_id", "text").collect()]
    assert named(queries.op12_spelling(spark, save(edge, tmp_path / "edge"))) == plain_groups(plain_words(rows))
    assert queries.op12_spelling(spark, save(empty, tmp_path / "empty")).count() == 0
    assert queries.op12_spelling(spark, save(edge.where("text is null"), tmp_path / "null")).count() == 0


def test_op12_very_long_words(spark):
    rows = [("x" * 400_000, 3), ("x" * 400_001, 9), ("x" * 399_999 + "y", 20), ("y" * 400_000, 5)]
    got = spelling.grouped(spark.createDataFrame(rows, "word string, n long")).selectExpr("n", "form_n", "n_near", "length(root) AS l").collect()
    assert sorted(tuple(r) for r in got) == [(3, 20, 2, 400_000), (5, None, 0, 400_000), (9, None, 1, 400_001), (20, None, 1, 400_000)]


def test_op12_merges_find_each_pair_once():
    rng = random.Random(3)
    for _ in range(30):
        words = sorted({"".join(rng.choice("ab") for _ in range(rng.choice((5, 6)))) for _ in range(25)})
        pairs = Counter()
        for first in (True, False):
            for key in {w[:2] if first else w[len(w) - 3 :] for w in words}:
                own = [w for w in words if (w[:2] if first else w[len(w) - 3 :]) == key]
                pairs.update(frozenset((own[x], own[y])) for x, y in spelling.merge(own, 5, first))
        near = plain_near(dict.fromkeys(words, 3))
        assert pairs == Counter({frozenset((a, b)): 1 for a in words for b in near[a] if min(len(a), len(b)) == 5})
