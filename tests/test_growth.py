"""What work is done once a row, and where rows aren't shuffled: seen in plans, so that small inputs tell."""

from pyspark.sql import functions as F

from standex.operators import enrich, index, ingest, neighbours, search
from standex.plans import domain_queries, search_queries
from standex.sources import shared


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_lowered_once_for_all_terms(spark):
    df = spark.createDataFrame([("Portland CEMENT and steel",)], "text string")
    body = F.col("text")
    calls = [ingest.category_of(body), enrich.application_domains(body), enrich.composition_terms(body), ingest.keywords_of(body, F.lit("cement"))]
    for call in calls:
        assert plan_of(df.select(call.alias("x"))).count("lower(") == 1


def test_terms_are_not_sought_where_only_places_are_asked(spark):
    rows = [(0, "IS 1", "t", "x" * 1500), (1, "IS 2", None, "short"), (2, "IS 3", "", None)]
    df = ingest.described(spark.createDataFrame(rows, "std_seq long, id string, title string, text string"))
    places = ingest.cut(df).select("std_seq", "k", "chunk_index")
    assert "lower(" not in plan_of(places)
    assert sorted((r.std_seq, r.k) for r in places.collect()) == [(0, 0), (0, 1), (0, 2), (0, 3), (1, 0), (1, 1), (2, 0), (2, 1)]
    texts = {(r.std_seq, r.k): r.text for r in ingest.cut(df).collect()}
    assert texts[0, 2] == "IS 1 t " + "x" * 900 and texts[0, 3] == "IS 1 t " + "x" * 100 and texts[2, 1] is None


def test_postings_are_counted_without_a_shuffle(spark):
    rows = [(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["c"])]
    tokened = spark.createDataFrame(rows, "doc_idx long, tokens array<string>")
    posted = index.postings(tokened)
    assert "Exchange" not in posted._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in posted.collect()) == [(1, "a", 1, 3), (1, "b", 2, 3), (4, "c", 1, 1)]
    assert sorted(tuple(r) for r in index.frequencies(tokened).collect()) == [("a", 1), ("b", 1), ("c", 1)]


def test_products_rank_as_scores_do(spark):
    """Ties, repeated query tokens, common terms with negative weights, queries without a known token, few documents."""
    words = ["common " + w for w in ("red", "red", "green red", "blue", "", "green green", "blue red")] * 4
    corpus = spark.createDataFrame([(i, "", "", w, "c", w) for i, w in enumerate(words)], "doc_idx long, id string, title string, text string, category string, search_text string")
    vectors = spark.createDataFrame([], "doc_idx long, embedding array<float>")
    idx = index.build(corpus, vectors)
    queries = spark.createDataFrame([(1, "red red green"), (2, "common"), (3, "unknown"), (4, ""), (5, "blue")], "qid long, query string")
    tokens = search.query_tokens(queries)
    slow = search.bm25_ranks(queries, search.bm25_scores(tokens, idx), idx.corpus)
    expected = sorted(tuple(r) for r in slow.select("qid", "rank", "doc_idx", "score").collect())
    for bound in (search.BOUND, 0):
        found = search.lexical_ranks(queries, tokens, idx, bound=bound).select("qid", "rank", "doc_idx", "score")
        assert sorted(tuple(r) for r in found.collect()) == expected
    by_join = neighbours.lists(idx.postings.join(idx.vocab, "term").select("doc_idx", "tid"))
    assert sorted(map(str, idx.lists().collect())) == sorted(map(str, by_join.collect()))


def test_segments_are_made_where_the_documents_are(spark):
    """An even corpus isn't shuffled, nor are its postings; one that lies in a single part is spread."""
    n = 2 * spark.sparkContext.defaultParallelism
    corpus = spark.range(20 * n, numPartitions=n).selectExpr("id AS doc_idx", "'' AS id", "'' AS title", "concat('w', id % 7, ' b ', 'v', id, ' a b') AS text", "'c' AS category")
    corpus = corpus.withColumn("search_text", F.col("text"))
    assert "Exchange" not in index.spread(corpus)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in index.spread(corpus.coalesce(1))._jdf.queryExecution().executedPlan().toString()
    built = index.build(corpus, spark.createDataFrame([], "doc_idx long, embedding array<float>"))
    assert built.corpus.select(F.input_file_name()).distinct().count() == n
    rows = built.postings.select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("at"), "term", "doc_idx").collect()
    files = {}
    for r in sorted(rows, key=lambda r: r["at"]):
        files.setdefault(r["f"], []).append((r["term"], r["doc_idx"]))
    assert all(held == sorted(held) for held in files.values())
    of = {}
    for f, held in files.items():
        for _, doc in held:
            of.setdefault(doc, set()).add(f)
    assert len(of) == 20 * n and all(len(f) == 1 for f in of.values())


def test_postings_are_sorted_in_parts(spark, monkeypatch):
    """What a task sorts is bounded by bytes of tokens: a file of them gives several files of postings."""
    n, name = spark.sparkContext.defaultParallelism, "spark.sql.files.maxPartitionBytes"
    corpus = spark.range(1000 * n, numPartitions=n).selectExpr("id AS doc_idx", "'' AS id", "'' AS title", "concat('w', id % 7, ' ', md5(string(id)), ' ', md5(string(-1 - id))) AS text", "'c' AS category")
    corpus, before = corpus.withColumn("search_text", F.col("text")), spark.conf.get(name)
    monkeypatch.setattr(index, "PART", 1 << 14, raising=False)
    monkeypatch.setattr(index, "GROUP", 1 << 13, raising=False)
    built = index.build(corpus, spark.createDataFrame([], "doc_idx long, embedding array<float>"))
    assert spark.conf.get(name) == before
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(built.postings) >= 3 * files(built.tokens) and built.postings.count() == 3000 * n
    assert built.vocab.count() == 2000 * n + 7 and built.vocab.agg(F.sum("df")).first()[0] == 3000 * n


def test_answers_are_searched_once_and_texts_stay(spark, small):
    """What judges the answers reads them as a table: it holds no search, and texts aren't shuffled before they are picked."""
    judging = domain_queries.mrr_at_5(spark, small)
    assert "MapInArrow" not in plan_of(judging)
    picked = [line for line in judging._jdf.queryExecution().executedPlan().toString().split("\n") if "LeftSemi" in line]
    assert len(picked) == 1 and "BroadcastHashJoin" in picked[0]


def test_found_documents_texts_stay(spark, small):
    """What is fused is a table, so the texts that it picks aren't shuffled."""
    queries, idx = search_queries._scale(spark, small)
    found = search.hybrid(queries.where("qid < 3"), idx.vectors.where("doc_idx < 3").withColumnRenamed("doc_idx", "qid"), idx)
    picked = [line for line in found._jdf.queryExecution().executedPlan().toString().split("\n") if "Join [doc_idx" in line]
    assert len(picked) == 1 and "BroadcastHashJoin" in picked[0]


def test_an_index_that_was_dropped_is_built_again(spark, small):
    before = search_queries.scale_index(spark, small)
    assert search_queries.scale_index(spark, small) is before
    shared.clean(spark)
    assert search_queries.scale_index(spark, small) is not before and search_queries.bm25_stats(spark, small).count() == 1
