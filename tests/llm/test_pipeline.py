"""The pipeline, stage by stage, against plain versions over the same input."""

from collections import Counter, defaultdict
from itertools import combinations

import corpus_pipeline as p
from conftest_llm import save
from pyspark.sql import functions as F
from test_dedup import plain_line_dedup, plain_similar
from test_text_ops import plain_contamination


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages_against_plain(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    stages = dict(p.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_duplicates", "decontamination", "mixing"]
    columns = docs.columns

    def step(name, df):
        out = stages[name](spark, df, small)
        out.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    one = step("language_id", docs)
    assert one.columns == columns
    assert {d for d, t in rows(docs)} - {d for d, t in rows(one)} == {d for d, t in rows(docs) if not any(c.isalpha() for c in t or "")}

    two = step("line_dedup", one)
    assert two.columns == columns and two.count() == one.count()
    import hashlib

    kept = sorted((str(d), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows(two))
    assert kept == sorted((d, h) for d, _, _, h in plain_line_dedup(rows(one)))
    assert two.where(F.length("text") != F.col("n_chars")).count() == 0

    three = step("near_duplicates", two)
    want = {min(group) for group in plain_similar(rows(two))}
    assert three.columns == columns and sorted(d for d, _ in rows(three)) == sorted(want)

    four = step("decontamination", three)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    bad = {r[0] for r in plain_contamination(rows(three), items) if r[-2]}
    assert four.columns == columns and {str(d) for d, _ in rows(four)} == {str(d) for d, _ in rows(three)} - bad

    five = step("mixing", four)
    assert {d for d, _ in rows(five)} <= {d for d, _ in rows(four)} and five.where("copy > 3").count() == 0
    assert abs(five.agg(F.sum("size")).first()[0] / four.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] - 1) < 0.15
    assert sorted(map(str, p.run(spark, small).collect())) == sorted(map(str, five.collect()))


def test_edges_and_empty(spark, edge, empty, tmp_path):
    save(spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string"), tmp_path, "benchmark")
    for frame in (edge, empty):
        docs = frame
        for k, (name, stage) in enumerate(p.STAGES):
            out = stage(spark, docs, str(tmp_path))
            if k < 4:
                assert out.columns == docs.columns
            out.write.mode("overwrite").parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
    survivors = spark.read.parquet(f"{tmp_path}/near_duplicates")
    assert survivors.count() == 0  # of the empty table


def test_extra_columns_go_through(spark, edge, tmp_path):
    save(spark.createDataFrame([(1, "nothing of the kind")], "item_id long, text string"), tmp_path, "benchmark")
    docs = edge.withColumnRenamed("size", "class").withColumn("node", F.lit(7)).withColumn("wide", F.lit("y"))
    for name, stage in p.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(docs.columns)] == docs.columns or name == "mixing" and set(docs.columns) <= set(out.columns)
        out.write.parquet(f"{tmp_path}/extra-{name}")
        docs = spark.read.parquet(f"{tmp_path}/extra-{name}")
    assert docs.where("node = 7 and wide = 'y' and class = 'x' and doc = 'x'").count() == docs.count() > 0


def test_names_in_another_case_are_replaced(spark, tmp_path):
    docs = spark.createDataFrame([(1, "some words", "en", "a", 9, "x", "y")], "doc_id long, text string, lang string, source string, n_chars long, SIZE string, Copy string")
    out = p.mixing_stage(spark, docs, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "copy"]
    out.write.parquet(f"{tmp_path}/mixed")
    assert spark.read.parquet(f"{tmp_path}/mixed").first()["size"] == 2


def test_a_language_that_nobody_labelled_is_rejected(spark):
    own = [(i, f"the quick brown fox number {i} jumps over the lazy dog and runs away from the house", "en") for i in range(600)]
    own += [(1000 + i, f"der schnelle braune Fuchs Nummer {i} springt über den faulen Hund und läuft aus dem Haus", "de") for i in range(600)]
    other = [(2000, "Съешь же ещё этих мягких французских булок, да выпей же чаю", None), (2001, "Ξεσκεπάζω την ψυχοφθόρα βδελυγμία", None)]
    docs = spark.createDataFrame([(i, t, x, "a", 1) for i, t, x in own + other], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in p.language_id(spark, docs, "").collect()} == {i for i, _, _ in own}


def near_pairs(texts):
    """Pairs (smaller id, larger id) whose sets of five-word shingles are at least 0.8 alike."""
    sets, owners = {}, defaultdict(list)
    for d, t in texts:
        w = (t or "").lower().split()
        if w:
            sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
            for s in sets[d]:
                owners[s].append(d)
    shared = Counter((a, b) for ds in owners.values() for a, b in combinations(sorted(ds), 2))
    return [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n)]


def test_near_duplicates_by_exact_similarity(spark):
    """Of the documents with a partner at least 0.8 alike, nine of ten are in its class, and a document that
    goes has a partner of at least 0.6 among those that it is linked to."""
    texts = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    docs = spark.createDataFrame([(d, t, "en", "a", 1) for d, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in p.near_duplicates(spark, docs, "").collect()}
    pairs = near_pairs(texts)
    late = {b for _, b in pairs}
    assert len(late) > 50 and len(late - kept) >= 0.9 * len(late)
    clean = {d for d, _ in texts} - {d for pair in pairs for d in pair}
    assert len(clean - kept) <= 0.01 * len(clean)


def test_repeated_rows_leave_one(spark, tmp_path):
    rows_in = [(1, "the very same words in every copy", "en", "a", 1)] * 5 + [(2, "quite other words that nobody repeats here", "en", "a", 1)]
    docs = spark.createDataFrame(rows_in, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in p.near_duplicates(spark, docs, "").collect()) == [1, 2]


def test_an_unlabelled_corpus_keeps_its_documents(spark):
    texts = [(1, "words of a text"), (2, None), (3, ""), (4, "12 !? 34"), (5, "é"), (6, "漢字")]
    docs = spark.createDataFrame([(i, t, None, "a", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = p.language_id(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == [1, 5, 6]
