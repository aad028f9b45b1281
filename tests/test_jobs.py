"""The jobs: growing input, repeated runs, faulty rows, the command line."""

import logging
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from jobs import corpus_ingest, search_evaluation, settings

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CEMENT = "IS 269 specification. Ordinary portland cement with clinker and fly ash; see IS 383 (Part 2): 1970. Superseded by IS 455: 1989. "


def add(spark, folder, rows):
    """One more file of documents, as a producer would drop it."""
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, Is_Valid string")
    df.coalesce(1).write.mode("append").parquet(folder)


def names(df):
    return sorted((r["doc_id"] is None, r["doc_id"], r["k"], r["text"], r["category"], r["is_valid"], tuple(r["keywords"])) for r in df.collect())


def test_ingest_takes_only_what_is_new(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    source = f"{tmp_path}/documents.parquet"
    chosen = corpus_ingest.Settings(source, f"{tmp_path}/chunks", f"{tmp_path}/mark", 1)
    first = [(1, CEMENT * 20, "a", "en", "x"), (2, None, "a", None, None), (3, "  \n ", None, "en", None), (4, "too short", "b", "en", None)]
    add(spark, source, first)
    took = corpus_ingest.run(spark, chosen)
    before = names(took)
    assert {r[1] for r in before} == {1} and [r[2] for r in before] == list(range(len(before)))
    assert {(r["category"], r["superseded_by"]) for r in took.where("k = 1").collect()} == {("cement", "IS 455: 1989")}
    assert names(corpus_ingest.run(spark, chosen)) == before  # nothing new
    second = [(5, "†" * 30 + " a text with many daggers", "c", "de", None), (None, CEMENT, None, None, None), (1, CEMENT * 20, "a", "en", "x")]
    add(spark, source, second)
    add(spark, source, [(6, CEMENT + "x" * 700, "c", "de", None)])
    after = names(corpus_ingest.run(spark, chosen))
    assert names(corpus_ingest.run(spark, chosen)) == after
    assert "read 3 new" not in caplog.text and "read 4 new documents in 2 batches" in caplog.text and "read 0 new" in caplog.text
    at_once = corpus_ingest.run(spark, corpus_ingest.Settings(source, f"{tmp_path}/chunks2", f"{tmp_path}/mark2"))
    assert after == names(at_once) == names(corpus_ingest.chunks_of(spark.read.parquet(source).select("doc_id", "text", "source")))
    assert {r["doc_id"] for r in at_once.where("not is_valid").collect()} == {5}
    assert os.path.isdir(f"{tmp_path}/chunks/is_valid=false/category=general")


def test_ingest_of_an_empty_folder_and_of_a_cut_off_run(spark, tmp_path):
    source = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([], "doc_id long, text string, source string").write.parquet(source)
    chosen = corpus_ingest.Settings(source, f"{tmp_path}/chunks", f"{tmp_path}/mark")
    assert corpus_ingest.run(spark, chosen).count() == 0
    add(spark, source, [(1, CEMENT, "a", "en", None)])
    once = names(corpus_ingest.run(spark, chosen))
    # a run that wrote its files and died before its batch was committed: the batch is done again
    commits = sorted(n for n in os.listdir(f"{tmp_path}/mark/commits") if n.isdigit())
    for name in (commits[-1], f".{commits[-1]}.crc"):
        os.remove(f"{tmp_path}/mark/commits/{name}")
    assert names(corpus_ingest.run(spark, chosen)) == once


def tables(spark, folder):
    docs = [(i, f"filler words number{i} and more of them", "en") for i in range(30)]
    docs += [(100, "a needle in the haystack of words", "en"), (101, "before: a needle in the haystack", "de"), (102, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{folder}/documents.parquet")
    asked = [(1, "a needle in the haystack"), (2, "nowhere to be found"), (3, "filler"), (4, None), (5, "number7 and"), (10, "a needle in the haystack"), (None, "filler")]
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [0.0, 1.0]) for i in range(10, 30)], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    return search_evaluation.Settings(f"{folder}/documents.parquet", f"{folder}/benchmark.parquet", f"{folder}/embeddings.parquet", f"{folder}/work", f"{folder}/answers")


def test_evaluation_judges_and_repeats_itself(spark, tmp_path, caplog):
    caplog.set_level(logging.INFO)
    chosen = tables(spark, tmp_path)
    got = sorted(map(tuple, search_evaluation.run(spark, chosen).collect()))
    assert sorted(map(tuple, search_evaluation.run(spark, chosen).collect())) == got
    rows = spark.read.parquet(chosen.target)
    marks = {r["item_id"]: r for r in rows.where("rank = 1").collect()}
    assert set(marks) == {1, 2, 3, 5, 10}
    # of equal weight, twenty vectors outrank words: the one query with a vector misses
    assert (marks[10]["outcome"], marks[10]["n_relevant"], marks[10]["recall"]) == ("missed", 2, 0.0)
    assert (marks[1]["n_relevant"], marks[1]["recall"], marks[2]["outcome"], marks[3]["n_relevant"], marks[5]["n_relevant"]) == (2, 1.0, "no_relevant", 30, 1)
    for item, text in ((1, "a needle in the haystack"), (3, "filler")):
        own = rows.where(F.col("item_id") == item).join(spark.read.parquet(chosen.documents), "doc_id").collect()
        assert len(own) == 20 and all(r["relevant"] == (text in (r["text"] or "")) for r in own)
        first = min(r["rank"] for r in own if r["relevant"])
        assert {(r["first_rank"], r["hit_at_3"], r["rr_at_5"]) for r in own} == {(first, first <= 3, 1 / first if first <= 5 else 0.0)}
    assert "read 33 documents, 5 queries" in caplog.text and "wrote the answers to 5 queries" in caplog.text


@pytest.mark.parametrize("job", ["corpus_ingest", "search_evaluation"])
def test_command_line(spark, tmp_path, job):
    chosen = tables(spark, tmp_path)
    lines = [f'{k} = "{v}"' for k, v in vars(chosen).items() if k != "answers"] if job == "search_evaluation" else [f'documents = "{chosen.documents}"', f'target = "{tmp_path}/no"', f'checkpoint = "{tmp_path}/mark"']
    (tmp_path / "job.toml").write_text("\n".join(lines))
    environment = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false --conf spark.sql.shuffle.partitions=2 pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", f"jobs.{job}", "--config", str(tmp_path / "job.toml"), "--target", f"{tmp_path}/out"], cwd=ROOT, env=environment, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
    assert spark.read.parquet(f"{tmp_path}/out").count() > 0 and not os.path.exists(f"{tmp_path}/no")
    assert "settings:" in done.stderr


def test_settings_refuse_what_they_dont_know(tmp_path, capsys):
    (tmp_path / "c.toml").write_text('documents = "a"\ntarget = "b"\ncheckpoint = "c"\nother = 1')
    with pytest.raises(SystemExit):
        settings.read(corpus_ingest.Settings, ["--config", str(tmp_path / "c.toml")], "")
    assert "unknown settings: other" in capsys.readouterr().err
    with pytest.raises(SystemExit):
        settings.read(corpus_ingest.Settings, ["--target", "b"], "")
    assert "missing settings: documents, checkpoint" in capsys.readouterr().err
    got = settings.read(corpus_ingest.Settings, ["--documents", "a", "--target", "b", "--checkpoint", "c", "--files-per-batch", "7"], "")
    assert got.files_per_batch == 7


def test_evaluation_indexes_documents_once(spark, tmp_path, monkeypatch):
    """Of documents that haven't changed the index stays; changed ones, and an index that isn't whole, give a new one."""
    built = []
    monkeypatch.setattr(search_evaluation.index, "build", lambda *a, f=search_evaluation.index.build: built.append(1) or f(*a))
    chosen = tables(spark, tmp_path)
    rows = lambda: sorted(map(tuple, search_evaluation.run(spark, chosen).collect()))
    first = rows()
    assert rows() == first and len(built) == 1
    shutil.rmtree(f"{tmp_path}/work/state")
    assert rows() == first and len(built) == 2
    more = spark.createDataFrame([(103, "one more needle: a needle in the haystack", "de")], "doc_id long, text string, lang string")
    more.write.mode("append").parquet(chosen.documents)
    assert {r[6] for r in rows() if r[0] == 1} == {3} and len(built) == 3
    shutil.rmtree(f"{tmp_path}/work")
    assert {r[6] for r in rows() if r[0] == 1} == {3} and len(built) == 4
