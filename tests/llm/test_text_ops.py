"""op3, op6, op7, op8."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import oracle
import pytest
from conftest_llm import save
from pyspark.sql import functions as F

from standex.llm import decontam, langid, mixing, queries, sql, token_count

# ---- op3


def greedy(word, begins, goes_on, known):
    """Greedy longest match in the simplest way."""
    n, i, pieces = 0, 0, begins
    while True:
        if pieces is goes_on:
            if i >= len(word):
                return n
            if word[i] not in known:
                n, i = n + len(word[i].encode()), i + 1
                continue
        for j in range(len(word), i - 1, -1):
            if word[i:j] in pieces and (j > i or pieces is begins) and all(c in known for c in word[i:j]):
                break
        else:
            return 1
        n, i, pieces = n + 1, j, goes_on


@pytest.fixture(scope="module")
def vocabulary():
    return token_count.sentencepiece_vocabulary(queries.VOCABULARY)


def test_op3_against_greedy(spark, small, vocabulary):
    begins, goes_on = map(set, vocabulary)
    known = {p for p in goes_on if len(p) == 1}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in queries.op3_token_count(spark, small).collect()}
    memo = {}
    for r in docs:
        words = r.text.split()
        total = sum(memo.setdefault(w, greedy(w, begins, goes_on, known)) for w in words)
        assert got[r.doc_id] == (len(words), total)


def test_automaton_on_random_vocabularies():
    rng = random.Random(3)
    for _ in range(60):
        some = lambda n: {"".join(rng.choice("abc") for _ in range(rng.randint(1, 5))) for _ in range(n)}
        begins, goes_on = some(8) | ({""} if rng.random() < 0.7 else set()), some(8) | {"a", "b", "c"}
        known = set("abc")
        own = token_count.Automaton(sorted(begins), sorted(goes_on))
        for _ in range(80):
            word = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 12)))
            assert own.count(word) == greedy(word, begins, goes_on, known), (word, begins, goes_on)


def test_op3_edges(spark, edge, empty, tmp_path):
    got = [(r.n_words, r.n_tokens) for r in queries.op3_token_count(spark, save(edge, tmp_path)).collect()]
    assert len(got) == edge.count() and (0, 0) in got and (30_000, 30_000) in got
    assert queries.op3_token_count(spark, save(empty, tmp_path)).count() == 0


# ---- op6


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))


def plain_contamination(docs, items):
    windows = defaultdict(set)
    for i, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 12)) if w else []:
            windows[tuple(w[k : k + 13])].add(i)
    out = []
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(k) for k in windows}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[g]
        ids = sorted(str(i) for i in found if i is not None)
        near = set()
        for g, owners in windows.items():
            if not owners <= near and set(g) <= set(w):
                at = [k for k, x in enumerate(w) if x in g]
                if any(set(w[k : k + 26]) >= set(g) for k in at):
                    near |= owners
        out.append((str(d), len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w), len(near - {None})))
    return sorted(out)


def check_contamination(spark, sf):
    pairs = lambda name, key: [(r[key], r.text) for r in spark.read.parquet(f"{sf}/{name}.parquet").collect()]
    got = queries.op6_decontamination(spark, sf).collect()
    rows = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated, r.n_near) for r in got)
    assert rows == plain_contamination(pairs("documents", "doc_id"), pairs("benchmark", "item_id"))


def test_op6_against_plain_and_sql(spark, small):
    check_contamination(spark, small)
    assert oracle.rows_of(queries.op6_decontamination(spark, small)) == oracle.rows_in(oracle.connect(small), sql.DECONTAMINATION)


ITEMS = [
    (1, "the same first line here"), (2, "Kelvin K and Été"), (3, None), (4, ""), (5, "!!!"), (6, "word"), (7, " ".join(["word"] * 20)), (7, "unique words only"),
    (None, "deutscher Text über"), (8, " ".join(f"w{i}" for i in range(30))), (6, "word"),
]


def test_op6_edges(spark, edge, empty, tmp_path):
    extra = [(20, "x " + " ".join(f"w{i}" for i in range(10, 25)) + " y"), (21, "kelvin k and été"), (22, "KELVIN K AND ÉTÉ"), (23, " ".join(f"w{i}" for i in range(12)))]
    docs = edge.select("doc_id", "text", "n_words", "term").unionByName(spark.createDataFrame([(a, b, "x", "y") for a, b in extra], "doc_id long, text string, n_words string, term string"))
    save(spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as n", "2 as window"), tmp_path, "benchmark")
    check_contamination(spark, save(docs, tmp_path))
    save(spark.createDataFrame([], "item_id long, text string"), tmp_path, "benchmark")
    check_contamination(spark, str(tmp_path))
    assert queries.op6_decontamination(spark, save(empty, tmp_path)).count() == 0


def test_wide_benchmarks_join_by_shuffle(spark, small, monkeypatch):
    monkeypatch.setattr(decontam, "BOUND", 0)
    check_contamination(spark, small)


def test_op6_is_native(spark, small):
    plan = queries.op6_decontamination(spark, small)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "alpha x x beta x gamma"), (2, "gamma x x x x x x x x alpha beta"), (3, "beta alpha gamma")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    found = lambda span: sorted({r[0] for r in decontam.proximity_matches(docs, items, span, 3).select("_sx_id").collect()})
    assert found(3) == [3] and found(6) == [1, 3] and found(10) == [1, 3] and found(11) == [1, 2, 3]
    assert decontam.phrase_matches(docs, items).count() == 0


def test_the_intersection_decides(spark):
    """Documents that have all words of the phrase, shifted by one, or the rarest two in place only."""
    phrase = "alpha beta gamma delta"
    docs = spark.createDataFrame([(1, f"x {phrase} y {phrase}"), (2, "alpha gamma beta delta"), (3, "x alpha beta x delta gamma"), (4, "beta gamma delta alpha")], "doc_id long, text string")
    items = spark.createDataFrame([(1, phrase), (2, "to be to be")], "item_id long, text string")
    got = sorted((r._sx_id, r.start, r.n) for r in decontam.phrase_matches(docs, items).collect())
    assert got == [(1, 1, 4), (1, 6, 4)]
    again = spark.createDataFrame([(5, "to be to be to be"), (6, "to be or to be")], "doc_id long, text string")
    assert sorted((r._sx_id, r.start) for r in decontam.phrase_matches(again, items).collect()) == [(5, 0), (5, 2)]


# ---- op7


def plain_grams(text):
    """The n-grams of a text in the simplest way."""
    solid = lambda c: c.isalpha() or unicodedata.category(c) in ("Mn", "Mc")
    points, before = [], False
    for c in (text or "").lower():
        if solid(c) or before:
            points.append(ord(c) if solid(c) else 32)
        before = solid(c)
    for n in (1, 2, 3):
        for k in range(len(points) - n + 1):
            h = 0
            for step, x in enumerate(points[k : k + n], 1):
                h = (h * 0x01000193 + x + step) % 2**32
            yield ((h ^ (h >> 15)) * 0x9E3779B1) % 2**32 >> 16


def plain_languages(rows):
    """{(id, text): (language, score)} by naive Bayes over dictionaries."""
    counts, docs = defaultdict(Counter), Counter()
    for d, text, lang in rows:
        if lang is not None and zlib.crc32(("" if d is None else str(d)).encode()) % 5:
            counts[lang].update(plain_grams(text))
            docs[lang] += 1
    out, size = {}, 1 << 16
    for d, text, _ in rows:
        grams = Counter(plain_grams(text))
        n = sum(grams.values())
        if not any(c.isalpha() for c in text or "") or not docs:
            out[d, text] = ("und", 0.0)
            continue
        logs = {}
        for lang, own in counts.items():
            total = sum(own.values()) + 0.5 * size
            logs[lang] = math.log(docs[lang] / sum(docs.values())) + sum(k * math.log((own[g] + 0.5) / total) for g, k in grams.items())
        best = max(sorted(logs, key=str.encode), key=logs.get)
        weight = 48 / max(n, 48)
        unknown = math.log(0.01) - n * math.log(size)
        out[d, text] = (best, 1 / sum(math.exp(min((x - logs[best]) * weight, 700)) for x in [*logs.values(), unknown]))
    return out


def check_languages(spark, sf):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = plain_languages(rows)
    texts = defaultdict(list)
    for d, t, _ in rows:
        texts[d].append(t)
    got = defaultdict(list)
    for r in queries.op7_language_id(spark, sf).collect():
        got[r.doc_id].append((r.lang_pred, r.score))
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
    assert sum(map(len, got.values())) == len(rows)
    for d, found in got.items():
        for (lang, score), (want_lang, want_score) in zip(sorted(found), sorted(want[d, t] for t in texts[d]), strict=True):
            assert lang == want_lang and score == pytest.approx(want_score, rel=1e-2, abs=1e-9)


def test_op7_against_plain(spark, small, edge, tmp_path):
    check_languages(spark, small)
    more = [(50 + i, t, lang) for i, (t, lang) in enumerate([("हिन्दी में लिखा", "hi"), ("ภาษาไทยที่นี่", "th"), ("\u0301\u0302", "hi"), ("Ωμέγα ΤΕΛΟΣ", "el"), ("x" * 300, "en")] * 3)]
    rows = edge.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(more, "doc_id long, text string, lang string"))
    check_languages(spark, save(rows, tmp_path))


def test_features_of_cut_texts_equal_those_of_whole_ones(monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcéДी़  .1\n漢") for _ in range(rng.randint(0, 60))) for _ in range(60)] + [None, "", "...", "a"]

    def grams():
        found, lettered = Counter(), set()
        for rows, cells, some in langid.features(texts):
            found.update(zip(rows.tolist(), cells.tolist(), strict=True))
            lettered.update(some.tolist())
        return found, lettered

    whole = grams()
    assert whole[0] == Counter((i, g) for i, t in enumerate(texts) for g in plain_grams(t))
    assert whole[1] == {i for i, t in enumerate(texts) if any(c.isalpha() for c in t or "")}
    for block in (1, 2, 3, 7, 20):
        monkeypatch.setattr(langid, "BLOCK", block)
        assert grams() == whole


def test_op7_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_language_id(spark, sf).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = [r for r in got if r.held_out]
    assert len(got) == len(lang) and {r.doc_id for r in out} == {d for d in lang if zlib.crc32(str(d).encode()) % 5 == 0}
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.98 * len(out)
    assert all(0 <= r.score <= 1 for r in got)


def test_op7_edges(spark, edge, empty, tmp_path):
    rows = edge.unionByName(spark.createDataFrame([(100 + i, "le texte est écrit en français ici", "fr", "a", 1) for i in range(9)], "doc_id long, text string, lang string, source string, n_chars long"), allowMissingColumns=True)
    got = queries.op7_language_id(spark, save(rows, tmp_path)).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r.doc_id].append((r.lang_pred, r.score))
    assert len(got) == rows.count()
    assert by_id[3] == by_id[4] == by_id[5] == by_id[6] == [("und", 0.0)]
    assert by_id[100][0][0] == "fr" and max(Counter(by_id[2]).values()) >= 2  # two of its three rows are one text
    assert queries.op7_language_id(spark, save(empty, tmp_path)).count() == 0
    save(edge.withColumn("lang", F.lit(None).cast("string")), tmp_path)
    assert {r.lang_pred for r in queries.op7_language_id(spark, str(tmp_path)).collect()} == {"und"}


def test_long_texts_are_scored_whole(monkeypatch):
    texts = ["abc déf 漢字 x" * 50, None, "", "12", "zz"]
    counts = lambda: Counter((int(r), int(c)) for rows, cells, _ in langid.features(texts) for r, c in zip(rows, cells, strict=True))
    whole = counts()
    monkeypatch.setattr(langid, "BLOCK", 100)
    pieces = counts()
    assert {r for r, _ in whole} == {0, 4} and whole == pieces
    assert sum(len(rows) for rows, _, _ in langid.features([chr(0x10400) * 3])) == 6


# ---- op8


def plain_targets(sizes):
    """Targets by resharing the excess until none is above, in exact fractions."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: Fraction(weight[s] * rest, sum(weight[x] for x in free)) for s in free}
        above = [s for s in free if share[s] > 3 * sizes[s]]
        if not above:
            return {**fixed, **share}
        fixed |= {s: Fraction(3 * sizes[s]) for s in above}


def check_mix(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for r in docs:
        sizes[r.source] += size(r.text)
    want = plain_targets(dict(sizes)) if sizes and sum(sizes.values()) else {}
    got = queries.op8_source_mix(spark, sf).collect()
    assert sorted((str(r.doc_id), r.size) for r in got) == sorted((str(r.doc_id), size(r.text)) for r in docs)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    by_size = Counter((n, round(float(want.get(s, 0)), 6)) for s, n in sizes.items())
    assert {(r.source_size, round(r.target, 6)) for r in got} == set(by_size)
    assert sorted(map(str, got)) == sorted(map(str, queries.op8_source_mix(spark, sf).collect()))
    return got


def test_op8_against_resharing_and_sql(spark, small):
    got = check_mix(spark, small)
    assert abs(sum(r.taken for r in got) / sum(r.size for r in got) - 1) < 0.1
    assert oracle.rows_of(queries.op8_source_mix(spark, small)) == oracle.rows_in(oracle.connect(small), sql.MIXING)


def test_op8_edges(spark, edge, empty, tmp_path):
    check_mix(spark, save(edge, tmp_path))
    assert queries.op8_source_mix(spark, save(empty, tmp_path)).count() == 0


def test_op8_cascading_caps(spark, tmp_path):
    rows = [(i, "w " * n, s, 0) for i, (s, n) in enumerate([("a", 1000), ("b", 3), ("c", 40), ("d", 500), ("e", 90), ("f", 1), (None, 7), ("g", 0)])]
    check_mix(spark, save(spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long"), tmp_path))


def test_emit_repeats_documents(spark):
    rows = [(i, "one two three", "a" if i % 2 else "b") for i in range(400)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    taken = {r.source: r.n for r in mixed.groupBy("doc.source").agg(F.sum("copies").alias("n")).collect()}
    emitted = {r.source: r.n for r in mixing.emit(mixed).groupBy("doc.source").agg(F.count("*").alias("n")).collect()}
    assert taken == emitted and abs(emitted["a"] / (400 / 3) - 1) < 0.2 and abs(emitted["b"] / (800 / 3) - 1) < 0.2


def test_op7_scores_languages_in_blocks(spark, monkeypatch):
    words = {"de": "der die das und nicht", "en": "the and not of", "fr": "le la les et ne pas", "it": "il lo gli che non", "é": "ça là où"}
    rows = [(i, f"{w} {w}", k) for k, w in words.items() for i in range(3 if k == "en" else 2)] + [(9, None, "de"), (9, "1 2", None), (9, "the la", None), (9, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    answers = lambda: sorted((str(r.text), r.lang_pred, round(r.score, 9)) for r in langid.identify(docs, langid.Model.fit(docs.where("lang is not null"))).collect())
    whole = answers()
    assert {x[1] for x in whole} == {*words, langid.UNDETERMINED}
    for most in (4, 2, 1):
        monkeypatch.setattr(langid, "MAX_LANGUAGES", most)
        assert answers() == whole
