"""op2, op9 and op10: exact against plain versions."""

import hashlib
import itertools
import random
import re
from collections import defaultdict

import numpy as np
import oracle
import pytest
import xxhash
from conftest_llm import save
from hypothesis import given, settings
from hypothesis import strategies as st

from standex.llm import graph, line_dedup, queries, simhash, sql, substring_dedup
from standex.llm.common import row_key

# ---- op10


def plain_line_dedup(rows):
    """(doc_id, n_lines, n_dropped, kept_sha256) in the simplest way."""
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    order = lambda d: (d is None, d or 0)
    owners = defaultdict(set)
    for d, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 10:
                owners[key(line)].add(d)
    out = []
    for d, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or min(owners[key(x)], key=order) == d]
        out.append((str(d), len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def check_lines(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op10_line_dedup(spark, sf).collect()
    assert sorted((str(r.doc_id), r.n_lines, r.n_dropped, r.kept_sha256) for r in got) == plain_line_dedup(rows)


def test_op10_against_sql(spark, small):
    assert oracle.rows_of(queries.op10_line_dedup(spark, small)) == oracle.rows_in(oracle.connect(small), sql.LINE_DEDUP)


def test_op10_edges(spark, edge, empty, tmp_path):
    check_lines(spark, save(edge, tmp_path))
    assert queries.op10_line_dedup(spark, save(empty, tmp_path)).count() == 0


def test_op10_hot_line_over_many_partitions(spark, tmp_path):
    rows = [(i, "a very common line\n" + (f"line of its own {i}\n" if i % 3 else "") + "a very common line") for i in range(3000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        check_lines(spark, save(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_settle_follows_a_hash_through_partitions():
    h, k = (1, 1), (2, 2)
    rows = [(0, 0, *h, 5), (0, 1, *h, 5), (1, 0, *h, 8), (1, 1, *h, 8), (3, 0, *h, 9), (3, 1, *k, 4), (4, 0, *k, 6), (4, 1, *k, 6), (5, 0, 7, 7, 1), (5, 1, 7, 7, 1)]
    assert line_dedup.settle(rows) == {1: 5, 3: 5, 4: 4}


@given(st.sets(st.integers(0, 70), min_size=1))
@settings(max_examples=50, deadline=None)
def test_bitmap_round_trip(dropped):
    text = b"\n".join(b"%d" % i for i in range(71))
    n, m, kept = line_dedup.cut(text, line_dedup.bitmap(np.array(sorted(dropped))))
    assert (n, m) == (71, len(dropped)) and kept == b"\n".join(b"%d" % i for i in range(71) if i not in dropped)


# ---- op9


def plain_fingerprint(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", words)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_classes(rows, distance=4):
    """(doc_id, fingerprint, component_id) by comparing all pairs of distinct fingerprints."""
    fps = [plain_fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    parent = {f: f for f in distinct}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= distance:
            parent[find(a)] = find(b)
    least = {}
    for (d, _), f in zip(rows, fps, strict=True):
        if d is not None:
            least[find(f)] = min(least.get(find(f), d), d)
    return sorted((str(d), f"{f:016x}", str(least.get(find(f)))) for (d, _), f in zip(rows, fps, strict=True))


def check_simhash(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op9_simhash(spark, sf).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == plain_classes(rows)


def test_op9_against_all_pairs(spark, small):
    check_simhash(spark, small)


def test_op9_edges(spark, edge, empty, tmp_path):
    check_simhash(spark, save(edge, tmp_path))
    assert queries.op9_simhash(spark, save(empty, tmp_path)).count() == 0


@pytest.mark.parametrize(("blocks", "run"), [(6, 20_000), (7, 20_000), (9, 5), (6, 3)])
def test_links_lose_nothing(spark, blocks, run):
    rng = random.Random(1)
    seeds = [rng.getrandbits(64) for _ in range(15)]
    fps = {s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 6))) for s in seeds for _ in range(12)} | {0, 2**64 - 1, 2**63}
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    found = simhash.links(spark.createDataFrame(signed, "fp long"), blocks=blocks, run=run).collect()
    assert all(((r.src ^ r.dst) & (2**64 - 1)).bit_count() <= 4 for r in found)

    def classes(pairs):
        parent = {f: f for (f,) in signed}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[find(a)] = find(b)
        groups = defaultdict(set)
        for f in parent:
            groups[find(f)].add(f)
        return {frozenset(g) for g in groups.values()}

    every = [(a, b) for (a,), (b,) in itertools.combinations(signed, 2) if ((a ^ b) & (2**64 - 1)).bit_count() <= 4]
    assert classes((r.src, r.dst) for r in found) == classes(every)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, 1000 + i) for i in range(1, 60)] + [(7, 7), (2000, 2001), (2001, 2000)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert {got[i] for i in range(1, 51)} == {0} and {got[1000 + i] for i in range(1, 60)} == {1000} and got[2001] == 2000


# ---- near duplicates of a similarity (the pipeline's)


def plain_bits(hashes):
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes))


def plain_mixed(h, i):
    top = 2**64 - 1
    z = (h + (i + 1) * 0x9E3779B97F4A7C15) & top
    z = ((z ^ (z >> 30)) * 0xBF58476D1CE4E5B9) & top
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & top
    return z ^ (z >> 31)


def plain_similar(rows, distance=4, wide=167):
    """The classes, as sets of ids, by comparing all pairs of texts."""
    found = {}
    for _, text in rows:
        w = (text or "").translate({i: i + 32 for i in range(65, 91)})
        w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", w)]
        words = [xxhash.xxh3_64_intdigest(x, 42) for x in set(w)]
        shingles = [xxhash.xxh3_64_intdigest(x, 42) for x in {b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}]
        if w:
            found.setdefault(text, ([plain_bits([plain_mixed(h, i) for h in words]) for i in range(4)], [plain_bits([plain_mixed(h, i) for h in shingles]) for i in range(16)]))
        else:
            found.setdefault(text, ([0] * 4, [0] * 16))
    parent = {t: t for t in found}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(found, 2):
        (va, wa), (vb, wb) = found[a], found[b]
        if any((x ^ y).bit_count() <= distance for x, y in zip(va, vb, strict=True)) and sum((x ^ y).bit_count() for x, y in zip(wa, wb, strict=True)) <= wide:
            parent[find(a)] = find(b)
    groups = defaultdict(set)
    for d, t in rows:
        groups[find(t)].add(d)
    return list(groups.values())


def some_near_texts(n):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    rows = []
    for base in range(n):
        words = [word() for _ in range(rng.randint(30, 200))]
        for copy in range(6):
            own = list(words)
            for _ in range(copy * len(own) // 100):
                own[rng.randrange(len(own))] = word()
            rows.append((6 * base + copy, " ".join(own)))
    return [*rows, (1000, None), (1001, ""), (1002, " \t"), (1003, rows[0][1]), (1004, rows[0][1].upper()), (1005, "one two"), (1006, "One  two\n")]


@pytest.mark.parametrize("run", [20_000, 3])
def test_similar_classes_against_all_pairs(spark, monkeypatch, run):
    monkeypatch.setattr(simhash, "RUN", run)
    rows = some_near_texts(25)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(row_key())
    groups = defaultdict(set)
    for r in simhash.similar_classes(docs).collect():
        groups[r["class"]].add(r.doc_id)
    want = {frozenset(x) for x in plain_similar(rows)}
    assert {frozenset(x) for x in groups.values()} == want and max(map(len, want)) >= 5
    assert frozenset({1000, 1001, 1002}) in want and frozenset({1005, 1006}) in want


# ---- op2


def plain_units(text):
    """(normalised sentence, start, end) in the simplest way."""
    at = 0
    for line in text.split("\n"):
        start = at
        for k, c in enumerate(line):
            ends = c in ".!?" or line[start - at : k].rstrip().rstrip("\"')]")[-1:] in (".", "!", "?")
            follows = line[k + 1 : k + 2]
            inside = c in ".!?\"')]" or c.isspace()
            if ends and inside and not (follows and (follows in ".!?" and c in ".!?" or follows in "\"')]" and c in ".!?\"')]" or follows.isspace())):
                yield text[start : at + k + 1], start, at + k + 1
                start = at + k + 1
        if start < at + len(line):
            yield text[start : at + len(line)], start, at + len(line)
        at += len(line) + 1


def plain_substring(rows, least=20):
    """Repeats of whole sentences in one pass over the documents in order; runs of at least so many words go."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    seen, keep = {}, []
    for i in order:
        for unit, _, _ in plain_units(rows[i][1] or ""):
            seen.setdefault(" ".join(unit.lower().split()), rows[i][0])
    for d, text in rows:
        own, spans, run, n, removed = set(), [], [], 0, 0
        for unit, a, b in [*plain_units(text or ""), ("end of all", -1, -1)]:
            name = " ".join(unit.lower().split())
            if not name:
                continue
            if a >= 0 and (name in own or seen[name] != d):
                run, n = [*run, (a, b)], n + len(name.split())
            else:
                if n >= least:
                    spans.append((run[0][0], run[-1][1]))
                    removed += len(run)
                run, n = [], 0
            own.add(name)
        kept, at = "", 0
        for a, b in spans:
            kept, at = kept + text[at:a], b
            if (a == 0 or text[a - 1] == "\n") and text[b : b + 1] == "\n":
                at += 1
        keep.append((str(d), removed, ",".join(f"{a}-{b}" for a, b in spans), hashlib.sha256((kept + (text or "")[at:]).encode()).hexdigest()))
    return sorted(keep)


def check_substring(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op2_substring_dedup(spark, sf).collect()
    assert sorted((str(r.doc_id), r.n_removed, r.removed_spans, r.kept_sha256) for r in got) == plain_substring(rows)


def test_op2_against_plain_and_sql(spark, small):
    check_substring(spark, small)
    assert oracle.rows_of(queries.op2_substring_dedup(spark, small)) == oracle.rows_in(oracle.connect(small), sql.SUBSTRING_DEDUP)


def test_op2_exact_setting_removes_every_repeat(spark, edge, small):
    for docs in (spark.read.parquet(f"{small}/documents.parquet"), edge):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = substring_dedup.dedup(docs.select("doc_id", "text"), least=1).collect()
        spans = lambda r: ",".join(f"{s.start}-{s.end}" for s in r.spans)
        digest = lambda r: hashlib.sha256((r.text or "").encode()).hexdigest()
        assert sorted((str(r.doc_id), r.n_removed, spans(r), digest(r)) for r in got) == plain_substring(rows, 1)


def test_texts_that_lose_nothing_are_not_shuffled(spark, small):
    """With broadcasts off, exchanges of texts come after a filter by the bitmap alone."""
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for made in (substring_dedup.dedup(docs), line_dedup.with_bitmaps(docs, line_dedup.keep_bitmaps(docs))):
            plan = made._jdf.queryExecution().optimizedPlan().toString()
            union = plan[plan.index("Union") :]
            assert "isnull(" in union or "NOT coalesce(" in union or "NOT _sx_hit" in union
            assert union.count("Join LeftOuter") == 3  # two with the bitmap, which is broadcast, and one with what it lets through
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_op2_edges(spark, edge, empty, tmp_path):
    check_substring(spark, save(edge, tmp_path))
    assert queries.op2_substring_dedup(spark, save(empty, tmp_path)).count() == 0


def test_op2_finds_a_passage_inside_a_paragraph(spark, tmp_path):
    passage = " ".join(f"Sentence number {w} holds some ten or more words of its own." for w in ("one", "two", "three", "four", "five"))
    rows = [(1, f"Before it something else stands here for once. {passage} And after."), (2, passage), (3, f"Quite another begin of words, {passage} The end of this.")]
    sf = save(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)
    got = {r.doc_id: r for r in queries.op2_substring_dedup(spark, sf).collect()}
    assert got[1].n_removed == 0 and got[2].n_chars_kept == 0 and got[3].n_chars_kept < 110
    for span in got[3].removed_spans.split(","):
        a, b = map(int, span.split("-"))
        assert rows[2][1][a:b].strip() in passage


def test_paragraph_units():
    text = "one two three\nfour five\n\nsix seven eight"
    assert [(a, b, n) for _, a, b, n in substring_dedup.units(text, paragraphs=True)] == [(0, 24, 5), (25, 40, 3)]


def test_op2_leaves_short_repeats_and_takes_passages_of_short_sentences(spark, tmp_path):
    short = "All rights reserved."
    passage = " ".join(f"It was {w} then." for w in "cold warm dark light late soon wet dry loud calm far near new".split())
    rows = [(1, f"One text.\n{short}"), (2, f"Another text.\n{short}"), (3, f"Some words before. {passage} Some words after."), (4, f"Words of a fourth kind. {passage} The end of four.")]
    sf = save(spark.createDataFrame(rows, "doc_id long, text string"), tmp_path)
    got = {r.doc_id: (r.n_removed, r.n_chars_kept) for r in queries.op2_substring_dedup(spark, sf).collect()}
    assert got[1][0] == got[2][0] == got[3][0] == 0 and got[4] == (13, len(rows[3][1]) - len(passage) - 1)


def test_op9_a_large_class_is_split(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 5)
    sf = save(spark.createDataFrame(some_near_texts(12), "doc_id long, text string"), tmp_path)
    check_simhash(spark, sf)


def test_clashing_names_are_refused(spark):
    with pytest.raises(ValueError, match="fp"):
        simhash.fingerprints(spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, fp long"))
