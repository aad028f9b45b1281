"""Spelling variants: words one edit apart, grouped by which is the commoner.

counted(): words with their number of occurrences, added up before the shuffle.

near(): pairs of words that differ by exactly one inserted, deleted or replaced code point. One edit leaves
the first half of a word or the last as it was. So each word is filed by its halves, once as the shorter
word of a pair and once as the longer, and words with an equal half meet in one sorted run. Over what
is left of a run's words, a positional index of q-grams (two code points, the ends marked) is built: gram,
position and length to an ascending list of words. A word's own lists, of lengths and positions that one edit
allows, are merged by a heap. Of g grams, one replacement leaves g - 2 and one insertion g - 1 (the bound).
A word on fewer than all but bound - 1 of the lists can't reach it, so only the shortest lists are merged
and the others searched for what they hold; pairs at the bound are verified. Each pair is put out once:
by its first half if that is equal, else by its last. Runs of more than RUN words are dealt out as pairs
of chunks, so that a task's index stays bounded and no pair is lost.

grouped(): a word's form is the near word that occurs most often, if at least RATIO times as often as the word;
of equal ones the first in code-point order. Occurrences grow by RATIO along a chain of forms, so that it
has no circle and fewer than 64 words; roots are found by doubling, in six rounds or fewer.

Defined results: null and empty texts have no words; a null doc_id changes nothing here; repeated rows count as
often as they are there; words and texts of any length are taken whole (halves are compared by hash first,
so that a long word costs its own length). Empty tables, and tables without a word that is long and common enough,
give no rows. Further columns of the input are not looked at.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, stored

#: Fixed value: what a word is made of.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least code points and occurrences of a word, and how many times as often its form must occur.
LENGTH, COUNT, RATIO = 5, 3, 2
#: Words that a single task indexes at once.
RUN = 10_000
#: Rows of a batch that is put out.
OUT = 10_000


def runs(docs: DataFrame, least: int = LENGTH) -> DataFrame:
    """(doc_id, run): maximal runs of letters of at least `least` code points, with A-Z lower-cased."""
    low = F.translate(F.coalesce("text", F.lit("")), UPPER, LOWER)
    return docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit(f"([{LETTERS}]{{{least},}})"), F.lit(1))).alias("run"))


def counted(words: DataFrame, word: Column, length: int = LENGTH, count: int = COUNT) -> DataFrame:
    """(word, n) of the words that are long and common enough."""
    of = words.select(word.alias("word")).where(F.length("word") >= length)
    return of.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= count)


def one_edit(a: str, b: str) -> bool:
    """Whether b, which isn't shorter than a, comes from a by exactly one edit."""
    if a == b or len(b) - len(a) > 1:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[at + (len(a) == len(b)) :] == b[at + 1 :]


def _grams(rest: str) -> list[tuple[int, str]]:
    marked = f"\x00{rest}\x01"
    return [(i, marked[i : i + 2]) for i in range(len(marked) - 1)]


def merge(words: list[str], shorter: int, first: bool) -> Iterator[tuple[int, int]]:
    """Places (x, y) of words that are one edit apart, x of length `shorter` and y of that or one more, all of
    which have the first half (else the last) of that length in common."""
    half = shorter // 2
    index: defaultdict[tuple[int, int, str], list[int]] = defaultdict(list)

    def grams(word: str) -> list[tuple[int, str]]:
        return _grams(word[half:] if first else word[: len(word) - shorter + half])

    for y, word in enumerate(words):
        if len(word) > shorter:
            for at, gram in grams(word):
                index[1, at, gram].append(y)
    for x, word in enumerate(words):
        if len(word) > shorter:
            continue
        own = grams(word)
        for longer in (0, 1):
            bound = len(own) - 2 + longer
            # a gram behind an insertion stands one further
            lists = [[p for to in range(at, at + longer + 1) if (p := index.get((longer, to, gram)))] for at, gram in own]
            lists.sort(key=lambda parts: sum(map(len, parts)))
            few = len(own) - bound + 1
            for y, same in groupby(heapq.merge(*[p for parts in lists[:few] for p in parts])):
                shared, left = sum(1 for _ in same), len(lists) - few
                for parts in lists[few:]:
                    if shared >= bound or shared + left < bound:
                        break
                    shared += any((i := bisect_left(p, y)) < len(p) and p[i] == y for p in parts)
                    left -= 1
                if shared >= bound and one_edit(word, words[y]) and first == (word[:half] == words[y][:half]):
                    yield x, y
        for at, gram in own:
            index[0, at, gram].append(x)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (key, low, high, chunk, shorter, first, word, n) sorted by run: each pair both ways."""
    names = ["word", "near", "near_n"]
    out: list[tuple[str, str, int]] = []
    each = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
    for (_, low, high), run in groupby(each, itemgetter(0, 1, 2)):
        rows = list(run)
        if len(rows) < 2:
            continue
        words = [r[6] for r in rows]
        for x, y in merge(words, rows[0][4], rows[0][5]):
            if low == high or rows[x][3] != rows[y][3]:
                out += [(words[x], words[y], rows[y][7]), (words[y], words[x], rows[x][7])]
        if len(out) >= OUT:
            yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out, strict=True), strict=True)))
            out = []
    if out:
        yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*out, strict=True), strict=True)))


def near(words: DataFrame, run: int = RUN) -> DataFrame:
    """(word, near, near_n) for each ordered pair of near words of (word, n), in which each word is there once."""
    n, half = F.length("word"), F.floor(F.col("shorter") / 2).cast("int")
    key = F.when(F.col("first"), F.substr("word", F.lit(1), half)).otherwise(F.substr("word", n - F.col("shorter") + half + 1))
    filed = words.select("word", "n", F.explode(F.array(n, n - 1)).alias("shorter"))
    filed = filed.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("first"))
    filed = filed.withColumn("key", F.xxhash64("first", "shorter", key))
    hot = filed.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > run)
    hot = stored(hot.select("key", F.ceil(2 * F.col("rows") / run).cast("int").alias("parts")), "hot")
    if hot.isEmpty():
        dealt = filed.withColumns({c: F.lit(0) for c in ("low", "high", "chunk")})
    else:
        parts = F.coalesce("parts", F.lit(1))
        dealt = filed.join(hot, "key", "left").withColumn("chunk", F.pmod(F.xxhash64("word"), parts).cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        dealt = dealt.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")})
    run_of = ["key", "low", "high"]
    dealt = dealt.select(*run_of, "chunk", "shorter", "first", "word", "n")
    return dealt.repartition(*run_of).sortWithinPartitions(*run_of, "word").mapInArrow(_merged, "word string, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last of the chain of forms that begins at a word. A form is pointed to
    by its near words alone, so no key of these joins is hot."""
    links = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_sx_next"))
        further = links.join(onward, "root", "left").select("word", F.coalesce("_sx_next", "root").alias("root"), F.col("_sx_next").isNotNull().alias("_sx_moved"))
        further = materialise(further)
        if further.where("_sx_moved").isEmpty():
            return links
        links = further.drop("_sx_moved")


def grouped(words: DataFrame, ratio: int = RATIO, run: int = RUN) -> DataFrame:
    """(word, n) with n_near, form, form_n and root; words is read several times, so give a table."""
    best = near(words, run).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    of = words.join(best, "word", "left")
    form_n = -F.col("best.less")
    enough = form_n >= ratio * F.col("n")
    of = of.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, form_n).alias("form_n"),
    )
    of = materialise(of)
    found = roots(of.where("form is not null"))
    return of.join(found, "word", "left").withColumn("root", F.coalesce("root", "word"))
