"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

1. Words are maximal runs of digits, letters a-z (A-Z in lower case) and non-ASCII characters.
   An item's windows are its runs of 13 words; an item of fewer words is one window.
2. The index is a table of postings (term, document, position) of every occurrence of any window's
   word in the training documents, written once; texts aren't read again. It is kept in the order of the
   documents, so that it is written without a shuffle and a document costs a few bytes a posting. Each
   document has one more posting, of the empty word, at its end: its number of words.
3. The postings are counted by term, and each window's words are ranked from the rarest.
4. Lists are intersected from the rarest. A document is seen as ranges of 2 x SPAN words, one beginning
   every SPAN words, so whatever stands within SPAN words is whole in one range. The postings of each
   window's ANCHORS rarest words meet by document, window and range: ranges that lack one are out. For
   the ranges left, the postings of all the window's words are read.
5. Exact phrases: the list of each word, shifted by its offset in the window, is intersected with
   what the rarer words left. Proximity: all words of the window stand, in any order, within SPAN
   words. A range holds at most 2 x SPAN positions, so neither depends on the document's length.

No list of a term is ever gathered: postings are dealt out by document and range. The benchmark's side is
broadcast only up to BOUND bytes, else joined by shuffle. The ranges that step 4 leaves grow with the corpus,
so they are joined by shuffle; before it, postings are held against two bitmaps of SLOTS bits (of the
documents and of the ranges left, by hash), which are broadcast and of a fixed size. Bits set by others
let postings through that the join then drops.

Defined results: null texts have no words, and items without words no windows. Items of null id count for
n_hit but are not listed. Repeated documents and items change nothing but the number of rows. Ties among a
window's words go to the earlier one and change no result. Texts of any length are indexed whole. With an
empty benchmark no word is hit. Extra columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, NULL_ID, ROW, drop_folder, materialise, only_of, row_key, shared_folder, stored

LENGTH = 13
ANCHORS = 2
#: Words within which a window's words must stand to be near each other.
SPAN = 2 * LENGTH
#: Bytes that may be broadcast.
BOUND = 64 << 20
#: Files that the benchmark's tables are kept in at least, and items of a file.
FILES, ITEMS = 8, 10_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Word characters are 0-9, A-Z, a-z and all non-ASCII ones, as a class that the regex engine tests fast.
BREAK = r"[^\p{Alnum}[^\x00-\x7F]]+"
#: The term of the posting that ends a document.
END = ""


def lowered(x: Column) -> Column:
    return F.translate(x, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words in order, A-Z in lower case."""
    return F.array_remove(F.split(lowered(text), BREAK), "")


def _small(df: DataFrame, size: int) -> DataFrame:
    return F.broadcast(df) if size <= BOUND else df


def windows(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """(window, item_id, n, words) of every item; equal windows of different items are apart."""
    cut = items.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - length + 1, F.lit(1)))
    own = cut.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, length))).alias("words")).distinct()
    return own.select(F.xxhash64("item_id", "words").alias("window"), "item_id", F.size("words").alias("n"), "words")


def index(docs: DataFrame, vocabulary: DataFrame, size: int) -> tuple[DataFrame, str]:
    """The postings (doc_id, KEY, pos, term) of the vocabulary (word) and the folder they are kept in. A
    term is its word's hash."""
    wanted = _small(vocabulary.select("word", F.xxhash64("word").alias("term")), size)
    ended = F.concat(F.coalesce(words(F.col("text")), F.array().cast("array<string>")), F.array(F.lit(END)))
    each = docs.select("doc_id", row_key()[KEY[1]].alias(KEY[1]), F.posexplode(ended).alias("pos", "word"))
    uri = shared_folder(docs.sparkSession, "postings")
    each.join(wanted, "word").select("doc_id", KEY[1], "pos", "term").write.parquet(uri)
    kept = docs.sparkSession.read.parquet(uri)
    return kept.withColumn(KEY[0], F.coalesce("doc_id", F.lit(NULL_ID))), uri


def ranked(wins: DataFrame, postings: DataFrame) -> DataFrame:
    """(window, a, term, offsets, need): a window's distinct words, a = 0 for the rarest in the index, with
    all places in the window; need is how many there are."""
    counts = postings.groupBy("term").agg(F.count("*").alias("cf"))
    each = wins.select("window", F.posexplode("words").alias("offset", "word"))
    own = each.groupBy("window", F.xxhash64("word").alias("term")).agg(F.array_sort(F.collect_set("offset")).alias("offsets"))
    rated = own.join(counts, "term", "left")
    every = Window.partitionBy("window")  # of at most LENGTH rows
    order = every.orderBy(F.coalesce("cf", F.lit(0)), F.element_at("offsets", 1))
    return rated.select("window", (F.row_number().over(order) - 1).alias("a"), "term", "offsets", F.count("*").over(every).cast("int").alias("need"))


def in_ranges(postings: DataFrame, span: int) -> DataFrame:
    """Each posting once for each of the two ranges that hold it."""
    own = F.floor(F.col("pos") / span).cast("int")
    return postings.withColumn("range", F.explode(F.array(own - 1, own)))


def matches(postings: DataFrame, wins: DataFrame, anchors: int = ANCHORS, span: int = SPAN) -> DataFrame:
    """(KEY, window, item_id, n, starts, near) of the documents' ranges that have all words of a window:
    the starts of its exact occurrences (in the first half of the range, so none is found twice), and
    whether all its words stand within span words."""
    order = stored(ranked(wins, postings), "ranked")
    bits = F.bit_or(F.expr("shiftleft(1, a)"))
    heads = order.where(F.col("a") < anchors).select("window", "a", "term", F.least("need", F.lit(anchors)).alias("least"))
    met = in_ranges(postings.join(_small(heads, heads.count() * ROW), "term"), span)
    met = met.groupBy(*KEY, "window", "range").agg(bits.alias("bits"), F.first("least").alias("least"))
    left = stored(met.where(F.col("bits") == F.expr("shiftleft(1, least)") - 1).select(*KEY, "window", "range"), "ranges")
    terms = order.groupBy("window").agg(F.array_sort(F.collect_list(F.struct("a", "term", "offsets"))).alias("terms"))
    near_by = only_of(in_ranges(only_of(postings, left, *KEY), span), left, *KEY, "range")
    met = near_by.join(left, [*KEY, "range"]).select(*KEY, "range", "window", "term", "pos")
    words_of = order.select("window", "term")
    found = met.join(_small(words_of, words_of.count() * ROW), ["window", "term"])
    own = found.groupBy(*KEY, "window", "range").agg(F.collect_set(F.struct("term", "pos")).alias("posts"))
    whole = own.join(terms, "window").join(wins.select("window", "item_id", "n"), "window")
    distinct = F.size(F.array_distinct(F.transform("posts", lambda p: p["term"])))
    whole = whole.where(distinct == F.size("terms"))

    def of(term: Column) -> Column:
        return F.transform(F.filter("posts", lambda p: p["term"] == term), lambda p: p["pos"])

    # each word's list, shifted, against what the rarer ones left; a word that a window has twice counts twice
    places = F.flatten(F.transform("terms", lambda t: F.transform(t["offsets"], lambda o: F.struct(t["term"].alias("term"), o.alias("o")))))
    shifted = lambda t: F.transform(of(t["term"]), lambda p: p - t["o"])
    rest = F.slice("places", 2, F.size("places"))
    whole = whole.withColumn("places", places)
    starts = F.aggregate(rest, shifted(F.element_at("places", 1)), lambda acc, t: F.array_intersect(acc, shifted(t)))
    starts = F.filter(starts, lambda s: (s >= F.col("range") * span) & (s < (F.col("range") + 1) * span))
    within = lambda t, s: F.exists("posts", lambda p: (p["term"] == t["term"]) & (p["pos"] >= s) & (p["pos"] < s + span))
    near = F.exists("posts", lambda first: F.forall("terms", lambda t: within(t, first["pos"])))
    return whole.select(*KEY, "window", "item_id", "n", starts.alias("starts"), near.alias("near"))


def _indexed(docs: DataFrame, items: DataFrame, length: int) -> tuple[DataFrame, DataFrame, str]:
    """(windows, postings, their folder)."""
    files = max(FILES, items.count() // ITEMS)
    wins = stored(windows(items, length).coalesce(files), "windows")
    vocabulary = wins.select(F.explode("words").alias("word")).distinct()
    vocabulary = stored(vocabulary.unionByName(docs.sparkSession.createDataFrame([(END,)], "word string")).coalesce(files), "vocabulary")
    size = vocabulary.agg(F.sum(F.octet_length("word") + ROW)).first()[0]
    return wins, *index(docs, vocabulary, size)


def phrase_matches(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """(KEY, window, start, n) of every exact occurrence of a window of the items in a document."""
    wins, postings, _ = _indexed(docs, items, length)
    return matches(postings, wins, span=2 * length).select(*KEY, "window", F.explode("starts").alias("start"), "n")


def proximity_matches(docs: DataFrame, items: DataFrame, span: int = SPAN, length: int = LENGTH) -> DataFrame:
    """(KEY, window) where all of a window's words stand, in any order, within span words (at least as
    many as a window has)."""
    wins, postings, _ = _indexed(docs, items, length)
    return matches(postings, wins, span=max(span, length)).where("near").select(*KEY, "window").distinct()


def contamination(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, KEY, n_words, n_hit, items, contaminated, near), one row a document: items are the ids, as
    sorted strings, of those with an occurring window, near how many have a window whose words are near.

    The index and what it was asked are dropped at the end; the rows are checkpointed."""
    spark = docs.sparkSession
    wins, postings, folder = _indexed(docs, items, length)
    found = matches(postings, wins, span=2 * length)
    # sets of (start, length) and of items: no larger than the document or the benchmark
    spans = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("starts", lambda s: F.struct(s.alias("start"), F.col("n").alias("n")))))))
    own = found.groupBy(*KEY).agg(
        spans.alias("spans"), F.collect_set(F.when(F.size("starts") > 0, F.col("item_id"))).alias("ids"),
        F.count_distinct(F.when(F.col("near"), F.col("item_id"))).alias("near"),
    )
    zero = F.struct(F.lit(0).alias("upto"), F.lit(0).alias("hit"))

    def add(acc: Column, x: Column) -> Column:
        end = x["start"] + x["n"]
        more = F.greatest(end - F.greatest(x["start"], acc["upto"]), F.lit(0))
        return F.struct(F.greatest(acc["upto"], end).alias("upto"), (acc["hit"] + more).alias("hit"))

    hit = F.aggregate("spans", zero, add, lambda acc: acc["hit"].cast("long"))
    ids = F.array_sort(F.transform("ids", lambda x: x.cast("string")))
    hits = own.select(*KEY, hit.alias("n_hit"), ids.alias("items"), "near")
    ends = postings.where(F.col("term") == F.xxhash64(F.lit(END))).select("doc_id", *KEY, F.col("pos").cast("long").alias("n_words"))
    out = materialise(ends.join(hits, list(KEY), "left"))
    drop_folder(spark, folder)
    out = out.withColumns({
        "n_hit": F.coalesce("n_hit", F.lit(0)).cast("long"), "items": F.coalesce("items", F.array().cast("array<string>")),
        "near": F.coalesce("near", F.lit(0)).cast("long"),
    })
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))
