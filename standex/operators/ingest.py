"""Raw lines to standards, standards to overlapping chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..functions import lexicons as lex
from ..sources.shared import stored
from . import ordinals

CORE, WINDOW, STRIDE = 600, 1200, 800
#: Rows of one block of a running sum.
BLOCK = 2_000


def lines_of(pages: DataFrame, body: str = "text") -> DataFrame:
    """(src_id, page_no, line_no, line) of (src_id, page_no, text): stripped, blank lines out."""
    each = pages.select("src_id", "page_no", F.posexplode(F.split(body, "\n")).alias("line_no", "raw"))
    return each.select("src_id", "page_no", "line_no", text.strip(F.col("raw")).alias("line")).where(F.length("line") > 0)


def running_offset(df: DataFrame, key: str, value: Column) -> DataFrame:
    """df with `offset`: the sum of value over all rows with a smaller key (a dense integer).

    Blocks of keys are summed first; only one row a block goes through a single-partition window."""
    blocked = df.withColumn("_block", F.floor(F.col(key) / BLOCK)).withColumn("_value", value)
    sums = blocked.groupBy("_block").agg(F.sum("_value").alias("_sum"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_block", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy("_block").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    joined = blocked.join(starts, "_block").withColumn("offset", F.col("_start") + F.coalesce(F.sum("_value").over(within), F.lit(0)))
    return joined.drop("_block", "_value", "_start")


def segment(lines: DataFrame) -> DataFrame:
    """Standards of (src_id, page_no, line_no, line): (src_id, seg, id, title, text).

    Each line that mentions an identifier begins a standard; lines before a source's first are dropped, as
    are standards of 20 characters or fewer. A segmented scan: the lines are dealt out by ranges of (source, page, line) and
    written once, so a source may lie in any number of ranges; each range counts the standards that begin in it, and
    what begins in a source's earlier ranges is carried over. Only a standard's own lines meet in one row."""
    marked = lines.select("src_id", "page_no", "line_no", "line", F.col("line").rlike(ids.LINE_ID).cast("int").alias("is_start"))
    dealt = stored(marked.repartitionByRange("src_id", "page_no", "line_no").withColumn("range", F.spark_partition_id()), "lines")
    counts = dealt.groupBy("src_id", "range").agg(F.sum("is_start").alias("n"))  # a row for each range of a source
    before = Window.partitionBy("src_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    carried = counts.select(F.col("src_id").alias("of"), F.col("range").alias("at"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("carried"))
    own = Window.partitionBy("src_id", "range").orderBy("page_no", "line_no").rowsBetween(Window.unboundedPreceding, 0)
    joined = dealt.join(carried, (F.col("range") == F.col("at")) & F.col("src_id").eqNullSafe(F.col("of")))
    numbered = joined.withColumn("seg", F.col("carried") + F.sum("is_start").over(own))
    row = F.struct("page_no", "line_no", "line")
    made = numbered.where("seg > 0").groupBy("src_id", "seg").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    first = F.element_at("rows", 1)["line"]
    found = text.strip(F.regexp_replace(text.strip(F.regexp_extract(first, ids.LINE_ID, 1)), r"[:\-]+$", ""))
    joined = F.array_join(F.transform("rows", lambda r: r["line"]), " ")
    out = made.select("src_id", "seg", first.alias("line"), found.alias("id"), joined.alias("text"))
    title = F.btrim(F.replace(F.col("line"), F.col("id"), F.lit("")), F.lit(": -"))
    return out.where(F.length(text.strip(F.col("text"))) > 20).select("src_id", "seg", "id", title.alias("title"), "text")


def number_standards(standards: DataFrame) -> DataFrame:
    """standards with std_seq: 0, 1, ... in order of (src_id, seg). The keys alone are sorted."""
    keys = ordinals.numbered(standards.select(F.col("src_id").alias("of"), F.col("seg").alias("at")), ["of", "at"], "std_seq")
    joined = standards.join(keys, F.col("src_id").eqNullSafe(F.col("of")) & (F.col("seg") == F.col("at")))
    return joined.select(F.col("std_seq").cast("long").alias("std_seq"), "id", "title", "text")


def category_of(x: Column) -> Column:
    """Category with the most distinct keywords in the text, the first on ties; 'general' below two."""
    best = text.let(F.lower(x), lambda low: text.first_best([(c, F.size(text.found(k, low))) for c, k in lex.CATEGORY_KEYWORDS.items()], 2))
    return F.coalesce(best, F.lit("general"))


def keywords_of(x: Column, category: Column) -> Column:
    """The category, its own terms, other categories' terms, nouns; each once."""
    none = F.array().cast("array<string>")

    def of(low: Column, own: Column) -> Column:
        mine = [F.when(own == c, text.found(t, low)).otherwise(none) for c, t in lex.TECHNICAL_TERMS.items()]
        others = [F.when(own != c, text.found(t, low)).otherwise(none) for c, t in lex.TECHNICAL_TERMS.items()]
        head = F.when(own != "general", F.array(own)).otherwise(none)
        return F.array_distinct(F.concat(head, *mine, *others, text.found(lex.DOMAIN_NOUNS, low)))

    return text.let(F.lower(x), lambda low: text.let(category, lambda own: of(low, own)))


def chunk_count() -> Column:
    """How many chunks a standard's text makes."""
    return (F.lit(2) + F.ceil(F.greatest(F.length("text") - CORE, F.lit(0)) / STRIDE)).cast("long")


def described(standards: DataFrame) -> DataFrame:
    """Standards with category and keys (their keywords)."""
    base = standards.withColumn("category", category_of(F.col("text")))
    return base.withColumn("keys", keywords_of(F.col("text"), F.col("category")))


def cut(base: DataFrame) -> DataFrame:
    """Chunks of described standards (id, title, text, category, keys, ...), numbered by k within their standard:
    an anchor, a core of 600 characters, and windows of 1,200 characters every 800 over the rest. Further columns
    stay. Rows are independent, so a stream is cut as a table is."""
    length = F.length("text")
    others = [c for c in base.columns if c not in ("id", "title", "text", "category", "keys")]
    anchor = F.concat_ws(
        " ", text.full(F.col("id")), text.full(F.col("title")), F.when(F.col("category") != "general", F.col("category")),
        text.full(F.array_join(F.slice("keys", 1, 15), " ")),
    )
    # texts are cut after the rows are made, so that none is where only its place is asked for
    windows = F.ceil(F.greatest(length - CORE, F.lit(0)) / STRIDE).cast("int")
    each = base.select(*others, "id", "title", "category", "keys", F.col("text").alias("_body"), F.explode(F.sequence(F.lit(0), windows + 1)).alias("k"))
    first = F.col("k") == 0
    window = F.concat_ws(" ", F.col("id"), F.coalesce("title", F.lit("")), F.substr("_body", CORE + 1 + (F.col("k") - 2) * STRIDE, F.lit(WINDOW)))
    each = each.withColumn("text", F.when(first, anchor).when(F.col("k") == 1, F.substring("_body", 1, CORE)).otherwise(window))
    return each.select(
        *others, "k", "id", "title", "text", "category",
        F.when(first, F.slice("keys", 1, 20)).otherwise(F.slice("keys", 1, 10)).alias("keywords"),
        ids.part(F.col("id")).alias("part_number"), ids.year_anywhere(F.col("id")).alias("standard_year"),
        first.alias("is_summary_chunk"), F.when(~first, F.col("k") - 1).cast("int").alias("chunk_index"),
    )


def chunks(standards: DataFrame) -> DataFrame:
    """Chunks of (std_seq, id, title, text), numbered through by doc_idx in order of std_seq. Category and keywords are
    computed once a standard, before the shuffle that numbers them; no text is shuffled but for doc_idx."""
    made = cut(running_offset(described(standards.select("std_seq", "id", "title", "text")), "std_seq", chunk_count()))
    return made.withColumn("doc_idx", (F.col("offset") + F.col("k")).cast("long")).select("doc_idx", *[c for c in made.columns if c not in ("std_seq", "offset", "k")])
