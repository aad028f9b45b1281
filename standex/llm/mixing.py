"""Mixing sources to target weights.

Tokens are summed per source (partial aggregation, so a source with a third of all rows is no
hot key). Targets share the total by weight; a target stops at MOST times its source's size and the
excess goes to the others by weight, until none is above. That is one threshold: with the sources
in order of cap / weight, the first ones are capped and the rest get weight x rest / weights left,
which two running sums over the sources give without a loop. A document is then emitted
floor(rate) times, and once more if a hash of its id, seen as a number in [0, 1), is below the
rate's fraction. Nothing is random: reruns agree.

Defined results: a null text has size 0; a source of size 0 has target 0. A null source sorts last
and is a source of its own. A null doc_id draws by its text, so equal rows draw alike. Texts of any length are
counted whole. Extra columns, of any name, stay in the struct `doc`. With no rows the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST = 3
SEED = "mix-1"


def size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target, rate) from rows of (source, size).

    The windows run over one row a source, after the aggregation."""
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sums.withColumn("w", F.element_at(cycle, (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1)).cast("long"))
    cap = F.lit(most) * F.col("source_size")
    by_cap = Window.orderBy((cap / F.col("w")), F.col("source").isNull(), "source")
    every = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    rest = ranked.withColumns(
        {
            "left": F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0)),
            "w_left": F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)),
        }
    )
    # a source is capped if its share of what is left would exceed its cap; all before it in order are
    rest = rest.withColumn("capped", F.col("w") * F.col("left") >= cap * F.col("w_left"))
    free = rest.withColumns(
        {
            "left_free": F.sum("source_size").over(every) - F.sum(F.when(F.col("capped"), cap).otherwise(0)).over(every),
            "w_free": F.sum(F.when(F.col("capped"), 0).otherwise(F.col("w"))).over(every),
        }
    )
    target = F.when(F.col("capped"), cap.cast("double")).otherwise((F.col("w") * F.col("left_free")).cast("double") / F.col("w_free"))
    out = free.withColumn("target", target)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return out.select("source", "source_size", "target", rate.alias("rate"))


def draw(doc_id: str = "doc_id", text: str = "text", seed: str = SEED) -> Column:
    """A number in [0, 1) from 52 bits of the MD5 of seed and id."""
    name = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), name)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def copies(rate: Column, u: Column) -> Column:
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """(docs' columns as a struct `doc`, size, source_size, target, copies).

    The rates are written first: one row a source, a table whose size the planner knows. It is
    broadcast while it is small, and the documents then aren't shuffled by their sources."""
    wrapped = docs.select(F.struct("*").alias("doc"), F.col("source"), size().alias("size"), draw(seed=seed).alias("u"))
    rates = stored(source_targets(docs.select("source", size().alias("size")), weights, most), "rates")
    rates = rates.withColumnRenamed("source", "_sx_source")
    joined = wrapped.join(rates, F.col("source").eqNullSafe(F.col("_sx_source")))
    return joined.select("doc", "size", "source_size", "target", copies(F.col("rate"), F.col("u")).alias("copies"))


def emit(mixed: DataFrame) -> DataFrame:
    """Each document as often as the mix takes it, with the copy's number."""
    taken = mixed.where("copies > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
