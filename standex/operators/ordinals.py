"""Dense numbers in an order, without a task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored


def numbered(df: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """df with 0, 1, ... in the given order, which should leave no ties. The rows are sorted by ranges and written once;
    each range's rows are counted, and a row's place in its range is added to what lies before the range. The
    single-partition window sees one row a range."""
    placed = stored(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "sorted")
    part = F.shiftright("_at", 33)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    at = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, at).drop("_part", "_at", "_start")
