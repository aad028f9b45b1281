"""Connected components of an edge table, by alternating large-star and small-star.

Each round is two joins on keys with their minimum (partial aggregation first, so a hub is no hot
key in the aggregation, and the joins leave skew to AQE). The loop ends when the edges repeat; it
takes about log^2 rounds. Lineage is cut by a reliable checkpoint each round.

Defined results: repeated links and links of a node to itself change nothing; links with a null end are
ignored. Without links there are no rows. If the edges still change after `most` rounds (a path would need more
than 2^60 nodes), RuntimeError is raised.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

#: Edges that a file of a round holds at least, and the fewest files.
ROWS, FILES = 200_000, 8


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node of the links (src, dst); component is the smallest node."""
    edges = links.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    edges = materialise(edges)
    before = _state(edges)
    for _ in range(most):
        if not before[0]:
            break
        # large star: all larger neighbours point to the least of the neighbourhood
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the node itself point to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = materialise(small.coalesce(max(FILES, before[0] // ROWS)))
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components not found in {most} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
