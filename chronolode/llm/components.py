"""Connected components of a link table, by joins alone.

Alternating large and small stars: each step hooks neighbours to the smallest
node near them. The table of links is written after every step, so a lost
executor costs one step; only sums of it come to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolode.llm.common import materialise



def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: every larger neighbour of a node to the smallest of its surroundings.
    Small: the smaller ones and the node itself."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    )
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    joined = both.join(least, "a")
    if large:
        out = joined.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b"))
        )
    return out.filter("a <> b").distinct()


def components(links: DataFrame, steps: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b): the smallest reachable."""
    now = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    for _ in range(steps):
        now = materialise(_star(_star(now, large=True), large=False), "links")
        told = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if told == before:
            break
        before = told
    else:
        raise RuntimeError(f"components did not settle in {steps} steps")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
