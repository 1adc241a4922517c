"""Connected components of a graph of long ids, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.llm.text import stored


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``id, root`` for every id on an edge; root is the smallest id of its component.

    Each round hangs every node's larger neighbours on its smallest neighbour (large star), then its smaller neighbours
    (small star). Both are a minimum by key and a join, so a hub's edges are combined before the shuffle and split by
    the skew join after it. The edges of a round are written to the shared folder; the loop ends when a round changes none.
    Self-loops are ignored; no edges give no rows; more than ``most_rounds`` rounds raise an error."""
    e = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    mark = _mark(e)
    if not mark[0]:
        return e.select(F.col("u").alias("id"), F.col("v").alias("root"))
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = stored(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
        new = _mark(e)
        if new == mark:
            stars = e.groupBy("u").agg(F.min("v").alias("v"))
            return stars.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        mark = new
    raise RuntimeError("components did not settle")


def _mark(e: DataFrame) -> tuple:
    """Count and two checksums of the edges: equal marks mean that a round changed nothing."""
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.xxhash64("v", "u", F.lit(1)).cast("decimal(38,0)"))).first()
    return tuple(r)
