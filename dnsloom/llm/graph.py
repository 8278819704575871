"""Connected components of a link table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsloom.llm.common import HOT, hot_join, settle


def _back(rows: DataFrame, low: DataFrame, most: int) -> DataFrame:
    """Each node's minimum, joined to its rows; ``most`` is more than any node's rows."""
    return rows.join(low.drop("_n"), "u") if most <= HOT else hot_join(rows, settle(low, "low"), ["u"])


def _large_star(edges: DataFrame, most: int) -> DataFrame:
    """Every neighbour above a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("_n"))
    return _back(both, low, most).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, most: int) -> DataFrame:
    """Every neighbour below a node, and the node, are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
    moved = _back(down, low, most).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``edges`` (u, v long) -> (node, root): for each linked node the smallest node it can reach.

    Each round is written to the shared folder. Minima go up by partial
    aggregation and come back by ``hot_join``, so a node of very many links is no
    single task's work.
    """
    now = settle(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    rows = now.count()
    if not rows:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    state = None
    for _ in range(most_rounds):
        now = settle(_small_star(_large_star(now, 2 * rows), 2 * rows).filter("u <> v").distinct(), "edges")
        seen = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state, rows = seen, seen[0]
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
