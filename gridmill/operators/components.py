"""Connected components of an edge table, without gathering it anywhere.

Large-star and small-star steps alternate: every node's larger neighbours are
linked to the least node around it, then its smaller ones are.  The edges become
stars around the least node of each component.  A step is two aggregations with
partial sums and a join, so a hub with very many neighbours is dealt out by its
neighbours; a step's result is written to the shared checkpoint folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.checkpoints import saved


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
    least = both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("m"))
    out = both.filter("y > x").join(least, "x").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return out.filter("x != y").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y"))
    least = down.groupBy("x").agg(F.min("y").alias("m"))
    out = down.join(least, "x").filter("y != m").select(F.col("y").alias("x"), F.col("m").alias("y"))
    return out.union(least.select("x", F.col("m").alias("y"))).filter("x != y").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(x, y): every node of ``edges`` (columns x, y) but the least of its component, with that least node."""
    now = saved(edges.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).filter("x != y").distinct())
    mark = None
    while True:
        # In stars every node has one smaller neighbour, and that has none.
        new = _mark(now)
        if new == mark or new[0] == 0:
            return now
        mark = new
        now = saved(_small_star(_large_star(now)))


def _mark(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("x", "y")).alias("h")).first()
    return row["n"], row["h"] or 0
