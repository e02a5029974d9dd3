"""Ranking of cells, percentile sets and greedy allocation along a ranking.

Ties are broken by row and column, so ranks are reproducible.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.operators.ordered import ranked, running_sum

NDV = -9999


def _order(highest_first: bool, value: str) -> tuple[Column, Column, Column]:
    return (F.desc(value) if highest_first else F.asc(value), F.asc("row"), F.asc("col"))


def rank_cells(cells: DataFrame, highest_first: bool = True, low: float | None = None, high: float | None = None, value: str = "value") -> DataFrame:
    """Valid cells (between the limits) with ranks 1..N."""
    kept = cells.filter(F.col(value).isNotNull())
    kept = kept.filter(F.col(value) >= low) if low is not None else kept
    kept = kept.filter(F.col(value) <= high) if high is not None else kept
    return ranked(kept, *_order(highest_first, value))


def rank_grid(cells: DataFrame, masked: Column | None = None, highest_first: bool = True) -> DataFrame:
    """All cells with ranks; no-data and masked cells have NDV."""
    free = cells if masked is None else cells.filter(~masked)
    ranks = rank_cells(free, highest_first).select("row", "col", "rank")
    return cells.join(ranks, ["row", "col"], "left").withColumn("rank", F.coalesce("rank", F.lit(NDV)).cast("long"))


def top_percentile(cells: DataFrame, percent: float, as_set: bool = False, value: str = "value", highest_first: bool = True) -> DataFrame:
    """Values (or 1) of cells whose rank lies below that percentile of all ranks, else 0; cells without data are left out."""
    ranks = rank_of_top_percentile(rank_cells(cells, highest_first, value=value), percent)
    kept = F.lit(1) if as_set else F.col(value)
    return ranks.withColumn(value, F.when(F.col("rank") > 0, kept).otherwise(F.lit(0)).cast("double")).drop("rank")


def rank_of_top_percentile(ranks: DataFrame, percent: float) -> DataFrame:
    """Ranks below the percentile of ranks, else 0."""
    cut = ranks.agg((F.lit(1) + F.lit(percent / 100) * (F.count("rank") - 1)).alias("_cut"))  # one row; ranks are 1..N
    return ranks.crossJoin(F.broadcast(cut)).withColumn("rank", F.when(F.col("rank") < F.col("_cut"), F.col("rank")).otherwise(F.lit(0))).drop("_cut")


def allocate(cells: DataFrame, goal: float, highest_first: bool = True, value: str = "value") -> DataFrame:
    """1 for the best cells whose values together stay below ``goal`` (the crossing cell is left out), else 0.  Values are not negative."""
    run = running_sum(cells.filter(F.col(value).isNotNull()), F.col(value).cast("double"), *_order(highest_first, value))
    return run.withColumn("allocated", (F.col("running") < goal).cast("int"))


def allocate_eligible(cells: DataFrame, goal: float, rank_by: str, value: str = "value", share: str = "share") -> DataFrame:
    """Shares of eligible cells in rank order until value x share reaches ``goal``; the crossing cell is included."""
    gain = F.col(value).cast("double") * F.col(share)
    run = running_sum(cells.filter((F.col(share) > 0) & F.col(value).isNotNull()), gain, *_order(True, rank_by))
    return run.withColumn("allocated", F.when(F.col("running") - gain < goal, F.col(share)).otherwise(F.lit(0.0)))


def unused_value(cells: DataFrame, value: str = "value") -> DataFrame:
    """One row: a value that no cell has: the middle of the widest gap, or the only value less one."""
    values = cells.filter(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v")).distinct()
    pairs = _successors(values)
    best = pairs.agg(F.max(F.struct((F.col("next") - F.col("v")).alias("gap"), (-F.col("v")).alias("low"), ((F.col("v") + F.col("next")) / 2).alias("mid"))).alias("b"))
    least = values.agg((F.min("v") - 1).alias("other"))
    return best.crossJoin(least).select(F.coalesce("b.mid", "other").alias("unused"))


def _successors(values: DataFrame) -> DataFrame:
    """(v, next) of sorted distinct values: numbered over all partitions, then joined to the following number."""
    numbered = ranked(values, F.asc("v"))
    return numbered.join(numbered.select((F.col("rank") - 1).alias("rank"), F.col("v").alias("next")), "rank").select("v", "next")


def dense_ids(df: DataFrame, name: str, out: str = "id") -> DataFrame:
    """Dense ids by sorted distinct names, in which _ sorts as %; the names are a dimension table."""
    names = df.select(name).distinct()
    ids = ranked(names.withColumn("_key", F.translate(name, "_", "%")), F.asc("_key"), F.asc(name), name=out)
    return df.join(ids.drop("_key"), name)


def top_by_group(df: DataFrame, group: str, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each group."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("_k") <= k).drop("_k")


def best_cell(cells: DataFrame, row: int, col: int, cost: float = 0.0) -> DataFrame:
    """One row: the cell whose positive value less ``cost`` times its distance from a place is greatest."""
    score = F.col("value") - F.hypot(F.col("row") - row, F.col("col") - col) * cost
    kept = cells.withColumn("score", score).filter("score > 0")
    return kept.agg(F.max(F.struct("score", (-F.col("row")).alias("r"), (-F.col("col")).alias("c"))).alias("b")).select((-F.col("b.r")).alias("row"), (-F.col("b.c")).alias("col"), F.col("b.score").alias("score"))
