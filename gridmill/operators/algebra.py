"""Cell-wise map algebra: expressions over grids that share a frame of cells."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("row", "col")


def aligned(frames: Mapping[str, DataFrame], how: str = "inner", keys: Sequence[str] = KEYS) -> DataFrame:
    """One row a cell with a column for each grid.  ``how``: inner (common cells) or full (all cells)."""
    named = [f.select(*keys, F.col("value").alias(name)) for name, f in frames.items()]
    return reduce(lambda a, b: a.join(b, list(keys), how), named)


def calc(frames: Sequence[DataFrame], op: Callable[..., Column], how: str = "inner", cast: str | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """``op`` over the values of the grids, as one expression that the optimizer sees.

    NULL (no data) propagates as in SQL.  The result may be cast; inputs are not.
    """
    names = [f"_v{i}" for i in range(len(frames))]
    out = op(*[F.col(n) for n in names])
    return aligned(dict(zip(names, frames, strict=True)), how, keys).select(*keys, (out.cast(cast) if cast else out).alias("value"))


def add(a: Column, b: Column) -> Column:
    return a + b


def subtract(a: Column, b: Column) -> Column:
    return a - b


def multiply(a: Column, b: Column) -> Column:
    return a * b


def divide(a: Column, b: Column) -> Column:
    """No data where the divisor is zero."""
    return F.try_divide(a.cast("double"), b)


def greater_than(a: Column, b: Column) -> Column:
    return (a > b).cast("int")


def positive_where_zero(a: Column, b: Column) -> Column:
    return ((a > 0) & (b == 0)).cast("int")


def proportion_change(after: Column, before: Column) -> Column:
    return F.try_divide(after - before, before)


def add_where(a: Column, b: Column, mask: Column) -> Column:
    return F.when(mask == 1, a + b)


def add_both_valid(a: Column, b: Column, mask_a: Column, mask_b: Column) -> Column:
    return F.when((mask_a == 1) & (mask_b == 1), a + b)


def multiply_or_keep(a: Column, b: Column) -> Column:
    """The product where both are valid, else ``a``."""
    return F.when(b.isNotNull(), a * b).otherwise(a)


def below_set_to(a: Column, limit: float, new: float) -> Column:
    return F.when(a < limit, F.lit(new)).otherwise(a)


def replaced(a: Column, old: float, new: float) -> Column:
    return F.when(a == old, F.lit(new)).otherwise(a)


def between_or_nodata(a: Column, low: float | None = None, high: float | None = None) -> Column:
    """Values outside the limits become no data."""
    if low is not None:
        a = F.when(a >= low, a)
    return F.when(a <= high, a) if high is not None else a


def masks(df: DataFrame) -> DataFrame:
    """``df`` with valid, nodata, zero and nonzero flags (0/1)."""
    v = F.col("value")
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return df.withColumns({"valid": flag(v.isNotNull()), "nodata": flag(v.isNull()), "zero": flag(v == 0), "nonzero": flag(v != 0)})


def masked(df: DataFrame, mask: DataFrame) -> DataFrame:
    """No data wherever the mask is not 1."""
    return calc([df, mask], lambda v, m: F.when(m == 1, v))


def normalized(df: DataFrame, low: float = 0.0, high: float = 1.0, log: bool = False, value: str = "value") -> DataFrame:
    """Values scaled to [low, high], after ln(x - min + 1) if asked; a constant grid becomes ``low``."""
    v = F.col(value).cast("double")
    ends = df.agg(F.min(v).alias("_min"), F.max(v).alias("_max"))  # one row
    out = df.crossJoin(F.broadcast(ends))
    x, top = (F.ln(v - F.col("_min") + 1), F.ln(F.col("_max") - F.col("_min") + 1)) if log else (v - F.col("_min"), F.col("_max") - F.col("_min"))
    scaled = F.coalesce(F.try_divide(x, top), F.when(v.isNotNull(), F.lit(0.0)))
    return out.withColumn(value, F.lit(low) + scaled * (high - low)).drop("_min", "_max")


def apply_changes(df: DataFrame, changes: DataFrame) -> DataFrame:
    """Cells set to the values of ``changes`` (pos, row, col, value); of several for a cell the last counts."""
    last = changes.groupBy(*KEYS).agg(F.max_by("value", "pos").alias("_new"), F.lit(True).alias("_hit"))
    return df.join(last, list(KEYS), "left").withColumn("value", F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("value"))).drop("_new", "_hit")


def add_at(df: DataFrame, changes: DataFrame, amount: float) -> DataFrame:
    """``amount`` added once for each time that a cell is listed."""
    times = changes.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(times, list(KEYS), "left").withColumn("value", F.col("value") + F.lit(amount) * F.coalesce("_n", F.lit(0))).drop("_n")


class Grid:
    """A grid with arithmetic: ``(a + b) / c`` builds one plan."""

    def __init__(self, cells: DataFrame) -> None:
        self.cells = cells

    def _with(self, other: Grid | float, op: Callable[[Column, Column], Column]) -> Grid:
        if isinstance(other, Grid):
            return Grid(calc([self.cells, other.cells], op))
        return Grid(self.cells.withColumn("value", op(F.col("value"), F.lit(other))))

    def __add__(self, other: Grid | float) -> Grid:
        return self._with(other, add)

    def __sub__(self, other: Grid | float) -> Grid:
        return self._with(other, subtract)

    def __mul__(self, other: Grid | float) -> Grid:
        return self._with(other, multiply)

    def __truediv__(self, other: Grid | float) -> Grid:
        return self._with(other, divide)
