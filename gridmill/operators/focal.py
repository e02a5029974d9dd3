"""Neighbourhood operators.

Convolutions and neighbourhood aggregates work on square tiles with a halo: one
shuffle of little more than the grid, whatever the kernel's size, and numpy within a
tile.  The 3 x 3 terrain measures send each cell to its nine places and add up.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Cells along a tile's side.
TILE = 256


def _offsets(kernel: Mapping[tuple[int, int], float]) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc"), F.lit(float(w)).alias("w")) for (r, c), w in sorted(kernel.items())])


def square(radius: int, weight: float = 1.0) -> dict[tuple[int, int], float]:
    return {(r, c): weight for r in range(-radius, radius + 1) for c in range(-radius, radius + 1)}


def gaussian(size: int = 21, reach: float = 3.0) -> dict[tuple[int, int], float]:
    """A size x size blur: roots of the normal distribution's shares of equal steps over ``reach`` deviations to either side, scaled to a sum of 1."""
    half = reach + (2 * reach + 1) / size / 2
    edges = [-half + 2 * half * i / size for i in range(size + 1)]
    share = [0.5 * (math.erf(b / math.sqrt(2)) - math.erf(a / math.sqrt(2))) for a, b in zip(edges, edges[1:], strict=False)]
    line = [math.sqrt(x) for x in share]
    total = sum(line) ** 2
    return {(r - size // 2, c - size // 2): line[r] * line[c] / total for r in range(size) for c in range(size)}


def _tiled(cells: DataFrame, radius: int, work: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(row, col, value): ``work`` done on square tiles with ``radius`` cells around them.

    ``work`` gets the values (0 without data) and the places with data, both with the halo, and
    returns the inner part, NaN for no data.  A cell goes to its tile and to those whose halo it is
    in, so one shuffle moves little more than the grid, whatever the kernel.
    """
    tile = max(TILE, 2 * radius)

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        r = frame["row"].to_numpy() - (key[0] * tile - radius)
        c = frame["col"].to_numpy() - (key[1] * tile - radius)
        value = frame["value"].to_numpy(dtype="float64", na_value=np.nan)
        n = tile + 2 * radius
        values, valid, here = np.zeros((n, n)), np.zeros((n, n), bool), np.zeros((n, n), bool)
        data = ~np.isnan(value)
        values[r[data], c[data]] = value[data]
        valid[r[data], c[data]] = True
        here[r, c] = True
        inner = slice(radius, radius + tile)
        out = work(values, valid)
        rows, cols = np.nonzero(here[inner, inner])
        found = pd.Series(out[rows, cols], dtype="object")
        found[np.isnan(out[rows, cols])] = None
        return pd.DataFrame({"row": rows + key[0] * tile, "col": cols + key[1] * tile, "value": found})

    first = lambda c: F.floor((F.col(c) - radius) / tile)
    last = lambda c: F.floor((F.col(c) + radius) / tile)
    spread = cells.select("row", "col", F.col("value").cast("double").alias("value"))
    spread = spread.withColumn("_tr", F.explode(F.sequence(first("row"), last("row")))).withColumn("_tc", F.explode(F.sequence(first("col"), last("col"))))
    return spread.groupBy("_tr", "_tc").applyInPandas(run, "row long, col long, value double")


def _rest_of(cells: DataFrame, found: DataFrame) -> DataFrame:
    """``cells`` with the values of ``found``; further columns are joined on."""
    if sorted(cells.columns) == ["col", "row", "value"]:
        return found.select(*cells.columns)
    return cells.drop("value").join(found, ["row", "col"], "left").select(*cells.columns)


def convolve(cells: DataFrame, kernel: Mapping[tuple[int, int], float], ignore_nodata: bool = False, mask_nodata: bool = False) -> DataFrame:
    """Weighted sums around each cell of the grid (one row a place).

    No data counts as 0; with ``ignore_nodata`` sums are divided by the kernel's weight
    over valid cells and multiplied by its total; with ``mask_nodata`` cells without data stay so.
    """
    weights = {(int(r), int(c)): float(w) for (r, c), w in kernel.items()}
    total = float(sum(weights.values()))
    radius = max((max(abs(r), abs(c)) for r, c in weights), default=0)

    def work(values: np.ndarray, valid: np.ndarray) -> np.ndarray:
        n = values.shape[0] - 2 * radius
        part = lambda x, r, c: x[radius + r : radius + r + n, radius + c : radius + c + n]
        out, share = np.zeros((n, n)), np.zeros((n, n))
        for (r, c), w in sorted(weights.items()):
            out += w * part(values, r, c)
            if ignore_nodata:
                share += w * part(valid, r, c)
        if ignore_nodata:
            out = np.where(share != 0, out / np.where(share != 0, share, 1) * total, np.nan)
        return np.where(part(valid, 0, 0), out, np.nan) if mask_nodata else out

    return _rest_of(cells, _tiled(cells, radius, work))


def neighbours(cells: DataFrame, radius: int = 1) -> DataFrame:
    """(row, col, dr, dc, value): all cells around each place that has a cell."""
    places = cells.select("row", "col", F.explode(_offsets(square(radius))).alias("k")).select("row", "col", F.col("k.dr").alias("dr"), F.col("k.dc").alias("dc"))
    around = cells.select((F.col("row")).alias("_r"), F.col("col").alias("_c"), "value")
    return places.join(around, (F.col("row") + F.col("dr") == F.col("_r")) & (F.col("col") + F.col("dc") == F.col("_c"))).drop("_r", "_c")


def focal(cells: DataFrame, radius: int, how: str = "avg") -> DataFrame:
    """An aggregate of the valid cells of each square neighbourhood; sums, means, counts and extremes by tiles, others by Spark's aggregates."""
    if how not in ("sum", "avg", "count", "min", "max"):
        spread = cells.filter("value is not null").select("row", "col", "value", F.explode(_offsets(square(radius))).alias("k"))
        moved = spread.select((F.col("row") - F.col("k.dr")).alias("row"), (F.col("col") - F.col("k.dc")).alias("col"), "value")
        return cells.drop("value").join(moved.groupBy("row", "col").agg(getattr(F, how)("value").alias("value")), ["row", "col"], "left")

    def work(values: np.ndarray, valid: np.ndarray) -> np.ndarray:
        n = values.shape[0] - 2 * radius
        start = {"min": np.inf, "max": -np.inf}.get(how, 0.0)
        out, count = np.full((n, n), start), np.zeros((n, n), np.int64)
        for r in range(2 * radius + 1):
            for c in range(2 * radius + 1):
                v, ok = values[r : r + n, c : c + n], valid[r : r + n, c : c + n]
                count += ok
                if how in ("min", "max"):
                    out = (np.minimum if how == "min" else np.maximum)(out, np.where(ok, v, start))
                else:
                    out += v
        out = count.astype(float) if how == "count" else out / np.maximum(count, 1) if how == "avg" else out
        return np.where(count > 0, out, np.nan)

    return _rest_of(cells, _tiled(cells, radius, work))


def around(cells: DataFrame, row: int, col: int, radius: int, fill: float) -> DataFrame:
    """The square around one place, with ``fill`` outside the grid and where there is no data."""
    offsets = cells.sparkSession.range((2 * radius + 1) ** 2)
    n = 2 * radius + 1
    places = offsets.select((F.floor(F.col("id") / n) - radius + row).cast("long").alias("row"), (F.col("id") % n - radius + col).alias("col"))
    near = cells.filter(F.col("row").between(row - radius, row + radius) & F.col("col").between(col - radius, col + radius))
    return places.join(near, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def terrain(cells: DataFrame, cell_size: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """slope (percent), aspect, hillshade, TRI, TPI and roughness from 3 x 3 neighbourhoods; edges have none."""
    spread = cells.filter("value is not null").select("row", "col", "value", F.explode(_offsets(square(1))).alias("k"))
    moved = spread.select((F.col("row") - F.col("k.dr")).alias("row"), (F.col("col") - F.col("k.dc")).alias("col"), F.col("k.dr").alias("dr"), F.col("k.dc").alias("dc"), "value")
    weight = lambda along, across: F.when(F.col(across) == 0, 2).otherwise(1) * F.col(along)
    sums = moved.groupBy("row", "col").agg(
        F.count(F.lit(1)).alias("n"),
        (F.sum(weight("dc", "dr") * F.col("value")) / (8 * cell_size)).alias("dx"),
        (F.sum(weight("dr", "dc") * F.col("value")) / (8 * cell_size)).alias("dy"),
        F.max(F.when((F.col("dr") == 0) & (F.col("dc") == 0), F.col("value"))).alias("z"),
        F.sum("value").alias("s"),
        F.sum(F.col("value") * F.col("value")).alias("s2"),
        (F.max("value") - F.min("value")).alias("roughness"),
    )
    whole = sums.filter("n = 9")
    steep = F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2)
    facing = F.atan2(F.col("dy"), -F.col("dx"))
    degrees = F.degrees(facing)
    aspect = F.when(steep == 0, F.lit(-1.0)).when(degrees > 90, 450 - degrees).otherwise(90 - degrees)
    zenith, light = math.radians(90 - altitude), math.radians((450 - azimuth) % 360)
    shade = 255 * (math.cos(zenith) * F.cos(F.atan(steep)) + math.sin(zenith) * F.sin(F.atan(steep)) * F.cos(F.lit(light) - facing))
    others = F.col("s") - F.col("z")
    squares = F.col("s2") - 2 * F.col("z") * F.col("s") + 9 * F.col("z") ** 2  # of the differences from the middle
    return whole.select("row", "col", (steep * 100).alias("slope"), aspect.alias("aspect"), F.greatest(shade, F.lit(0.0)).alias("hillshade"), F.sqrt(F.greatest(squares, F.lit(0.0))).alias("tri"), (F.col("z") - others / 8).alias("tpi"), "roughness")


def distance_transform(cells: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """Euclidean distance in cells to the nearest nonzero cell: by column first, then along rows (exact and separable)."""
    def down(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("row")
        at = frame["row"].to_numpy()
        on = at[frame["value"].fillna(0).to_numpy() != 0]
        if not len(on):
            near = np.full(len(at), np.inf)
        else:
            k = np.searchsorted(on, at)
            near = np.minimum(np.abs(at - on[np.clip(k, 0, len(on) - 1)]), np.abs(at - on[np.clip(k - 1, 0, len(on) - 1)])).astype(float)
        return pd.DataFrame({"row": at, "col": frame["col"].to_numpy(), "g": near})

    def along(frame: pd.DataFrame) -> pd.DataFrame:
        # The lower envelope of the parabolas (x - c)^2 + g^2 over a row, in one sweep.
        frame = frame[["row", "col", "g"]].sort_values("col")
        at, g2 = frame["col"].to_numpy().astype(float), frame["g"].to_numpy() ** 2
        tops: list[int] = []
        cuts: list[float] = []  # where each parabola of the envelope takes over from the one before
        for i in np.flatnonzero(np.isfinite(g2)).tolist():
            cut = -np.inf
            while tops:
                j = tops[-1]
                cut = ((g2[i] + at[i] ** 2) - (g2[j] + at[j] ** 2)) / (2 * (at[i] - at[j]))
                if cut > cuts[-1]:
                    break
                tops.pop()
                cuts.pop()
                cut = -np.inf
            tops.append(i)
            cuts.append(cut)
        if not tops:
            best = np.full(len(at), np.inf)
        else:
            own = np.array(tops)[np.searchsorted(cuts, at, side="right") - 1]
            best = (at - at[own]) ** 2 + g2[own]
        return pd.DataFrame({"row": frame["row"].to_numpy(), "col": frame["col"].to_numpy(), "distance": np.sqrt(best)})

    columns = cells.select("row", "col", F.col("value").cast("double").alias("value")).groupBy("col").applyInPandas(down, "row long, col long, g double")
    return columns.groupBy("row").applyInPandas(along, "row long, col long, distance double")


def interpolate_nearest(spark, points: DataFrame, n_rows: int, n_cols: int, cell: int) -> DataFrame:  # noqa: ANN001
    """The value of the nearest point for each cell, looked for in the square buckets of ``cell`` around it (cells beyond have none)."""
    from gridmill.sources.cells import blank

    grid = blank(spark, n_rows, n_cols).drop("value")
    bucket = lambda c: F.floor(F.col(c) / cell).cast("long")
    near = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    places = grid.select("row", "col", near.alias("k")).select("row", "col", (bucket("row") + F.col("k.a")).alias("br"), (bucket("col") + F.col("k.b")).alias("bc"))
    named = points.select(F.col("row").alias("pr"), F.col("col").alias("pc"), "value", bucket("row").alias("br"), bucket("col").alias("bc"))
    pairs = places.join(named, ["br", "bc"])
    score = F.struct(F.hypot(F.col("row") - F.col("pr"), F.col("col") - F.col("pc")), F.col("pr"), F.col("pc"))
    return pairs.groupBy("row", "col").agg(F.min_by("value", score).alias("value"))
