"""Changing a grid's frame: windows, padding, snapping, resampling, alignment."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.sources.cells import blank

#: The supported resolutions in arc-seconds.
RESOLUTIONS = (1, 10, 30, 150, 300, 900, 1800, 3600, 7200, 14400, 36000)


@dataclass(frozen=True)
class Frame:
    """Where a grid lies: upper left corner, cell sizes (``yres`` positive, rows go down), and shape."""

    ulx: float
    uly: float
    xres: float
    yres: float
    n_rows: int
    n_cols: int

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        """(min x, min y, max x, max y)."""
        return self.ulx, self.uly - self.n_rows * self.yres, self.ulx + self.n_cols * self.xres, self.uly

    @staticmethod
    def world(arcseconds: float) -> Frame:
        return Frame(-180.0, 90.0, arcseconds / 3600, arcseconds / 3600, round(180 * 3600 / arcseconds), round(360 * 3600 / arcseconds))

    def window(self, bounds: Sequence[float], edge: str = "centroid") -> tuple[int, int, int, int]:
        """(col, row, n_cols, n_rows) of a box: centroid rounds halves to even, inclusive outwards, exclusive inwards."""
        left, top = (bounds[0] - self.ulx) / self.xres, (self.uly - bounds[3]) / self.yres
        right, bottom = (bounds[2] - self.ulx) / self.xres, (self.uly - bounds[1]) / self.yres
        low, high = {"centroid": (round, round), "inclusive": (_floor, _ceil), "exclusive": (_ceil, _floor)}[edge]
        c, r = low(left), low(top)
        return c, r, high(right) - c, high(bottom) - r

    def cropped(self, col: int, row: int, n_cols: int, n_rows: int) -> Frame:
        return Frame(self.ulx + col * self.xres, self.uly - row * self.yres, self.xres, self.yres, n_rows, n_cols)


def _floor(x: float) -> int:
    return math.floor(x + 1e-9)


def _ceil(x: float) -> int:
    return math.ceil(x - 1e-9)


def snap(bounds: Sequence[float], res: float) -> tuple[float, float, float, float]:
    """The box grown outwards to whole cells; sides that already lie on cell edges stay."""
    return _floor(bounds[0] / res) * res, _floor(bounds[1] / res) * res, _ceil(bounds[2] / res) * res, _ceil(bounds[3] / res) * res


def intersection(boxes: Sequence[Sequence[float]]) -> tuple[float, float, float, float]:
    out = max(b[0] for b in boxes), max(b[1] for b in boxes), min(b[2] for b in boxes), min(b[3] for b in boxes)
    if out[0] >= out[2] or out[1] >= out[3]:
        raise ValueError("the boxes do not overlap")
    return out


def union(boxes: Sequence[Sequence[float]]) -> tuple[float, float, float, float]:
    return min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)


def resolution_of(degrees: float, tolerance: float = 0.01) -> int:
    """The supported resolution within ``tolerance`` of a cell size in degrees."""
    best = min(RESOLUTIONS, key=lambda r: abs(r / 3600 - degrees))
    if abs(best / 3600 - degrees) > tolerance * degrees:
        raise ValueError(f"no supported resolution is near {degrees} degrees")
    return best


def same_frame(frames: Sequence[Frame]) -> bool:
    return len(set(frames)) <= 1


def box_of(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.agg(F.min(x).alias("minx"), F.min(y).alias("miny"), F.max(x).alias("maxx"), F.max(y).alias("maxy"))


def box_wkt(minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """The box as a polygon: four corners and the first again."""
    ring = [(minx, miny), (minx, maxy), (maxx, maxy), (maxx, miny), (minx, miny)]
    return F.concat(F.lit("POLYGON(("), F.concat_ws(",", *[F.concat_ws(" ", x.cast("string"), y.cast("string")) for x, y in ring]), F.lit("))"))


def latlon(frame: Frame) -> tuple[Column, Column]:
    """(lat, lon) of the upper left corners of cells."""
    return F.lit(frame.uly) - F.col("row") * frame.yres, F.lit(frame.ulx) + F.col("col") * frame.xres


def cell_of(frame: Frame, lat: Column, lon: Column) -> tuple[Column, Column]:
    """(row, col) of places, in decimal arithmetic so that places on cell edges fall right."""
    exact = lambda c: c.cast("decimal(28,14)")
    return F.floor((exact(F.lit(frame.uly)) - exact(lat)) / exact(F.lit(frame.yres))).cast("long"), F.floor((exact(lon) - exact(F.lit(frame.ulx))) / exact(F.lit(frame.xres))).cast("long")


def crop(cells: DataFrame, col: int, row: int, n_cols: int, n_rows: int) -> DataFrame:
    """A window as a grid of its own."""
    inside = cells.filter(F.col("row").between(row, row + n_rows - 1) & F.col("col").between(col, col + n_cols - 1))
    return inside.withColumn("row", F.col("row") - row).withColumn("col", F.col("col") - col)


def clip_to(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """Cells that the mask (row, col) covers."""
    return cells.join(mask.select("row", "col").distinct(), ["row", "col"], "left_semi")


def pad(spark: SparkSession, cells: DataFrame, frame: Frame, above: int, below: int, left: int, right: int, fill: float | None = None) -> tuple[DataFrame, Frame]:
    """Rows and columns added around; the origin moves up and left."""
    wide = Frame(frame.ulx - left * frame.xres, frame.uly + above * frame.yres, frame.xres, frame.yres, frame.n_rows + above + below, frame.n_cols + left + right)
    moved = cells.select((F.col("row") + above).alias("row"), (F.col("col") + left).alias("col"), F.col("value").alias("_v"), F.lit(True).alias("_in"))
    grid = blank(spark, wide.n_rows, wide.n_cols, fill)
    return grid.join(moved, ["row", "col"], "left").select("row", "col", F.when(F.col("_in"), F.col("_v")).otherwise(F.col("value")).alias("value")), wide


def fill_frame(spark: SparkSession, cells: DataFrame, frame: Frame, fill: float) -> DataFrame:
    """Every cell of the frame; missing ones and those without data get ``fill``."""
    return blank(spark, frame.n_rows, frame.n_cols).drop("value").join(cells, ["row", "col"], "left").withColumn("value", F.coalesce("value", F.lit(fill)))


def resample(spark: SparkSession, cells: DataFrame, source: Frame, target: Frame, how: str = "near") -> DataFrame:
    """Cells on the target's frame: near, bilinear; average, sum, min, max, mode, median for coarser targets."""
    if how in ("near", "bilinear"):
        grid = blank(spark, target.n_rows, target.n_cols).drop("value")
        x = (F.lit(target.ulx) + (F.col("col") + 0.5) * target.xres - source.ulx) / source.xres
        y = (F.lit(source.uly) - (F.lit(target.uly) - (F.col("row") + 0.5) * target.yres)) / source.yres
        if how == "near":
            grid = grid.withColumn("_r", F.floor(y + 1e-9).cast("long")).withColumn("_c", F.floor(x + 1e-9).cast("long"))
            return grid.join(cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value"), ["_r", "_c"]).select("row", "col", "value")
        # The four nearest centres, each with its weight; cells without data share out their weight.
        grid = grid.withColumn("_y", y - 0.5).withColumn("_x", x - 0.5)
        corner = lambda dr, dc: F.struct((F.floor("_y") + dr).alias("r"), (F.floor("_x") + dc).alias("c"), ((1 - F.abs(F.col("_y") - F.floor("_y") - dr)) * (1 - F.abs(F.col("_x") - F.floor("_x") - dc))).alias("w"))
        near = grid.select("row", "col", F.explode(F.array(*[corner(a, b) for a in (0, 1) for b in (0, 1)])).alias("k")).select("row", "col", F.col("k.r").alias("_r"), F.col("k.c").alias("_c"), F.col("k.w").alias("w")).filter("w > 0")
        found = near.join(cells.filter("value is not null").select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value"), ["_r", "_c"])
        return found.groupBy("row", "col").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("value"))
    name = {"average": "avg"}.get(how, how)
    x = F.lit(source.ulx) + (F.col("col") + 0.5) * source.xres
    y = F.lit(source.uly) - (F.col("row") + 0.5) * source.yres
    moved = cells.select(F.floor((F.lit(target.uly) - y) / target.yres).cast("long").alias("row"), F.floor((x - target.ulx) / target.xres).cast("long").alias("col"), "value")
    inside = moved.filter(F.col("row").between(0, target.n_rows - 1) & F.col("col").between(0, target.n_cols - 1))
    return inside.groupBy("row", "col").agg(getattr(F, name)("value").alias("value"))


def resample_keeping_sum(spark: SparkSession, cells: DataFrame, source: Frame, target: Frame, how: str = "near") -> DataFrame:
    """Resampled, then scaled so that the total stays."""
    out = resample(spark, cells, source, target, how)
    ratio = cells.agg(F.sum("value").alias("_a")).crossJoin(out.agg(F.sum("value").alias("_b"))).select(F.try_divide("_a", "_b").alias("_k"))  # one row
    return out.crossJoin(F.broadcast(ratio)).withColumn("value", F.col("value") * F.col("_k")).drop("_k")


def aligned_stack(spark: SparkSession, grids: Sequence[tuple[DataFrame, Frame]], res: float, mode: str = "intersection", how: str = "near") -> tuple[DataFrame, Frame]:
    """Grids resampled to one frame (their boxes' intersection or union): a column v0, v1, ... for each."""
    box = snap((intersection if mode == "intersection" else union)([f.bounds for _, f in grids]), res)
    frame = Frame(box[0], box[3], res, res, round((box[3] - box[1]) / res), round((box[2] - box[0]) / res))
    moved = [resample(spark, c, f, frame, how).withColumnRenamed("value", f"v{i}") for i, (c, f) in enumerate(grids)]
    return reduce(lambda a, b: a.join(b, ["row", "col"], "inner" if mode == "intersection" else "full"), moved), frame


def block_list(spark: SparkSession, degrees: float, res: float, box: Sequence[float] = (-180.0, -90.0, 180.0, 90.0)) -> DataFrame:
    """(h, v, col, row, n_cols, n_rows) of the square blocks that cover a box; a generated dimension."""
    cells = round(degrees / res)
    across, down = _ceil((box[2] - box[0]) / degrees), _ceil((box[3] - box[1]) / degrees)
    ids = spark.range(across * down).select((F.col("id") % across).alias("h"), F.floor(F.col("id") / across).cast("long").alias("v"))
    return ids.select("h", "v", (F.col("h") * cells).alias("col"), (F.col("v") * cells).alias("row"), F.lit(cells).cast("long").alias("n_cols"), F.lit(cells).cast("long").alias("n_rows"))


def tile_names(spark: SparkSession, box: Sequence[float], step: int = 5) -> DataFrame:
    """Names such as n10w090 of the tiles that cover a box, by their lower left corners."""
    s = snap(box, step)
    across, down = round((s[2] - s[0]) / step), round((s[3] - s[1]) / step)
    ids = spark.range(across * down).select((F.col("id") % across * step + int(s[0])).alias("x"), (F.floor(F.col("id") / across) * step + int(s[1])).alias("y"))
    part = lambda c, pos, neg, n: F.concat(F.when(c >= 0, pos).otherwise(neg), F.lpad(F.abs(c).cast("string"), n, "0"))
    return ids.select("x", "y", F.concat(part(F.col("y"), "n", "s", 2), part(F.col("x"), "e", "w", 3)).alias("tile"))
