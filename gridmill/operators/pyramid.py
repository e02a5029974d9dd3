"""Standard frames and resolution pyramids."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.operators import algebra, reclass, zonal
from gridmill.operators.grid import RESOLUTIONS, Frame, fill_frame, resample, resolution_of, snap
from gridmill.operators.rank import dense_ids

#: Fixed value: metres in a degree along the equator.
METRES_PER_DEGREE = 111319.49079327358


def overviews(cells: DataFrame, levels: Sequence[int] = (2, 4, 8), how: str = "avg") -> DataFrame:
    """(level, row, col, value): coarser copies of a grid, each from the full one."""
    made = [zonal.upscale(cells, k, how).select(F.lit(k).alias("level"), "row", "col", "value") for k in levels]
    return reduce(DataFrame.unionByName, made)


def overview_resample(cells: DataFrame, k: int, keep_sum: bool = False) -> DataFrame:
    """The mean overview by a whole ratio, times its square if totals are to be kept."""
    out = zonal.upscale(cells, k, "avg")
    return out.withColumn("value", F.col("value") * (k * k)) if keep_sum else out


def to_standard(spark: SparkSession, cells: DataFrame, frame: Frame, rules: Mapping | None = None, low: float | None = None, high: float | None = None, how: str = "near", fill: float | None = None) -> tuple[DataFrame, Frame]:
    """A grid on the global frame of its nearest supported resolution: reclassified, censored, resampled, and filled if asked."""
    target = Frame.world(resolution_of(frame.xres))
    out = reclass.reclassify(cells, rules) if rules else cells
    out = out.withColumn("value", algebra.between_or_nodata(F.col("value"), low, high))
    box = frame.bounds
    col, row, n_cols, n_rows = target.window(box, "inclusive")
    part = target.cropped(col, row, n_cols, n_rows)
    moved = resample(spark, out, frame, part, how).select((F.col("row") + row).alias("row"), (F.col("col") + col).alias("col"), "value")
    return (fill_frame(spark, moved, target, fill) if fill is not None else moved), target


def is_standard(frame: Frame) -> bool:
    """Whether a frame is the global one of a supported resolution."""
    return any(frame == Frame.world(r) for r in RESOLUTIONS)


def standard_box(box: Sequence[float], arcseconds: float) -> tuple[float, float, float, float]:
    """The box grown to whole cells of a resolution, counted from the globe's corner."""
    res = arcseconds / 3600
    grown = snap((box[0] + 180, box[1] + 90, box[2] + 180, box[3] + 90), res)
    return grown[0] - 180, grown[1] - 90, grown[2] - 180, grown[3] - 90


def scaled_frame(frame: Frame, metres_per_degree: float = METRES_PER_DEGREE) -> Frame:
    """A frame in degrees relabelled in metres; cells are not resampled."""
    k = metres_per_degree
    return Frame(frame.ulx * k, frame.uly * k, frame.xres * k, frame.yres * k, frame.n_rows, frame.n_cols)


def transform_box(box: Sequence[float], transform: Callable[[float, float], tuple[float, float]], samples: int = 21) -> tuple[float, float, float, float]:
    """The box that holds the transformed edges, each sampled at equal steps."""
    steps = [i / (samples - 1) for i in range(samples)]
    xs = [box[0] + (box[2] - box[0]) * t for t in steps]
    ys = [box[1] + (box[3] - box[1]) * t for t in steps]
    points = [transform(x, y) for x in xs for y in (box[1], box[3])] + [transform(x, y) for y in ys for x in (box[0], box[2])]
    return min(p[0] for p in points), min(p[1] for p in points), max(p[0] for p in points), max(p[1] for p in points)


def composite_ids(df: DataFrame, names: Sequence[str], base: int = 1000, out: str = "pyramid_id") -> DataFrame:
    """Dense ids of each name column, their number in base ``base``, and dense ids of that number."""
    ids = [f"_{n}_id" for n in names]
    for n, i in zip(names, ids, strict=True):
        df = dense_ids(df, n, i)
    number = sum((F.col(i) * base**k for k, i in enumerate(reversed(ids))), F.lit(0).cast("long"))
    return dense_ids(df.withColumn("_number", F.lpad(number.cast("string"), 3 * len(names) + 3, "0")), "_number", out).drop("_number", *ids)


def dissolve(features: DataFrame, key: str, boxes: Mapping[str, Column]) -> DataFrame:
    """One row a key with the box of its features (``minx miny maxx maxy`` columns) and their number."""
    return features.groupBy(key).agg(F.min(boxes["minx"]).alias("minx"), F.min(boxes["miny"]).alias("miny"), F.max(boxes["maxx"]).alias("maxx"), F.max(boxes["maxy"]).alias("maxy"), F.count(F.lit(1)).alias("n"))
