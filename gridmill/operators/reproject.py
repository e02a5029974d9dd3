"""Grids and features moved from one projection to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions.projection import Projection, between
from gridmill.operators.grid import Frame
from gridmill.operators.vector import rings
from gridmill.sources.cells import blank


def warp(spark: SparkSession, cells: DataFrame, source: Frame, source_projection: Projection, target: Frame, target_projection: Projection) -> DataFrame:
    """Cells on the target's frame, each with the value of the source cell that its centre falls into; places without one have no row."""
    x, y = F.lit(target.ulx) + (F.col("row") * 0 + F.col("col") + 0.5) * target.xres, F.lit(target.uly) - (F.col("row") + 0.5) * target.yres
    sx, sy = between(target_projection, source_projection)(x, y)
    found = blank(spark, target.n_rows, target.n_cols).drop("value")
    found = found.withColumn("_c", F.floor((sx - source.ulx) / source.xres).cast("long")).withColumn("_r", F.floor((F.lit(source.uly) - sy) / source.yres).cast("long"))
    inside = found.filter(F.col("_c").between(0, source.n_cols - 1) & F.col("_r").between(0, source.n_rows - 1))
    return inside.join(cells.select(F.col("row").alias("_r"), F.col("col").alias("_c"), "value"), ["_r", "_c"]).select("row", "col", "value")


def reproject_points(points: DataFrame, source: Projection, target: Projection, x: str = "x", y: str = "y") -> DataFrame:
    new_x, new_y = between(source, target)(F.col(x), F.col(y))
    return points.withColumn("_x", new_x).withColumn("_y", new_y).withColumn(x, F.col("_x")).withColumn(y, F.col("_y")).drop("_x", "_y")


def reproject_polygon(wkt: Column, source: Projection, target: Projection) -> Column:
    """A polygon with the corners of its rings moved."""
    def moved(p: Column) -> Column:
        x, y = between(source, target)(p["x"], p["y"])
        return F.concat_ws(" ", x.cast("string"), y.cast("string"))

    outer = F.transform(rings(wkt), lambda ring: F.concat(F.lit("("), F.array_join(F.transform(ring, moved), ","), F.lit(")")))
    return F.concat(F.lit("POLYGON("), F.array_join(outer, ","), F.lit(")"))
