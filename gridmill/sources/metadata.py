"""The dimension of rasters: one row a raster with frame, type and no-data value, and checks on it."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.operators.grid import RESOLUTIONS, Frame

SCHEMA = "raster_id string, n_rows int, n_cols int, ulx double, uly double, xres double, yres double, crs string, dtype string, ndv double, tile_size int"
FRAME_COLUMNS = ("n_rows", "n_cols", "ulx", "uly", "xres", "yres")


def rasters(spark: SparkSession, frames: Mapping[str, Frame], crs: str = "EPSG:4326", dtype: str = "float64", ndv: float = -9999.0, tile: int = 512) -> DataFrame:
    return spark.createDataFrame([(k, f.n_rows, f.n_cols, float(f.ulx), float(f.uly), float(f.xres), float(f.yres), crs, dtype, ndv, tile) for k, f in frames.items()], SCHEMA)


def frame_of(table: DataFrame, raster_id: str) -> Frame:
    r = table.filter(F.col("raster_id") == raster_id).first()
    if r is None:
        raise KeyError(raster_id)
    return Frame(r["ulx"], r["uly"], r["xres"], r["yres"], r["n_rows"], r["n_cols"])


def boxes(table: DataFrame) -> DataFrame:
    """(raster_id, minx, miny, maxx, maxy)."""
    return table.select("raster_id", F.col("ulx").alias("minx"), (F.col("uly") - F.col("n_rows") * F.col("yres")).alias("miny"), (F.col("ulx") + F.col("n_cols") * F.col("xres")).alias("maxx"), F.col("uly").alias("maxy"))


def common_box(table: DataFrame, mode: str = "intersection") -> DataFrame:
    """One row: the intersection or union of all boxes; no row if they do not overlap."""
    b = boxes(table)
    low, high = (F.max, F.min) if mode == "intersection" else (F.min, F.max)
    return b.agg(low("minx").alias("minx"), low("miny").alias("miny"), high("maxx").alias("maxx"), high("maxy").alias("maxy")).filter("minx < maxx AND miny < maxy")


def unaligned(table: DataFrame, reference: str) -> DataFrame:
    """Rasters whose frame differs from the reference's."""
    ref = table.filter(F.col("raster_id") == reference).select(*FRAME_COLUMNS)
    return table.join(ref, list(FRAME_COLUMNS), "left_anti").select("raster_id")


def agree(table: DataFrame, *columns: str) -> bool:
    """Whether all rasters have the same values of ``columns`` (nulls equal)."""
    return table.select(*columns).distinct().limit(2).count() <= 1


def resolutions(table: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """(raster_id, arcseconds): the supported resolution within ``tolerance`` of each cell size, else null."""
    near = F.array(*[F.struct(F.abs(F.col("xres") * 3600 - r).alias("off"), F.lit(r).alias("r")) for r in RESOLUTIONS])
    best = F.array_min(near)
    return table.select("raster_id", F.when(best["off"] <= tolerance * F.col("xres") * 3600, best["r"]).alias("arcseconds"))


def set_nodata(table: DataFrame, raster_id: str, ndv: float) -> DataFrame:
    """The header's no-data value changed, cells untouched."""
    return table.withColumn("ndv", F.when(F.col("raster_id") == raster_id, F.lit(ndv)).otherwise(F.col("ndv")))
