"""Aggregation of grids: by zone, by class, by block, and as a whole."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _clean(value: Column) -> Column:
    """NaN counts as no data."""
    return F.when(~F.isnan(value.cast("double")), value)


def with_zones(cells: DataFrame, zones: DataFrame) -> DataFrame:
    """Cells with the zone that covers them (row, col, zone)."""
    return cells.join(zones.filter(F.col("zone").isNotNull()), ["row", "col"])


def zonal_sums(zoned: DataFrame, zone: str = "zone", value: str = "value", counts: bool = True, drop: str | None = None) -> DataFrame:
    """(zone, sums[, counts]) of valid values.

    ``drop``: None keeps all zones; "nonpositive" drops zones whose sum is not
    positive (with counts: neither sum nor count); "any_zero" drops those where a result is 0.
    """
    v = _clean(F.col(value))
    out = zoned.groupBy(zone).agg(F.sum(v).alias("sums"), F.count(v).alias("counts"))
    if drop == "nonpositive":
        out = out.filter((F.col("sums") > 0) | (F.col("counts") > 0) if counts else F.col("sums") > 0)
    elif drop == "any_zero":
        out = out.filter((F.col("sums") != 0) & (F.col("counts") != 0) if counts else F.col("sums") != 0)
    return out if counts else out.drop("counts")


def zonal_stats(zoned: DataFrame, zone: str = "zone", value: str = "value") -> DataFrame:
    """min, max, mean, sums, counts and no-data counts; overlapping zones are simply more rows."""
    v = _clean(F.col(value))
    return zoned.groupBy(zone).agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.sum(v).alias("sums"), F.count(v).alias("counts"), F.count_if(v.isNull()).alias("nodata_count"))


def zonal_classes(zoned: DataFrame, classes: Sequence, zone: str = "zone", value: str = "value", weight: str | None = None, prefix: str = "class_") -> DataFrame:
    """A column for each listed class: its number of cells in the zone, or their weights' sum."""
    sums = [F.sum(F.when(F.col(value) == c, F.col(weight) if weight else F.lit(1)).otherwise(F.lit(0))).alias(f"{prefix}{c}") for c in classes]
    return zoned.filter(F.col(value).isNotNull()).groupBy(zone).agg(*sums)


def zonal_class_rows(zoned: DataFrame, zone: str = "zone", value: str = "value", weight: str | None = None) -> DataFrame:
    """(zone, class, n): the same in long form, for classes that are not known beforehand; values are cut to whole numbers."""
    rows = zoned.filter(F.col(value).isNotNull())
    return rows.groupBy(zone, F.col(value).cast("long").alias("class")).agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("n"))


def zonal_merge(frames: dict[str, DataFrame], zone: str = "zone") -> DataFrame:
    """Zonal sums of several zoned grids side by side: one pass over their union."""
    union = reduce(DataFrame.unionByName, [f.select(zone, F.col("value").cast("double").alias("value"), F.lit(k).alias("_name")) for k, f in frames.items()])
    return union.groupBy(zone).agg(*[F.sum(F.when(F.col("_name") == k, _clean(F.col("value")))).alias(k) for k in frames])


def attach(stats: DataFrame, attributes: DataFrame, zone: str = "zone") -> DataFrame:
    return attributes.join(stats, zone, "full")


def zonal_totals(zoned: DataFrame, threshold: float = 0.0, ignore: Sequence[float] = (), zone: str = "zone", value: str = "value", cell_hectares: float | None = None) -> DataFrame:
    """total = max(sum - threshold, 0), means by pixel and hectare, extremes and numbers of pixels; no pixels give means of 0."""
    v = _clean(F.col(value))
    v = F.when(~v.isin(list(ignore)), v) if ignore else v
    out = zoned.groupBy(zone).agg(F.greatest(F.lit(0.0), F.coalesce(F.sum(v), F.lit(0.0)) - threshold).alias("total"), F.count(v).alias("n_pixels"), F.min(v).alias("pixel_min"), F.max(v).alias("pixel_max"))
    out = out.withColumn("pixel_mean", F.coalesce(F.try_divide(F.col("total"), F.col("n_pixels")), F.lit(0.0)))
    return out.withColumn("hectare_mean", F.col("pixel_mean") / cell_hectares) if cell_hectares else out


def zone_cells(zones: DataFrame, tile: int = 256) -> DataFrame:
    """(zone, tile_row, tile_col, cells): the sorted places of each zone, a list for each tile of ``tile`` x ``tile`` cells that it touches.

    A list has at most ``tile`` ** 2 places, however large the zone is.
    """
    places = zones.filter(F.col("zone").isNotNull())
    by = [F.floor(F.col("row") / tile).alias("tile_row"), F.floor(F.col("col") / tile).alias("tile_col")]
    return places.groupBy("zone", *by).agg(F.sort_array(F.collect_list(F.struct("row", "col"))).alias("cells"))


def change_matrix(cells: DataFrame, classes: Sequence, before: str = "before", after: str = "after") -> DataFrame:
    """Numbers of cells by class before (rows) and after (columns); classes that are not listed are left out."""
    listed = cells.filter(F.col(before).isin(list(classes)) & F.col(after).isin(list(classes)))
    return listed.groupBy(F.col(before).alias("class")).agg(*[F.count_if(F.col(after) == c).alias(f"to_{c}") for c in classes])


def value_counts(cells: DataFrame, value: str = "value", skip_nodata: bool = True) -> DataFrame:
    kept = cells.filter(F.col(value).isNotNull()) if skip_nodata else cells
    return kept.groupBy(value).agg(F.count(F.lit(1)).alias("n"))


def distinct_values(cells: DataFrame, value: str = "value") -> DataFrame:
    return cells.filter(F.col(value).isNotNull()).select(value).distinct()


def histogram(cells: DataFrame, bins: int = 10, value: str = "value") -> DataFrame:
    """(bin, n) of equal widths from the least to the greatest value, which is in the last bin."""
    v = F.col(value).cast("double")
    ends = cells.agg(F.min(v).alias("_min"), F.max(v).alias("_max"))  # one row
    at = F.least(F.floor(F.try_divide((v - F.col("_min")) * bins, F.col("_max") - F.col("_min"))), F.lit(bins - 1))
    return cells.filter(v.isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.coalesce(at, F.lit(0)).cast("long").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def raster_stats(cells: DataFrame, value: str = "value") -> DataFrame:
    """min, max, mean, population standard deviation, sum, and numbers of valid, zero and nonzero cells."""
    v = _clean(F.col(value))
    return cells.agg(F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.sum(v).alias("sum"), F.count(v).alias("n_valid"), F.count_if(v != 0).alias("n_nonzero"))


def _block(k: int) -> list[Column]:
    return [F.floor(F.col(c) / k).cast("long").alias(c) for c in ("row", "col")]


def whole_blocks(cells: DataFrame, k: int, n_rows: int, n_cols: int) -> DataFrame:
    """Without the trailing rows and columns that do not fill a block."""
    return cells.filter((F.col("row") < n_rows // k * k) & (F.col("col") < n_cols // k * k))


def upscale(cells: DataFrame, k: int, how: str = "sum", value: str = "value") -> DataFrame:
    """k x k blocks by sum, avg, min, max, mode, first or median of valid values."""
    return cells.groupBy(*_block(k)).agg(getattr(F, how)(value).alias(value))


def downscale(cells: DataFrame, k: int, keep_sum: bool = False) -> DataFrame:
    """Each cell repeated k x k times, with its value shared out if sums are to be kept."""
    n = F.explode(F.sequence(F.lit(0), F.lit(k * k - 1))).alias("_i")
    value = F.col("value") / (k * k) if keep_sum else F.col("value")
    return cells.select("row", "col", value.alias("value"), n).select((F.col("row") * k + F.floor(F.col("_i") / k)).cast("long").alias("row"), (F.col("col") * k + F.col("_i") % k).cast("long").alias("col"), "value")


def class_stack(cells: DataFrame, k: int, classes: Sequence, value: str = "value") -> DataFrame:
    """Numbers of cells of each listed class in each k x k block."""
    return cells.groupBy(*_block(k)).agg(*[F.count_if(F.col(value) == c).alias(f"class_{c}") for c in classes])


def valid_proportion(cells: DataFrame, k: int, value: str = "value") -> DataFrame:
    """The share of each k x k block that has data (of all k * k places)."""
    return cells.groupBy(*_block(k)).agg((F.count(value) / F.lit(float(k * k))).alias("proportion"))


def tiles(cells: DataFrame, size: int) -> DataFrame:
    """Cells with the square tile that they are in (smaller at the edges)."""
    return cells.withColumn("tile_row", F.floor(F.col("row") / size).cast("long")).withColumn("tile_col", F.floor(F.col("col") / size).cast("long"))


def tile_sums(cells: DataFrame, size: int) -> DataFrame:
    return tiles(cells, size).groupBy("tile_row", "tile_col").agg(F.sum("value").alias("sums"), F.count("value").alias("counts"))
