"""Grids as DataFrames of cells, and how to get them.

A grid has one row a cell: ``row``, ``col``, ``value`` (NULL: no data) and, for
stacks, further key columns such as ``band``.  Metadata lives in a one-row-a-raster
dimension (``n_rows, n_cols, ulx, uly, xres, yres, dtype, ndv``).
"""

from __future__ import annotations

import io
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELLS = T.StructType([T.StructField("row", T.LongType()), T.StructField("col", T.LongType()), T.StructField("value", T.DoubleType())])
#: No-data values that formats use when none is stated, by type.
DEFAULT_NDV = {"byte": 255, "uint16": 65535, "int16": -9999, "uint32": 4294967295, "int32": -9999, "int64": -9999, "float32": -9999.0, "float64": -9999.0}


def from_keys(df: DataFrame, key: str, n_cols: int, value: Column | str, *more: Column) -> DataFrame:
    """Cells of a table whose dense whole-number key counts cells row by row."""
    k = F.col(key).cast("long")
    return df.select(F.floor(k / n_cols).cast("long").alias("row"), (k % n_cols).alias("col"), (F.col(value) if isinstance(value, str) else value).alias("value"), *more)


def blank(spark: SparkSession, n_rows: int, n_cols: int, value: float | None = None) -> DataFrame:
    """Every cell of an n_rows x n_cols grid with one value (default: no data)."""
    ids = spark.range(n_rows * n_cols)
    return ids.select(F.floor(F.col("id") / n_cols).cast("long").alias("row"), (F.col("id") % n_cols).alias("col"), F.lit(value).cast("double").alias("value"))


def pattern(spark: SparkSession, n_rows: int, n_cols: int, kind: str, seed: int = 42) -> DataFrame:
    """Test grids: gradient (value = row), checkerboard, concentric (distance to the centre), random."""
    grid = blank(spark, n_rows, n_cols)
    values = {
        "gradient": F.col("row").cast("double"),
        "checkerboard": ((F.col("row") + F.col("col")) % 2).cast("double"),
        "concentric": F.hypot(F.col("row") - n_rows // 2, F.col("col") - n_cols // 2),
        "random": F.rand(seed) * 100,
    }
    return grid.withColumn("value", values[kind])


def known_sum(spark: SparkSession, n_rows: int, n_cols: int, total: float) -> DataFrame:
    """Equal positive values that add up to ``total``; the last cell takes what rounding leaves."""
    n = n_rows * n_cols
    each = total / n
    last = (F.col("row") == n_rows - 1) & (F.col("col") == n_cols - 1)
    return blank(spark, n_rows, n_cols).withColumn("value", F.when(last, F.lit(total - each * (n - 1))).otherwise(F.lit(each)))


def without_nodata(df: DataFrame, ndv: float | None, value: str = "value") -> DataFrame:
    """Sentinels and NaN become NULL; an explicit ``ndv`` of 0 is a sentinel like any other."""
    bad = F.isnan(F.col(value).cast("double")) if ndv is None else F.isnan(F.col(value).cast("double")) | (F.col(value) == ndv)
    return df.withColumn(value, F.when(~bad, F.col(value)))


def with_nodata(df: DataFrame, ndv: float, value: str = "value") -> DataFrame:
    return df.withColumn(value, F.coalesce(F.col(value), F.lit(ndv)))


def to_alpha(df: DataFrame, replacement: float = 0.0) -> DataFrame:
    """No data replaced, with an alpha column of 0 or 255."""
    return df.withColumn("alpha", F.when(F.col("value").isNull(), 0).otherwise(255)).withColumn("value", F.coalesce("value", F.lit(replacement)))


def info(df: DataFrame) -> DataFrame:
    """One row: extent in cells, numbers of valid and no-data cells."""
    return df.agg((F.max("row") + 1).alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.count("value").alias("n_valid"), F.count_if(F.col("value").isNull()).alias("n_nodata"))


def window(df: DataFrame, row: int, col: int, n_rows: int, n_cols: int) -> DataFrame:
    """Cells of a window, in the grid's own coordinates; the ranges reach the Parquet scan."""
    return df.filter(F.col("row").between(row, row + n_rows - 1) & F.col("col").between(col, col + n_cols - 1))


def stride(df: DataFrame, step: int) -> DataFrame:
    """Every ``step``-th row and column, renumbered."""
    kept = df.filter((F.col("row") % step == 0) & (F.col("col") % step == 0))
    return kept.withColumn("row", F.floor(F.col("row") / step).cast("long")).withColumn("col", F.floor(F.col("col") / step).cast("long"))


def stride_for(n_rows: int, n_cols: int, most: int) -> int:
    """The least stride of 2 or more that leaves at most ``most`` cells (1 if all of them fit)."""
    if n_rows * n_cols <= most:
        return 1
    step = 2
    while (n_rows // step) * (n_cols // step) > most:
        step += 1
    return step


def flat(df: DataFrame, n_cols: int, name: str = "value") -> DataFrame:
    """(idx, name): the grid as one indexed column."""
    return df.select((F.col("row") * n_cols + F.col("col")).alias("idx"), F.col("value").alias(name))


def unflat(df: DataFrame, n_cols: int, name: str = "value") -> DataFrame:
    return df.select(F.floor(F.col("idx") / n_cols).cast("long").alias("row"), (F.col("idx") % n_cols).alias("col"), F.col(name).alias("value"))


def quad_order(df: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """``pos``: place of a cell when the quadrants follow one another: upper left, lower left, upper right, lower right."""
    top, left = n_rows // 2, n_cols // 2
    low, right = F.col("row") >= top, F.col("col") >= left
    width = F.when(right, n_cols - left).otherwise(left)
    before = F.when(right, F.lit(n_rows * left)).otherwise(0) + F.when(low, width * top).otherwise(0)
    inner = (F.col("row") - F.when(low, top).otherwise(0)) * width + F.col("col") - F.when(right, left).otherwise(0)
    return df.withColumn("pos", (before + inner).cast("long"))


def mosaic(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of grids of one coordinate frame; where they overlap the last one with data wins."""
    tagged = [f.select("row", "col", "value").withColumn("_order", F.lit(i)) for i, f in enumerate(frames)]
    union = reduce(DataFrame.unionByName, tagged)
    return union.groupBy("row", "col").agg(F.max_by("value", F.when(F.col("value").isNotNull(), F.col("_order"))).alias("value"))


def stack(frames: Mapping[str, DataFrame], name: str = "band") -> DataFrame:
    """Grids as one long table with a key column."""
    return reduce(DataFrame.unionByName, [f.withColumn(name, F.lit(k)) for k, f in frames.items()])


def select_dims(df: DataFrame, keep: Mapping[str, Sequence] | None = None, shift: Mapping[str, float] | None = None) -> DataFrame:
    """N-dimensional extract: values to keep a dimension, then numbers to add to a dimension."""
    for name, values in (keep or {}).items():
        df = df.filter(F.col(name).isin(list(values)))
    for name, by in (shift or {}).items():
        df = df.withColumn(name, F.col(name) + by)
    return df


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    return npy_cells(spark.read.format("binaryFile").load(path))


def npy_cells(files: DataFrame) -> DataFrame:
    """(path, band, row, col, value) of .npy files in rows (path, content); 1-D arrays are one row, 3-D arrays have bands."""

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                array = np.load(io.BytesIO(content), allow_pickle=False)
                array = array.reshape((1,) * (3 - array.ndim) + array.shape) if array.ndim < 3 else array
                for band in range(array.shape[0]):
                    for a in range(0, array.shape[1], 512):
                        part = array[band, a : a + 512]
                        r, c = np.indices(part.shape)
                        yield pd.DataFrame({"path": name, "band": band, "row": r.ravel() + a, "col": c.ravel(), "value": part.ravel().astype("float64")})

    return files.select("path", "content").mapInPandas(decode, "path string, band int, row long, col long, value double")


def read_ascii_grid(spark: SparkSession, path: str) -> DataFrame:
    """Cells of Esri ASCII grids (six header lines, then one text line a grid row), no-data values as NULL."""
    content = spark.read.text(path, wholetext=True).select(F.split("value", "\r?\n").alias("lines"))
    head = F.element_at(F.filter("lines", lambda x: F.lower(x).startswith("nodata_value")), 1)
    rows = content.select(F.regexp_extract(head, r"(?i)nodata_value\s+(\S+)", 1).cast("double").alias("ndv"), F.posexplode(F.filter("lines", lambda x: F.rlike(x, F.lit(r"^\s*[-+.\d]")))).alias("row", "line"))
    cells = rows.select("ndv", F.col("row").cast("long").alias("row"), F.posexplode(F.split(F.trim("line"), r"\s+")).alias("col", "value"))
    value = F.col("value").cast("double")
    return cells.select("row", F.col("col").cast("long").alias("col"), F.when(F.col("ndv").isNull() | (value != F.col("ndv")), value).alias("value"))


def parse_2d_text(df: DataFrame, text: str = "text") -> DataFrame:
    """Cells of comma- and line-separated numbers in a string column; other columns are kept."""
    rest = [c for c in df.columns if c != text]
    lines = df.select(*rest, F.posexplode(F.split(F.trim(F.col(text)), "\n")).alias("row", "_line"))
    return lines.select(*rest, F.col("row").cast("long").alias("row"), F.posexplode(F.split("_line", ",")).alias("col", "_v")).select(*rest, "row", F.col("col").cast("long").alias("col"), F.trim("_v").try_cast("double").alias("value"))


def write_tiled(df: DataFrame, path: str, tile: int = 512) -> None:
    """Parquet with one folder a tile row, sorted so that row and column ranges prune row groups."""
    tiled = df.withColumn("tile_row", F.floor(F.col("row") / tile).cast("int"))
    tiled.repartition("tile_row", F.floor(F.col("col") / tile)).sortWithinPartitions("row", "col").write.mode("overwrite").partitionBy("tile_row").parquet(path)


def read_tiled(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("tile_row")


def write_npy(df: DataFrame, n_cols: int, rows_per_block: int = 1024) -> DataFrame:
    """(first_row, content): the grid as .npy arrays of blocks of rows, missing cells NaN; write the rows with any binary sink."""

    def encode(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        first = int(key[0]) * rows_per_block
        block = np.full((int(frame["row"].max()) - first + 1, n_cols), np.nan)
        block[frame["row"].to_numpy() - first, frame["col"].to_numpy()] = frame["value"].to_numpy()
        out = io.BytesIO()
        np.save(out, block)
        return pd.DataFrame({"first_row": [first], "content": [out.getvalue()]})

    cells = df.select("row", "col", F.col("value").cast("double").alias("value"))
    return cells.groupBy(F.floor(F.col("row") / rows_per_block).alias("block")).applyInPandas(encode, "first_row long, content binary")
