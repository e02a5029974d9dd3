"""Tables: CSV and JSON in and out, nested dictionaries, file listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, encodings: Sequence[str] = ("UTF-8", "ISO-8859-1"), **options: str) -> DataFrame:
    """A CSV with a header and inferred types, in the first encoding that decodes without replacement marks."""
    found = None
    for encoding in encodings:
        found = spark.read.options(header=True, inferSchema=True, encoding=encoding, **options).csv(path)
        raw = spark.read.options(encoding=encoding).text(path)
        if not raw.filter(F.contains("value", F.lit("�"))).limit(1).take(1):
            return found
    return found


def read_many_csv(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Vertical concatenation by position; the numbers of columns must agree."""
    frames = [read_csv(spark, p) for p in paths]
    if len({len(f.columns) for f in frames}) > 1:
        raise ValueError("the tables have different numbers of columns")
    return reduce(DataFrame.union, frames)


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    """CSV with a header; an empty table is refused."""
    if not df.take(1):
        raise ValueError("the table is empty")
    df.write.mode("overwrite").options(header=True, quoteAll=quote_all).csv(path)


def crop_lines(df: DataFrame, first_row: int, n_rows: int, first_col: int, n_cols: int, line: str = "line", number: str = "number") -> DataFrame:
    """A half-open rectangle of comma-separated lines."""
    kept = df.filter((F.col(number) >= first_row) & (F.col(number) < first_row + n_rows))
    return kept.withColumn(line, F.concat_ws(",", F.slice(F.split(F.col(line), ","), first_col + 1, n_cols)))


def from_nested(spark: SparkSession, nested: Mapping[str, Mapping[str, float]]) -> DataFrame:
    """(row_key, col_key, value) of a dictionary of dictionaries."""
    return spark.createDataFrame([(r, c, float(v)) for r, cols in nested.items() for c, v in cols.items()], "row_key string, col_key string, value double")


def to_maps(df: DataFrame, row_key: str = "row_key", col_key: str = "col_key", value: str = "value") -> DataFrame:
    """One row a row key with a map column from column key to value."""
    return df.groupBy(row_key).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(col_key, value)))).alias("cells"))


def from_maps(df: DataFrame, row_key: str = "row_key", cells: str = "cells") -> DataFrame:
    return df.select(row_key, F.explode(cells).alias("col_key", "value"))


def beside(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Tables of one key next to one another; columns of equal names take the table's number."""
    named = [f.select(key, *[F.col(c).alias(c if all(c not in g.columns for g in frames if g is not f) else f"{c}_{i}") for c in f.columns if c != key]) for i, f in enumerate(frames)]
    return reduce(lambda a, b: a.join(b, key, "full"), named)


def flattened(df: DataFrame, column: str, sep: str = ".") -> DataFrame:
    """``column``, a map of maps, as one map whose keys are both keys joined."""
    inner = F.transform(F.map_entries(column), lambda e: F.transform(F.map_entries(e["value"]), lambda x: F.struct(F.concat(e["key"], F.lit(sep), x["key"]), x["value"])))
    return df.withColumn(column, F.map_from_entries(F.flatten(inner)))


def unique_keys(df: DataFrame, key: str) -> DataFrame:
    """(key, n): the distinct keys of a vertical table, and how often each occurs."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def attribute_table(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """A dimension keyed by cell value: one row a distinct key."""
    return df.select(key, *columns).dropDuplicates([key])


def list_files(spark: SparkSession, path: str, include: Sequence[str] = (), extensions: Sequence[str] = (), exclude: Sequence[str] = (), recursive: bool = True) -> DataFrame:
    """(path, length, modificationTime) of files whose paths contain all of ``include`` and none of ``exclude``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).drop("content")
    for part in include:
        files = files.filter(F.contains("path", F.lit(part)))
    for part in exclude:
        files = files.filter(~F.contains("path", F.lit(part)))
    if extensions:
        files = files.filter(reduce(lambda a, b: a | b, [F.endswith("path", F.lit(e)) for e in extensions]))
    return files


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))
