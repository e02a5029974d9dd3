"""Features with attributes and WKT geometry: GeoJSON in and out, attribute filters, extents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.operators.vector import bounds


def read_geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """Features of GeoJSON files: the columns of ``properties`` (a schema) and ``wkt`` of points, polygons and multipolygons."""
    geometry = "type string, coordinates string"
    schema = f"features array<struct<properties: struct<{_struct(properties)}>, geometry: struct<{_struct(geometry)}>>>"
    return geometry_wkt(spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f")))


def geometry_wkt(rows: DataFrame) -> DataFrame:
    """The properties of parsed features ``f`` and ``wkt``."""
    kind = F.col("f.geometry.type")
    # Coordinates arrive as JSON text; WKT has the same numbers with other punctuation.
    flat = F.regexp_replace(F.regexp_replace("f.geometry.coordinates", r"\s+", ""), r"\[(-?[\d.eE+-]+),(-?[\d.eE+-]+)(?:,[^\]]*)?\]", "$1 $2")
    wkt = F.when(kind == "Point", F.concat(F.lit("POINT("), flat, F.lit(")"))).otherwise(F.concat(F.upper(kind), F.translate(flat, "[]", "()")))
    return rows.select("f.properties.*", wkt.alias("wkt"))


def _struct(schema: str) -> str:
    return ", ".join(": ".join(part.split(maxsplit=1)) for part in schema.split(","))


def to_geojson(features: DataFrame, wkt: str = "wkt") -> DataFrame:
    """One line of GeoJSON a polygon or point feature; write it with ``.write.text``."""
    kind = F.initcap(F.regexp_extract(wkt, r"^\s*(\w+)", 1))
    kind = F.when(kind == "Multipolygon", "MultiPolygon").otherwise(kind)
    inner = F.regexp_replace(F.regexp_extract(wkt, r"^\s*\w+\s*(.*)$", 1), r"(-?[\d.eE+-]+)\s+(-?[\d.eE+-]+)", "[$1,$2]")
    inner = F.when(kind == "Point", F.regexp_replace(inner, r"[()]", "")).otherwise(F.translate(inner, "()", "[]"))
    rest = F.to_json(F.struct(*[F.col(c) for c in features.columns if c != wkt]))
    return features.select(F.concat(F.lit('{"type":"Feature","properties":'), rest, F.lit(',"geometry":{"type":"'), kind, F.lit('","coordinates":'), inner, F.lit("}}")).alias("value"))


def select_features(features: DataFrame, column: str, values: Sequence) -> DataFrame:
    """Features whose attribute is one of ``values``, compared as text; none at all is an error."""
    kept = features.filter(F.col(column).cast("string").isin([str(v) for v in values]))
    if not kept.take(1):
        raise ValueError(f"no feature has {column} in {list(values)}")
    return kept


def split_by(features: DataFrame, key: str, path: str) -> None:
    """One folder of Parquet for each value of ``key``."""
    features.write.mode("overwrite").partitionBy(key).parquet(path)


def layer_info(features: DataFrame, wkt: str = "wkt") -> DataFrame:
    """One row: number of features and the box around them."""
    box = features.select(bounds(F.col(wkt)).alias("b"))
    return box.agg(F.count(F.lit(1)).alias("n"), F.min("b.minx").alias("minx"), F.min("b.miny").alias("miny"), F.max("b.maxx").alias("maxx"), F.max("b.maxy").alias("maxy"))


def buffered_box(wkt: Column, by: float) -> Column:
    """The feature's box grown on all sides, as WKT."""
    from gridmill.operators.grid import box_wkt

    b = bounds(wkt)
    return box_wkt(b["minx"] - by, b["miny"] - by, b["maxx"] + by, b["maxy"] + by)


def graticules(spark: SparkSession, degrees: int) -> DataFrame:
    """(id, wkt) of the square cells of a global net."""
    from gridmill.operators.grid import box_wkt

    across = 360 // degrees
    ids = spark.range(across * (180 // degrees))
    x, y = F.col("id") % across * degrees - 180, F.floor(F.col("id") / across) * degrees - 90
    return ids.select("id", box_wkt(x, y, x + degrees, y + degrees).alias("wkt"))


def shared_boxes(frames: Sequence[DataFrame], wkt: str = "wkt") -> DataFrame:
    """One row a layer with its number and box."""
    return reduce(DataFrame.unionByName, [layer_info(f, wkt).withColumn("layer", F.lit(i)) for i, f in enumerate(frames)])
