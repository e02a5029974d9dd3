"""Further registered queries: files of all kinds, frames, projections, polygons, configuration cells, regression."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.checkpoints import ensure_checkpoint_dir
from gridmill.functions import projection, scalar, text
from gridmill.operators import algebra, focal, frames, grid, pyramid, regress, reproject, vector
from gridmill.plans import config, formula
from gridmill.queries.catalogue import ORACLE_SQL, QUERIES, _rounded, _t, events_grid, part_grid, query
from gridmill.queries.catalogue2 import _BOX_SQL, _ROWS_P, _n_rows, _part_frame, supplier_boxes
from gridmill.sources import cells as src
from gridmill.sources import features, metadata, netcdf, tables, tiff

__all__ = ["ORACLE_SQL", "QUERIES"]


def _folder(spark: SparkSession) -> str:
    """A new place in the folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/files-{uuid.uuid4().hex}"


# --- files ---------------------------------------------------------------------------------------


@query('SELECT "row", col, value FROM rp')
def npy_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    files = src.write_npy(part_grid(spark, sf), 50, 16).select(F.col("first_row").cast("string").alias("path"), "content")
    return src.npy_cells(files).filter("not isnan(value)").select((F.col("row") + F.col("path").cast("long")).alias("row"), "col", "value")


@query('SELECT "row", col, CASE WHEN size % 9 > 0 THEN value END AS value, CAST((SELECT max("row") + 1 FROM rp) - "row" // 16 * 16 AS DOUBLE) AS top FROM rp')
def tiff_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    p, frame, _ = _part_frame(spark, sf)
    holes = p.withColumn("value", F.when(F.col("size") % 9 > 0, F.col("value")))
    files = tiff.blocks(holes, frame, 16).select(F.col("first_row").cast("string").alias("path"), "content")
    back = tiff.cells(files).withColumn("row", F.col("row") + F.col("path").cast("long"))
    return back.join(p.select("row", "col"), ["row", "col"], "left_semi").select("row", "col", "value", F.col("uly").alias("top"))


@query("SELECT CAST(e.vec_id AS VARCHAR) AS path, CAST(k // 8 AS BIGINT) AS y, CAST(k % 8 AS BIGINT) AS x, CAST(embedding[k + 1] AS DOUBLE) AS value FROM embeddings e, range(64) d(k)")
def netcdf_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    @F.pandas_udf("binary")
    def encoded(vectors: pd.Series) -> pd.Series:
        return vectors.map(lambda v: netcdf.encode({"y": 8, "x": 8}, {"field": (("y", "x"), np.array(v, float).reshape(8, 8)), "x": (("x",), np.arange(8.0))}))

    files = _t(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("path"), encoded("embedding").alias("content"))
    found = netcdf.values(files, "field")
    return found.select("path", F.col("at")[0].alias("y"), F.col("at")[1].alias("x"), "value")


@query('SELECT "row" AS "row", col, value FROM rp')
def tile_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    src.write_tiled(part_grid(spark, sf).select("row", "col", "value"), path, 32)
    return src.read_tiled(spark, path).select("row", "col", "value")


@query("SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 1")
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    one, two = _folder(spark), _folder(spark)
    nation = _t(spark, sf, "nation").select("n_nationkey", "n_name", "n_regionkey")
    tables.write_csv(nation, one, quote_all=True)
    tables.write_csv(nation.filter("n_regionkey = 1"), two)
    back = tables.read_many_csv(spark, [one, two])
    return back.select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey"))


@query('SELECT "row", col, CASE WHEN size % 9 > 0 THEN round(value, 2) END AS value FROM rp')
def ascii_grid_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    p = part_grid(spark, sf).withColumn("value", F.when(F.col("size") % 9 > 0, F.round("value", 2)).otherwise(-9999.0))
    # A grid line holds a bounded number of columns; lines are put in order within the one file of the format.
    lines = p.groupBy("row").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("col", "value"))), lambda x: x["value"].cast("string"))).alias("value")).orderBy("row")
    head = spark.createDataFrame([(f"{k} {v}",) for k, v in (("ncols", 50), ("nrows", _n_rows(p)), ("xllcorner", 0), ("yllcorner", 0), ("cellsize", 1), ("NODATA_value", -9999))], "value string")
    head.coalesce(1).unionByName(lines.select("value")).coalesce(1).write.text(path)
    return src.read_ascii_grid(spark, path)


@query(f"SELECT id, CAST(id * 10 AS DOUBLE) AS v, 'POLYGON((' || x || ' ' || y || ',' || x || ' ' || (y + h) || ',' || (x + w) || ' ' || (y + h) || ',' || (x + w) || ' ' || y || ',' || x || ' ' || y || '))' AS wkt FROM {_BOX_SQL}")
def geojson_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    lines = features.to_geojson(supplier_boxes(spark, sf))
    lines.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "value", F.lit("]}")).alias("value")).repartition(1).write.text(path)
    one = spark.read.text(path)  # a collection a line
    one.write.text(f"{path}-lines")
    schema = "features array<struct<properties: struct<id: bigint, v: double>, geometry: struct<type: string, coordinates: string>>>"
    parsed = spark.read.schema(schema).json(f"{path}-lines").select(F.explode("features").alias("f"))
    return features.geometry_wkt(parsed).select("id", "v", "wkt")


@query("SELECT n_nationkey AS number, array_to_string([n_name, CAST(n_regionkey AS VARCHAR)], ',') AS line FROM nation WHERE n_nationkey BETWEEN 3 AND 9")
def crop_csv_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("number"), F.concat_ws(",", F.col("n_nationkey").cast("string"), "n_name", F.col("n_regionkey").cast("string"), F.lit("x")).alias("line"))
    return tables.crop_lines(lines, 3, 7, 1, 2)


@query("SELECT s_nationkey FROM supplier GROUP BY 1")
def attribute_keys(spark: SparkSession, sf: str) -> DataFrame:
    return tables.attribute_table(_t(spark, sf, "supplier"), "s_nationkey")


@query("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1")
def unique_keys(spark: SparkSession, sf: str) -> DataFrame:
    return tables.unique_keys(_t(spark, sf, "customer"), "c_mktsegment")


@query("SELECT CAST(n_regionkey AS VARCHAR) || '.' || n_name AS name, CAST(n_nationkey AS DOUBLE) AS value FROM nation")
def flatten_nested(spark: SparkSession, sf: str) -> DataFrame:
    inner = _t(spark, sf, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.collect_list(F.struct("n_name", F.col("n_nationkey").cast("double")))).alias("m"))
    nested = inner.agg(F.map_from_entries(F.collect_list(F.struct(F.col("n_regionkey").cast("string"), "m"))).alias("all"))
    return tables.flattened(nested, "all").select(F.explode("all").alias("name", "value"))


@query("SELECT coalesce(a.k, b.k) AS n_nationkey, CAST(a.n AS DOUBLE) AS customers, CAST(b.n AS DOUBLE) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def tables_beside(spark: SparkSession, sf: str) -> DataFrame:
    count = lambda t, k, n: _t(spark, sf, t).groupBy(F.col(k).alias("n_nationkey")).agg(F.count(F.lit(1)).alias(n))
    both = tables.beside([count("customer", "c_nationkey", "customers"), count("supplier", "s_nationkey", "suppliers")], "n_nationkey")
    return both.select("n_nationkey", F.col("customers").cast("double").alias("customers"), F.col("suppliers").cast("double").alias("suppliers"))


# --- made grids ----------------------------------------------------------------------------------


@query(f"SELECT r AS \"row\", c AS col, 7.0::DOUBLE AS value FROM (SELECT unnest(range({_ROWS_P})) AS r), range(50) b(c)")
def constant_grid(spark: SparkSession, sf: str) -> DataFrame:
    return src.blank(spark, _n_rows(part_grid(spark, sf)), 50, 7.0)


@query(f"SELECT r AS \"row\", c AS col, CAST(r AS DOUBLE) AS gradient, CAST((r + c) % 2 AS DOUBLE) AS checkerboard, round(sqrt((r - n // 2) ** 2 + (c - 25) ** 2), 6) AS concentric, round(100.0 / (n * 50), 9) AS even FROM (SELECT n, unnest(range(n)) AS r FROM (SELECT {_ROWS_P} AS n)), range(50) b(c) WHERE NOT (r = n - 1 AND c = 49)")
def pattern_grids(spark: SparkSession, sf: str) -> DataFrame:
    n = _n_rows(part_grid(spark, sf))
    made = {k: src.pattern(spark, n, 50, k) for k in ("gradient", "checkerboard", "concentric")} | {"even": src.known_sum(spark, n, 50, 100.0)}
    out = algebra.aligned(made)
    return _rounded(_rounded(out, 6, "concentric"), 9, "even").filter(f"not (row = {n - 1} and col = 49)").select("row", "col", *made)


@query("SELECT round(100.0, 6) AS total")
def known_sum_total(spark: SparkSession, sf: str) -> DataFrame:
    return src.known_sum(spark, _n_rows(part_grid(spark, sf)), 50, 100.0).agg(F.round(F.sum("value"), 6).alias("total"))


@query(f"SELECT CAST(max(x + w) - min(x) AS BIGINT) AS n_cols, CAST(max(y + h) - min(y) AS BIGINT) AS n_rows, count(*) AS n, CAST(min(x) AS DOUBLE) AS minx, CAST(max(y + h) AS DOUBLE) AS maxy FROM {_BOX_SQL}")
def grid_over_features(spark: SparkSession, sf: str) -> DataFrame:
    box = features.layer_info(supplier_boxes(spark, sf)).first()
    made = src.blank(spark, int(box["maxy"] - box["miny"]), int(box["maxx"] - box["minx"]))
    return made.agg((F.max("col") + 1).alias("n_cols"), (F.max("row") + 1).alias("n_rows")).select("n_cols", "n_rows", F.lit(box["n"]).cast("long").alias("n"), F.lit(box["minx"]).alias("minx"), F.lit(box["maxy"]).alias("maxy"))


@query('SELECT "row", col, coalesce(CASE WHEN size <> 10 THEN value END, 0) AS value, CASE WHEN size = 10 THEN 0 ELSE 255 END AS alpha FROM rp')
def alpha_band(spark: SparkSession, sf: str) -> DataFrame:
    return src.to_alpha(part_grid(spark, sf).withColumn("value", F.when(F.col("size") != 10, F.col("value")))).select("row", "col", "value", "alpha")


# --- algebra and columns -------------------------------------------------------------------------

_AB = "(SELECT a.\"row\", a.col, CAST(a.size AS DOUBLE) AS x, b.value AS y FROM rp a JOIN re b USING (\"row\", col))"


def _pair(spark: SparkSession, sf: str) -> DataFrame:
    a = part_grid(spark, sf).select("row", "col", F.col("size").cast("double").alias("value"))
    return algebra.aligned({"x": a, "y": events_grid(spark, sf).select("row", "col", "value")})


@query(f"SELECT \"row\", col, CASE WHEN x > 10 AND y > 20 THEN x + y END AS both_valid, CASE WHEN x > 0 AND y = 0 THEN 1 ELSE 0 END AS only_first, x + 1 AS plus_one FROM {_AB}")
def add_where_valid(spark: SparkSession, sf: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    made = _pair(spark, sf).select("row", "col", algebra.add_both_valid(x, y, (x > 10).cast("int"), (y > 20).cast("int")).alias("both_valid"), algebra.positive_where_zero(x, y).cast("int").alias("only_first"), algebra.add(x, F.lit(1.0)).alias("plus_one"))
    return made


@query("SELECT p_partkey, p_size // 7 * 7 AS low, (p_size + 6) // 7 * 7 AS high, lower(trim(s)) IN ('yes', 'true', 't', '1', 'y') AS flag, lower(s) = 'nan' AS nan FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, CASE p_size % 4 WHEN 0 THEN 'Yes' WHEN 1 THEN 'no' WHEN 2 THEN 'NaN' ELSE ' t ' END AS s FROM part)")
def scalar_helpers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_size") % 4
    s = F.when(k == 0, "Yes").when(k == 1, "no").when(k == 2, "NaN").otherwise(" t ")
    size = F.col("p_size").cast("long")
    return _t(spark, sf, "part").select("p_partkey", scalar.round_containing(size, 7, False).alias("low"), scalar.round_containing(size, 7, True).alias("high"), scalar.str_to_bool(s).alias("flag"), scalar.is_nan(s).alias("nan"))


@query("SELECT 1 AS place, 's_acctbal' AS name UNION ALL SELECT 2, 's_nationkey' UNION ALL SELECT 3, 's_name' UNION ALL SELECT 4, 's_suppkey'")
def column_order(spark: SparkSession, sf: str) -> DataFrame:
    s = _t(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    moved = frames.move_column(frames.move_column(frames.reorder(s, ["s_acctbal"]), "s_suppkey", "s_name", after=True), "s_nationkey", "s_name")
    return spark.createDataFrame([(i, c) for i, c in enumerate(moved.columns, start=1)], "place int, name string")


@query("SELECT true AS same, false AS other")
def same_multiset(spark: SparkSession, sf: str) -> DataFrame:
    o = _t(spark, sf, "orders").select("o_custkey")
    return spark.createDataFrame([(frames.same_multiset(o, o.orderBy(F.desc("o_custkey"))), frames.same_multiset(o, o.filter("o_custkey > 3").unionByName(o.filter("o_custkey < 3"))))], "same boolean, other boolean")


# --- features and frames -------------------------------------------------------------------------


@query(f"SELECT id, CAST(x - 2 AS DOUBLE) AS minx, CAST(y - 2 AS DOUBLE) AS miny, CAST(x + w + 2 AS DOUBLE) AS maxx, CAST(y + h + 2 AS DOUBLE) AS maxy FROM {_BOX_SQL} WHERE id % 3 = 1")
def buffered_boxes(spark: SparkSession, sf: str) -> DataFrame:
    chosen = features.select_features(supplier_boxes(spark, sf).withColumn("k", F.col("id") % 3), "k", [1])
    b = vector.bounds(features.buffered_box(F.col("wkt"), 2.0))
    return chosen.select("id", b["minx"].alias("minx"), b["miny"].alias("miny"), b["maxx"].alias("maxx"), b["maxy"].alias("maxy"))


@query("SELECT CAST(n_regionkey AS BIGINT) AS region, count(*) AS n FROM nation GROUP BY 1")
def split_features(spark: SparkSession, sf: str) -> DataFrame:
    path = _folder(spark)
    features.split_by(_t(spark, sf, "nation").withColumn("region", F.col("n_regionkey")), "region", path)
    return spark.read.parquet(path).groupBy(F.col("region").cast("long").alias("region")).agg(F.count(F.lit(1)).alias("n"))


@query('SELECT "row", col, 40.0 - "row" * 0.5 AS lat, -10 + col * 0.25 AS lon, "row" AS back_row, col AS back_col FROM rp')
def places_of_cells(spark: SparkSession, sf: str) -> DataFrame:
    f = grid.Frame(-10, 40, 0.25, 0.5, 10_000, 50)
    lat, lon = grid.latlon(f)
    r, c = grid.cell_of(f, F.col("lat"), F.col("lon"))
    return part_grid(spark, sf).select("row", "col", lat.cast("double").alias("lat"), lon.cast("double").alias("lon")).select("*", r.alias("back_row"), c.alias("back_col"))


@query("SELECT CAST(s_suppkey AS BIGINT) AS id, floor((s_acctbal - 5) / 10) * 10 AS minx, ceil((s_acctbal + 5) / 10) * 10 AS maxx FROM supplier")
def snapped_boxes(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("s_acctbal")
    return _t(spark, sf, "supplier").select(F.col("s_suppkey").cast("long").alias("id"), scalar.round_down_to_base(x - 5, 10).cast("double").alias("minx"), scalar.round_up_to_base(x + 5, 10).cast("double").alias("maxx"))


@query("SELECT 'snap' AS k, -12.5::DOUBLE AS minx, -3.0::DOUBLE AS miny, 7.5::DOUBLE AS maxx, 12.5::DOUBLE AS maxy UNION ALL SELECT 'standard', -12.5, -3.5, 7.5, 12.5 UNION ALL SELECT 'intersection', 2, 0, 5, 8 UNION ALL SELECT 'union', 0, -1, 9, 10 UNION ALL SELECT 'transformed', 1, -8, 21, 12")
def box_arithmetic(spark: SparkSession, sf: str) -> DataFrame:
    box = (-12.3, -3.0, 7.1, 12.1)
    found = {
        "snap": grid.snap(box, 0.5), "standard": pyramid.standard_box((-12.3, -3.1, 7.1, 12.1), 1800), "intersection": grid.intersection([(0, 0, 5, 10), (2, -1, 9, 8)]),
        "union": grid.union([(0, 0, 5, 10), (2, -1, 9, 8)]), "transformed": pyramid.transform_box((0, 1, 10, 6), lambda x, y: (2 * x + 1, 4 * y - 12)),
    }
    return spark.createDataFrame([(k, *map(float, v)) for k, v in found.items()], "k string, minx double, miny double, maxx double, maxy double")


@query("SELECT true AS same_frame, false AS other_frame, true AS world, false AS part, true AS crs_agree, false AS cells_agree")
def frame_checks(spark: SparkSession, sf: str) -> DataFrame:
    a, b = grid.Frame.world(3600), grid.Frame(0, 10, 1, 1, 10, 10)
    table = metadata.rasters(spark, {"a": a, "b": b})
    found = (grid.same_frame([a, grid.Frame.world(3600)]), grid.same_frame([a, b]), pyramid.is_standard(a), pyramid.is_standard(b), metadata.agree(table, "crs"), metadata.agree(table, "n_rows", "n_cols"))
    return spark.createDataFrame([found], "same_frame boolean, other_frame boolean, world boolean, part boolean, crs_agree boolean, cells_agree boolean")


@query('SELECT "row" // 4 AS "row", col // 4 AS col, round(avg(value) * 16, 4) AS value FROM rp GROUP BY 1, 2')
def overview_keeping_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(pyramid.overview_resample(part_grid(spark, sf), 4, keep_sum=True), 4, "value").select("row", "col", "value")


@query('SELECT "row", col, value FROM rp WHERE "row" % 4 < 2 AND size % 2 = 0')
def clip_to_mask(spark: SparkSession, sf: str) -> DataFrame:
    p = part_grid(spark, sf)
    return grid.clip_to(p, p.filter("row % 4 < 2 and size % 2 = 0")).select("row", "col", "value")


# --- projections ---------------------------------------------------------------------------------

_R = 6378137.0
_LON, _LAT = "(s_suppkey * 37 % 3600 / 10.0 - 180)", "(s_suppkey * 53 % 1600 / 10.0 - 80)"


@query(
    f"SELECT CAST(s_suppkey AS BIGINT) AS id, round(radians({_LON}) * cos(radians({_LAT})) * {_R}, 3) AS sin_x, round(radians({_LAT}) * {_R}, 3) AS sin_y, round(radians({_LON}) * cos(radians(30)) * {_R}, 3) AS area_x, "
    f"round(sin(radians({_LAT})) / cos(radians(30)) * {_R}, 3) AS area_y, round(ln(tan(pi() / 4 + radians({_LAT}) / 2)) * {_R}, 3) AS web_y, round({_LON}, 6) AS lon, round({_LAT}, 6) AS lat FROM supplier"
)
def projected_points(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    out = _t(spark, sf, "supplier").select(k.cast("long").alias("id"), (k * 37 % 3600 / 10.0 - 180).alias("lon0"), (k * 53 % 1600 / 10.0 - 80).alias("lat0"))
    lon, lat = F.col("lon0"), F.col("lat0")
    plain, sin, area, web = projection.geographic(), projection.sinusoidal(), projection.equal_area(30), projection.web_mercator()
    (sx, sy), (ax, ay), (_, wy) = (projection.between(plain, p)(lon, lat) for p in (sin, area, web))
    # Through all of them and back.
    back = projection.between(web, plain)(*projection.between(area, web)(*projection.between(sin, area)(sx, sy)))
    return out.select("id", *[F.round(c, 3).alias(n) for c, n in ((sx, "sin_x"), (sy, "sin_y"), (ax, "area_x"), (ay, "area_y"), (wy, "web_y"))], F.round(back[0], 6).alias("lon"), F.round(back[1], 6).alias("lat"))


@query(
    f"SELECT r AS \"row\", c AS col, rp.value FROM (SELECT r, c, degrees((c + 0.5) * 100000 / {_R} / cos((n - (r + 0.5)) * 100000 / {_R})) AS lon, degrees((n - (r + 0.5)) * 100000 / {_R}) AS lat, n FROM (SELECT least({_ROWS_P}, 60) AS n), range(80) a(r), range(60) b(c) WHERE r < n) g "
    "JOIN rp ON rp.\"row\" = floor(n - g.lat) AND rp.col = floor(g.lon) WHERE g.lon >= 0 AND g.lon < 50 AND g.lat <= n AND g.lat > 0"
)
def warp_to_sinusoidal(spark: SparkSession, sf: str) -> DataFrame:
    p = part_grid(spark, sf)
    n = min(_n_rows(p), 60)
    source, target = grid.Frame(0, n, 1, 1, n, 50), grid.Frame(0, n * 100_000, 100_000, 100_000, n, 60)
    return reproject.warp(spark, p, source, projection.geographic(), target, projection.sinusoidal())


@query(f"SELECT id, round(radians(x) * {_R}, 2) AS minx, round(radians(y / 100.0) * {_R}, 2) AS miny, round(radians(x + w) * {_R}, 2) AS maxx, round(radians((y + h) / 100.0) * {_R}, 2) AS maxy FROM {_BOX_SQL}")
def reprojected_boxes(spark: SparkSession, sf: str) -> DataFrame:
    flat = F.regexp_replace("wkt", r"(\d+) (\d+)", "$1 $2e-2")
    moved = reproject.reproject_polygon(flat, projection.geographic(), projection.plate_carree())
    b = vector.bounds(moved)
    return supplier_boxes(spark, sf).select("id", *[F.round(b[k], 2).alias(k) for k in ("minx", "miny", "maxx", "maxy")])


# --- regions and polygons ------------------------------------------------------------------------


@query("SELECT count(*) FILTER (value > 0) AS n_on, count(*) AS n_cells, count(DISTINCT value) AS n_values FROM (SELECT CAST(size > 25 AS INTEGER) AS value FROM rp)")
def outline_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Regions as polygons, rasterized again: the same cells."""
    p, frame, _ = _part_frame(spark, sf)
    shapes = vector.outlines(p.select("row", "col", (F.col("size") > 25).cast("int").alias("value")), frame)
    back = vector.covered(shapes, frame)
    return back.agg(F.count_if(F.col("value") > 0).alias("n_on"), F.count(F.lit(1)).alias("n_cells"), F.countDistinct("value").alias("n_values"))


@query()
def simplified_outlines(spark: SparkSession, sf: str) -> DataFrame:
    p, frame, _ = _part_frame(spark, sf)
    shapes = vector.outlines(p.select("row", "col", (F.col("size") > 25).cast("int").alias("value")), frame)
    return shapes.select("region", "n_cells", vector.simplify(F.col("wkt"), 1.5).alias("wkt"))


@query(
    "SELECT r AS \"row\", c AS col, min_by(value, (d, pr, pc)) AS value FROM (SELECT r, c, p.value, sqrt((r - p.\"row\") ** 2 + (c - p.col) ** 2) AS d, p.\"row\" AS pr, p.col AS pc FROM "
    f"(SELECT unnest(range({_ROWS_P})) AS r), range(50) b(c), (SELECT * FROM rp WHERE size <= 12) p WHERE r // 16 - p.\"row\" // 16 BETWEEN -1 AND 1 AND c // 16 - p.col // 16 BETWEEN -1 AND 1) GROUP BY 1, 2"
)
def interpolate_points(spark: SparkSession, sf: str) -> DataFrame:
    p = part_grid(spark, sf)
    return focal.interpolate_nearest(spark, p.filter("size <= 12").drop("size"), _n_rows(p), 50, 16)


_GAUSS = ", ".join(f"({r}, {c}, {w!r})" for (r, c), w in focal.gaussian().items() if r >= 0 and c >= 0)


@query(f"WITH k AS (SELECT * FROM (VALUES {_GAUSS}) AS v(dr, dc, w)) SELECT a.\"row\", a.col, round(sum(b.value * w), 4) AS value FROM rp a JOIN rp b ON abs(a.\"row\" - b.\"row\") <= 10 AND abs(a.col - b.col) <= 10 JOIN k ON dr = abs(a.\"row\" - b.\"row\") AND dc = abs(a.col - b.col) GROUP BY 1, 2".replace("WITH k AS", ", k AS"))
def convolve_gaussian_21(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(focal.convolve(part_grid(spark, sf).drop("size"), focal.gaussian()), 4, "value")


@query('SELECT a."row", a.col, min(b.value) AS low, max(b.value) AS high, count(*) AS n FROM rp a JOIN rp b ON abs(a."row" - b."row") <= 4 AND abs(a.col - b.col) <= 4 GROUP BY 1, 2')
def neighbourhood_extremes(spark: SparkSession, sf: str) -> DataFrame:
    p = part_grid(spark, sf).drop("size")
    made = {n: focal.focal(p, 4, h) for n, h in (("low", "min"), ("high", "max"), ("n", "count"))}
    return algebra.aligned(made).select("row", "col", "low", "high", F.col("n").cast("long").alias("n"))


# --- text and configuration cells ----------------------------------------------------------------


@query("SELECT page_id, replace(replace(url, 'a', 'o'), '/', '-') AS changed, CASE WHEN regexp_matches(url, '\\.[^./]*$') THEN regexp_replace(url, '(\\.[^./]*)$', '_v2\\1') ELSE url || '_v2' END AS numbered, trim(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '_') AS safe, 'file://' || replace(replace(replace(replace(url, '#', '%23'), '?', '%3F'), '=', '%3D'), '&', '%26') AS as_url, url AS back, regexp_replace(url, '(://).*?(/)', '\\1host\\2') AS hosted FROM pages")
def string_edits(spark: SparkSession, sf: str) -> DataFrame:
    u = F.col("url")
    as_url = F.replace(text.path_to_url(u), F.lit("%3A"), F.lit(":"))
    return _t(spark, sf, "pages").select("page_id", text.replace_many(u, {"a": "o", "/": "-"}).alias("changed"), text.insert_before_ext(u, "_v2").alias("numbered"), text.safe_string(u).alias("safe"), as_url.alias("as_url"), text.url_to_path(text.path_to_url(u)).alias("back"), text.replace_between(u, "://", "/", "host").alias("hosted"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events WHERE event_id IN (SELECT max_by(event_id, (date_trunc('second', ts), event_id)) FROM events GROUP BY event_type)")
def latest_by_timestamp(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("event_id", F.concat(F.lit("out/"), "event_type", F.lit("_"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit(".csv")).alias("path"), "event_type")
    stamped = e.withColumn("at", text.timestamp_in(F.col("path")))
    return stamped.groupBy("event_type").agg(F.max_by("event_id", F.struct("at", "event_id")).alias("event_id"), F.max("at").alias("at")).select("event_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents")
def content_hashes(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))


@query("SELECT p_partkey, CASE k WHEN 0 THEN 'template' WHEN 1 THEN 'list' WHEN 2 THEN 'dict' WHEN 3 THEN 'none' ELSE 'text' END AS kind, CASE k WHEN 0 THEN true ELSE false END AS has_mark, CASE k WHEN 5 THEN CAST(p_size AS DOUBLE) END AS number, CASE k WHEN 0 THEN 'area_' || p_brand || '_' || p_size ELSE s END AS filled FROM (SELECT *, CASE k WHEN 0 THEN '<^area^>_' || p_brand || '_<^size^>' WHEN 1 THEN '[' || p_size || ', b]' WHEN 2 THEN '{a: ' || p_size || '}' WHEN 3 THEN 'NaN' WHEN 4 THEN p_brand ELSE 'int(' || p_size || ')' END AS s FROM (SELECT *, p_partkey % 6 AS k FROM part))")
def configuration_cells(spark: SparkSession, sf: str) -> DataFrame:
    k, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    s = (
        F.when(k == 0, F.concat(F.lit("<^area^>_"), "p_brand", F.lit("_<^size^>"))).when(k == 1, F.concat(F.lit("["), size, F.lit(", b]"))).when(k == 2, F.concat(F.lit("{a: "), size, F.lit("}")))
        .when(k == 3, "NaN").when(k == 4, F.col("p_brand")).otherwise(F.concat(F.lit("int("), size, F.lit(")")))
    )
    filled = text.fill_template(s, {"area": F.lit("area"), "size": F.col("p_size")})
    return _t(spark, sf, "part").select("p_partkey", text.attribute_kind(F.lit("x"), s).alias("kind"), text.has_template(s).alias("has_mark"), text.cast_token(s).alias("number"), filled.alias("filled"))


@query("SELECT n_nationkey, 2 AS n_names, 'b' AS second, CAST(n_regionkey AS VARCHAR) AS value, 2017 + n_regionkey AS last_year, n_name AS plain FROM nation")
def literals_in_cells(spark: SparkSession, sf: str) -> DataFrame:
    marked = F.concat(F.lit("<^a^>_"), "n_name", F.lit("<^b^>"))
    names, pieces = text.template_names(marked), text.template_parts(marked)
    pairs = text.dict_literal(F.concat(F.lit("{k: "), F.col("n_regionkey").cast("string"), F.lit(", j: hello}")))
    years = text.years(F.concat(F.lit("2010 "), (F.col("n_regionkey") + 2017).cast("string")))
    return _t(spark, sf, "nation").select("n_nationkey", F.size(names).alias("n_names"), F.element_at(names, 2).alias("second"), pairs["k"].alias("value"), F.element_at(years, -1).alias("last_year"), F.substring(pieces[1]["text"], 2, 100).alias("plain"))


@query("SELECT 'base' AS name, '[1, 2.5, ''c'']' AS value UNION ALL SELECT 'key_base_year', '2017' UNION ALL SELECT 'data_path', '''a/b.csv''' UNION ALL SELECT 'dimensions', '[''lat'', ''lon'']' UNION ALL SELECT 'extra', '5' UNION ALL SELECT 'orientation', 'vertical' UNION ALL SELECT 'runs', '[{''a'': 1, ''b'': 2}, [''x'', ''y''], {''c'': 3}]' UNION ALL SELECT 'nested', '[''a'', ''[b,c]'', ''{d,e}'']'")
def parameters_of_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("base", "[int(1), float(2.5), c]"), ("key_base_year", "2017 2020"), ("data_path", "a/b.csv"), ("dimensions", "lat lon")]
    table = spark.createDataFrame(rows, "name string, value string")
    found = config.parameters(table, {"extra": 5}) | {"orientation": config.orientation(table), "runs": config.runs([{"a": 1}, {"b": 2}, "x", "y", {"c": 3}]), "nested": text.split_outside_brackets("a,[b,c],{d,e}")}
    return spark.createDataFrame([(k, v if k == "orientation" else repr(v)) for k, v in found.items()], "name string, value string")


@query("SELECT p_partkey, (p_partkey // 3600) || 'h ' || lpad(CAST(p_partkey // 60 % 60 AS VARCHAR), 2, '0') || 'm ' || lpad(CAST(p_partkey % 60 AS VARCHAR), 2, '0') || 's' AS took FROM part")
def pretty_times(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", text.pretty_seconds(F.col("p_partkey").cast("double")).alias("took"))


# --- regression ----------------------------------------------------------------------------------


@query("SELECT 'p_size' AS term, 1 AS place UNION ALL SELECT 'p_size_2', 2 UNION ALL SELECT 'p_size_p_retailprice', 3")
def formula_terms(spark: SparkSession, sf: str) -> DataFrame:
    f = formula.parse("p_retailprice ~ p_size + p_size^2 + p_size*p_retailprice + intercept")
    return spark.createDataFrame([(k, i) for i, k in enumerate(f.terms, start=1)], "term string, place int")


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) * p_retailprice AS product, round(2 + 3 * p_size + 0.5 * p_size ** 2, 6) AS predicted FROM part")
def predicted_values(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    f = formula.parse("p_retailprice ~ p_size + p_size^2 + intercept")
    weights = dict(zip(f.terms, (3.0, 0.5), strict=True)) | {"intercept": 2.0}
    made = regress.predict(formula.interaction(p, "p_size", "p_retailprice"), f, weights)
    product = next(c for c in made.columns if c not in (*p.columns, "predicted"))
    return made.select("p_partkey", F.col(product).alias("product"), F.round("predicted", 6).alias("predicted"))


@query(f"SELECT min(s) AS stride FROM range(1, 200) d(s), (SELECT {_ROWS_P} AS n) WHERE (s = 1 AND n * 50 <= 300) OR (s > 1 AND (n // s) * (50 // s) <= 300)")
def stride_for_sample(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([(src.stride_for(_n_rows(part_grid(spark, sf)), 50, 300),)], "stride long")


@query()
def logit_classes(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part").select("p_partkey", (F.col("p_size") > 25).cast("double").alias("large"), F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    _, counts = regress.logistic(p, "large ~ p_size + p_retailprice + intercept", "p_partkey")
    return counts


@query("SELECT 'x' AS kept, true AS found")
def lasso_terms(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("l_partkey")
    rows = _t(spark, sf, "lineitem").select(F.col("l_quantity").alias("x"), (F.xxhash64(k, F.col("l_orderkey")) % 1000 / 1000.0).alias("noise"), (3 * F.col("l_quantity") + 2).alias("y0"))
    weights, _ = regress.lasso(rows, "y0 ~ x + noise + intercept", folds=2, strengths=(0.1, 1.0))
    return spark.createDataFrame([(max(weights, key=lambda n: abs(weights[n])), abs(weights["x"]) > 1 and abs(weights["noise"]) < 0.5)], "kept string, found boolean")
