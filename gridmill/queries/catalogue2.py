"""More registered queries: grids, focal operators, tables, text, regression, vectors, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import scalar, text
from gridmill.operators import focal, frames, grid, pyramid, regress, vector
from gridmill.plans import formula
from gridmill.queries.catalogue import ORACLE_SQL, QUERIES, _rounded, _t, embedding_grid, events_grid, line_zones, orders_grid, part_grid, query
from gridmill.sources import cells as src
from gridmill.sources import features, metadata, tables
from gridmill.streaming import windows

__all__ = ["ORACLE_SQL", "QUERIES"]

# --- frames of grids -----------------------------------------------------------------------------


@query("SELECT \"row\", col, value FROM ro WHERE \"row\" BETWEEN 20 AND 39 AND col BETWEEN 30 AND 59")
def clip_window(spark: SparkSession, sf: str) -> DataFrame:
    return src.window(orders_grid(spark, sf), 20, 30, 20, 30).select("row", "col", "value")


@query("SELECT \"row\" - 5 AS \"row\", col - 10 AS col, value FROM rp WHERE \"row\" BETWEEN 5 AND 14 AND col BETWEEN 10 AND 29")
def crop(spark: SparkSession, sf: str) -> DataFrame:
    return grid.crop(part_grid(spark, sf), 10, 5, 20, 10).select("row", "col", "value")


@query("SELECT \"row\" // 3 AS \"row\", col // 3 AS col, value FROM ro WHERE \"row\" % 3 = 0 AND col % 3 = 0")
def stride_sample(spark: SparkSession, sf: str) -> DataFrame:
    return src.stride(orders_grid(spark, sf), 3).select("row", "col", "value")


# Rows of the whole table: frames follow from how many there are.
_ROWS_P = '(SELECT max("row") + 1 FROM rp)'
_ROWS_E = '(SELECT max("row") + 1 FROM re)'
_SHIFT = f"(SELECT na, nb, least(na, nb) AS low, greatest(na, nb) AS high FROM (SELECT {_ROWS_P} AS na, {_ROWS_E} AS nb))"


def _n_rows(cells: DataFrame) -> int:
    return cells.agg(F.max("row").alias("m")).first()["m"] + 1


def _part_frame(spark: SparkSession, sf: str) -> tuple[DataFrame, grid.Frame, grid.Frame]:
    """The parts' grid, its frame of unit cells, and the frame of cells twice as large over the same rows."""
    p = part_grid(spark, sf)
    n = _n_rows(p)
    return p, grid.Frame(0, n, 1, 1, n, 50), grid.Frame(0, n, 2, 2, -(-n // 2), 25)


@query("SELECT coalesce(a.\"row\", b.\"row\") AS \"row\", coalesce(a.col, b.col) AS col, coalesce(b.value, a.value) AS value FROM rp a FULL JOIN (SELECT \"row\", col + 25 AS col, value FROM re) b ON a.\"row\" = b.\"row\" AND a.col = b.col")
def mosaic(spark: SparkSession, sf: str) -> DataFrame:
    return src.mosaic([part_grid(spark, sf), events_grid(spark, sf).withColumn("col", F.col("col") + 25)])


@query(f"SELECT r AS \"row\", c AS col, coalesce(value, -1) AS value FROM (SELECT unnest(range({_ROWS_P} + 4)) AS r), range(56) b(c) LEFT JOIN (SELECT \"row\" + 2 AS pr, col + 3 AS pc, value FROM rp) ON r = pr AND c = pc")
def pad_fill(spark: SparkSession, sf: str) -> DataFrame:
    p, f, _ = _part_frame(spark, sf)
    out, _ = grid.pad(spark, p, f, 2, 2, 3, 3, -1.0)
    return out


@query("SELECT (\"row\" - 1) // 2 AS \"row\", (col - 1) // 2 AS col, value FROM rp WHERE \"row\" % 2 = 1 AND col % 2 = 1")
def resample_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return grid.resample(spark, *_part_frame(spark, sf)).select("row", "col", "value")


@query("SELECT \"row\" // 2 AS \"row\", col // 2 AS col, round(avg(value), 6) AS value FROM rp GROUP BY 1, 2")
def resample_average(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(grid.resample(spark, *_part_frame(spark, sf), "average"), 6, "value")


@query("SELECT \"row\" // 2 AS \"row\", col // 2 AS col, round(avg(value), 6) AS value FROM rp GROUP BY 1, 2")
def resample_bilinear(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(grid.resample(spark, *_part_frame(spark, sf), "bilinear"), 6, "value")


@query("SELECT round(sum(value), 2) AS total FROM rp")
def resample_keeping_sum(spark: SparkSession, sf: str) -> DataFrame:
    return grid.resample_keeping_sum(spark, *_part_frame(spark, sf)).agg(F.round(F.sum("value"), 2).alias("total"))


def _two_frames(spark: SparkSession, sf: str) -> list[tuple[DataFrame, grid.Frame]]:
    a, b = part_grid(spark, sf), events_grid(spark, sf)
    na, nb = _n_rows(a), _n_rows(b)
    return [(a, grid.Frame(0, na, 1, 1, na, 50)), (b, grid.Frame(10, nb, 1, 1, nb, 100))]


@query(f"SELECT a.\"row\" - na + low AS \"row\", a.col - 10 AS col, a.value AS v0, b.value AS v1 FROM rp a, {_SHIFT}, re b WHERE b.\"row\" - nb = a.\"row\" - na AND b.col = a.col - 10")
def align_intersection(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = grid.aligned_stack(spark, _two_frames(spark, sf), 1.0)
    return out.select("row", "col", "v0", "v1")


@query(f"SELECT coalesce(a.r, b.r) AS \"row\", coalesce(a.c, b.c) AS col, a.value AS v0, b.value AS v1 FROM (SELECT \"row\" - na + high AS r, col AS c, value FROM rp, {_SHIFT}) a FULL JOIN (SELECT \"row\" - nb + high AS r, col + 10 AS c, value FROM re, {_SHIFT}) b ON a.r = b.r AND a.c = b.c")
def align_union(spark: SparkSession, sf: str) -> DataFrame:
    out, _ = grid.aligned_stack(spark, _two_frames(spark, sf), 1.0, "union")
    return out.select("row", "col", "v0", "v1")


@query("SELECT h, v, h * 10 AS col, v * 10 AS \"row\", CAST(10 AS BIGINT) AS n_cols, CAST(10 AS BIGINT) AS n_rows FROM range(36) a(h), range(18) b(v)")
def block_list(spark: SparkSession, sf: str) -> DataFrame:
    return grid.block_list(spark, 10, 1.0)


@query("SELECT CAST(x AS BIGINT) AS x, CAST(y AS BIGINT) AS y, CASE WHEN y >= 0 THEN 'n' ELSE 's' END || lpad(CAST(abs(y) AS VARCHAR), 2, '0') || CASE WHEN x >= 0 THEN 'e' ELSE 'w' END || lpad(CAST(abs(x) AS VARCHAR), 3, '0') AS tile FROM range(-15, 10, 5) a(x), range(-5, 15, 5) b(y)")
def tile_names(spark: SparkSession, sf: str) -> DataFrame:
    return grid.tile_names(spark, (-12.5, -3, 7, 12))


@query("SELECT \"row\" * 50 + col AS idx, value AS price FROM rp")
def flat_column(spark: SparkSession, sf: str) -> DataFrame:
    return src.flat(part_grid(spark, sf), 50, "price")


@query("SELECT max(\"row\") + 1 AS n_rows, max(col) + 1 AS n_cols, count(value) AS n_valid, count(*) FILTER (value IS NULL) AS n_nodata FROM re")
def raster_info(spark: SparkSession, sf: str) -> DataFrame:
    return src.info(events_grid(spark, sf))


@query("SELECT CAST(CASE WHEN size = 10 THEN NULL ELSE size END AS DOUBLE) AS value, count(*) AS n FROM rp GROUP BY 1")
def nodata_to_null(spark: SparkSession, sf: str) -> DataFrame:
    return src.without_nodata(part_grid(spark, sf).select(F.col("size").cast("double").alias("value")), 10).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_type AS band, \"row\" + 10 AS \"row\", count(*) AS n FROM re WHERE event_type IN (SELECT min(event_type) FROM re) GROUP BY 1, 2")
def select_dims(spark: SparkSession, sf: str) -> DataFrame:
    e = events_grid(spark, sf).withColumnRenamed("event_type", "band")
    first = e.agg(F.min("band").alias("b")).first()["b"]
    return src.select_dims(e, {"band": [first]}, {"row": 10}).groupBy("band", "row").agg(F.count(F.lit(1)).alias("n"))


# --- focal ---------------------------------------------------------------------------------------

_N3 = "SELECT a.\"row\", a.col, {agg} AS value FROM rp a JOIN rp b ON b.\"row\" BETWEEN a.\"row\" - 1 AND a.\"row\" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY 1, 2"


@query(_N3.format(agg="round(avg(b.value), 6)"))
def neighbourhood_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(focal.focal(part_grid(spark, sf).drop("size"), 1, "avg"), 6, "value")


@query(_N3.format(agg="round(sum(b.value * CASE WHEN a.\"row\" = b.\"row\" AND a.col = b.col THEN 4 WHEN a.\"row\" = b.\"row\" OR a.col = b.col THEN 2 ELSE 1 END) / 16, 6)"))
def convolve_3x3(spark: SparkSession, sf: str) -> DataFrame:
    kernel = {(r, c): (2 - abs(r)) * (2 - abs(c)) / 16 for r in (-1, 0, 1) for c in (-1, 0, 1)}
    return _rounded(focal.convolve(part_grid(spark, sf).drop("size"), kernel), 6, "value")


@query(_N3.format(agg="round(sum(b.value * w) / sum(w), 6)").replace("FROM rp a JOIN rp b", "FROM rp a JOIN (SELECT *, 1 AS w FROM rp WHERE size > 10) b"))
def convolve_ignoring_nodata(spark: SparkSession, sf: str) -> DataFrame:
    p = part_grid(spark, sf).withColumn("value", F.when(F.col("size") > 10, F.col("value"))).drop("size")
    return _rounded(focal.convolve(p, focal.square(1, 1 / 9), ignore_nodata=True).filter("value is not null"), 6, "value")


@query("SELECT a.\"row\", a.col, round(100 * sqrt((sum(b.value * (b.col - a.col) * CASE WHEN b.\"row\" = a.\"row\" THEN 2 ELSE 1 END) / 8) ** 2 + (sum(b.value * (b.\"row\" - a.\"row\") * CASE WHEN b.col = a.col THEN 2 ELSE 1 END) / 8) ** 2), 4) AS slope, round(sqrt(sum((b.value - a.value) ** 2)), 4) AS tri, round(any_value(a.value) - (sum(b.value) - any_value(a.value)) / 8, 4) + 0.0 AS tpi, round(max(b.value) - min(b.value), 4) AS roughness FROM rp a JOIN rp b ON b.\"row\" BETWEEN a.\"row\" - 1 AND a.\"row\" + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.\"row\", a.col HAVING count(*) = 9")
def terrain(spark: SparkSession, sf: str) -> DataFrame:
    out = _rounded(focal.terrain(part_grid(spark, sf)), 4, "slope", "tri", "tpi", "roughness")
    return out.select("row", "col", "slope", "tri", (F.col("tpi") + 0.0).alias("tpi"), "roughness")  # no -0


@query("SELECT r AS \"row\", c AS col, coalesce(value, -1) AS value FROM range(-1, 4) a(r), range(-1, 4) b(c) LEFT JOIN rp ON \"row\" = r AND col = c")
def neighbourhood_of_place(spark: SparkSession, sf: str) -> DataFrame:
    return focal.around(part_grid(spark, sf).drop("size"), 1, 1, 2, -1.0)


@query("SELECT a.\"row\", a.col, round(sqrt(min((a.\"row\" - b.\"row\") ** 2 + (a.col - b.col) ** 2)), 6) AS distance FROM rp a, (SELECT * FROM rp WHERE size = 7) b GROUP BY 1, 2")
def distance_transform(spark: SparkSession, sf: str) -> DataFrame:
    p = part_grid(spark, sf)
    return _rounded(focal.distance_transform(p.withColumn("value", (F.col("size") == 7).cast("int")), _n_rows(p), 50), 6, "distance")


# --- tables --------------------------------------------------------------------------------------


@query("SELECT c_nationkey, round(sum(c_acctbal), 2) AS c_acctbal, array_to_string(list_sort(list(DISTINCT c_mktsegment)), '^') AS c_mktsegment FROM customer GROUP BY c_nationkey")
def groupby_concat_unique(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").select("c_nationkey", "c_acctbal", "c_mktsegment")
    return _rounded(frames.group(c, ["c_nationkey"], ["c_acctbal"], preserve="all"), 2, "c_acctbal")


@query("SELECT n_nationkey, round(sum(c_acctbal), 2) AS c_acctbal, max(n_name) AS n_name FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey")
def groupby_keep_valid(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").join(_t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_nationkey", "n_name", "c_acctbal", "c_name")
    return _rounded(frames.group(c, ["n_nationkey"], ["c_acctbal"], preserve="valid"), 2, "c_acctbal").select("n_nationkey", "c_acctbal", "n_name")


@query("SELECT c_mktsegment, round(avg(c_acctbal), 4) AS c_acctbal, count(c_custkey) AS c_custkey FROM customer GROUP BY c_mktsegment")
def groupby_named_aggs(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(frames.group(_t(spark, sf, "customer"), ["c_mktsegment"], aggs={"c_acctbal": "avg", "c_custkey": "count"}), 4, "c_acctbal")


_PAIR = "(SELECT n_nationkey AS id, n_name AS name FROM nation) l {} JOIN (SELECT n_nationkey + 5 AS id, n_name AS name, CAST(n_regionkey AS DOUBLE) AS n_regionkey FROM nation) r ON l.id = r.id"


@query("SELECT coalesce(l.id, r.id) AS id, l.name, r.name AS name_right, n_regionkey FROM " + _PAIR.format("FULL"))
def merge_outer_suffix(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation")
    return frames.merge(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), n.select((F.col("n_nationkey") + 5).alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("double").alias("n_regionkey")))


@query("SELECT l.id, l.name, n_regionkey FROM " + _PAIR.format("LEFT"))
def merge_quick(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation")
    return frames.merge(n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")), n.select((F.col("n_nationkey") + 5).alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").cast("double").alias("n_regionkey")), "id", "left", clash="keep_left")


@query("SELECT k, a.n AS n_c, b.n AS n_s, d.n AS n_n FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b USING (k) FULL JOIN (SELECT n_nationkey AS k, CAST(n_regionkey AS BIGINT) AS n FROM nation) d USING (k)")
def merge_nway(spark: SparkSession, sf: str) -> DataFrame:
    c = _t(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    s = _t(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").cast("long").alias("n"))
    return frames.merge_all([c, s, n], "k", ["c", "s", "n"])


@query("SELECT n_nationkey AS k, n_name, round(sum(c_acctbal), 2) AS balance FROM nation LEFT JOIN (SELECT CASE WHEN c_nationkey < 5 THEN c_nationkey + 10 ELSE c_nationkey END AS k, c_acctbal FROM customer) ON n_nationkey = k GROUP BY n_nationkey, n_name")
def merge_remap(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    remap = n.filter("k < 5").select(F.col("k").alias("old"), (F.col("k") + 10).alias("new"))
    c = _t(spark, sf, "customer").select(F.col("c_nationkey").alias("k"), "c_acctbal")
    return frames.merge_remapped(n, c, remap, "k", "old", "new").groupBy("k", "n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("balance"))


@query()
def merge_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    other = n.select(F.concat(F.initcap("name"), F.lit("s")).alias("name"), (F.col("n_nationkey") * 10).alias("code"))
    return frames.fuzzy_merge(n.withColumn("name", F.lower("name")), other.withColumn("name", F.lower("name")), "name", "left")


@query("SELECT c_nationkey, c_mktsegment AS seg, round(sum(c_acctbal), 2) AS bal FROM customer GROUP BY 1, 2")
def group_two_keys(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("seg")).agg(F.round(F.sum("c_acctbal"), 2).alias("bal"))


@query("SELECT zone, round(sum(value) FILTER (flag = 'A'), 2) AS \"value-A\", round(sum(value) FILTER (flag = 'R'), 2) AS \"value-R\" FROM lz WHERE flag IN ('A', 'R') GROUP BY zone")
def pivot_vertical_up(spark: SparkSession, sf: str) -> DataFrame:
    z = line_zones(spark, sf).groupBy("zone", "flag").agg(F.sum("value").alias("value"))
    return _rounded(frames.pivot_up(z, ["zone"], "flag", ["value"], ["A", "R"], filters={"flag": ["A", "R"]}), 2, "value-A", "value-R")


@query("SELECT zone, flag, round(v - f, 2) AS difference, round((v - f) / v * 100, 6) AS percent_change FROM (SELECT zone, flag, v, max(v) FILTER (flag = 'A') OVER (PARTITION BY zone) AS f FROM (SELECT zone, flag, sum(value) AS v FROM lz GROUP BY ALL))")
def pct_change_from_focal(spark: SparkSession, sf: str) -> DataFrame:
    z = line_zones(spark, sf).groupBy("zone", "flag").agg(F.sum("value").alias("v"))
    out = frames.change_from_focal(z, ["zone"], "flag", "A", "v").drop("v")
    return out.select("zone", "flag", F.round("difference", 2).alias("difference"), F.round("percent_change", 6).alias("percent_change"))


@query("SELECT event_id, coalesce(CASE WHEN value > 50 THEN value END, CAST(user_id AS DOUBLE)) AS filled FROM events")
def fill_nan_from_right(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events").select("event_id", F.when(F.col("value") > 50, F.col("value")).alias("a"), F.col("user_id").cast("double").alias("b"))
    return frames.fill_from(e, "a", "b", "filled")


@query("SELECT coalesce(a, b) AS value, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'both' WHEN a IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS side FROM (SELECT DISTINCT c_nationkey % 20 AS a FROM customer) FULL JOIN (SELECT DISTINCT s_nationkey % 15 + 10 AS b FROM supplier) ON a = b")
def set_compare(spark: SparkSession, sf: str) -> DataFrame:
    return frames.compare_sets(_t(spark, sf, "customer").select((F.col("c_nationkey") % 20).alias("k")), _t(spark, sf, "supplier").select((F.col("s_nationkey") % 15 + 10).alias("k")), "k")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def find_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return frames.duplicates(_t(spark, sf, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT p_type AS value, min(p_partkey) AS pos FROM part GROUP BY p_type")
def distinct_in_order(spark: SparkSession, sf: str) -> DataFrame:
    return frames.distinct_in_order(_t(spark, sf, "part").select(F.col("p_type").alias("value"), F.col("p_partkey").alias("pos")), "value", "pos")


@query("SELECT 'n_nationkey' AS \"column\", count(DISTINCT n_nationkey) AS n_distinct, CAST(0 AS BIGINT) AS n_null FROM nation UNION ALL SELECT 'n_name', count(DISTINCT n_name), 0 FROM nation UNION ALL SELECT 'n_regionkey', count(DISTINCT n_regionkey), 0 FROM nation")
def column_profile(spark: SparkSession, sf: str) -> DataFrame:
    return frames.column_profile(_t(spark, sf, "nation"))


@query("SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size, p_name FROM part")
def smart_cast(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("p_size"), "p_name")
    return frames.smart_cast(p)


@query("SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) * 2 AS twice FROM events")
def json_flex(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return _t(spark, sf, "events").select("event_id", k.alias("k"), (k.try_cast("long") * 2).alias("twice"))


@query()
def flex_parse_column(spark: SparkSession, sf: str) -> DataFrame:
    return frames.parse_flex_column(_t(spark, sf, "events").select("event_id", "props"), "props", "parsed")


@query("SELECT row_key, count(*) AS n, round(sum(value), 2) AS total FROM (SELECT p_brand AS row_key, p_type AS col_key, max(p_retailprice) AS value FROM part GROUP BY 1, 2) GROUP BY row_key")
def nested_maps(spark: SparkSession, sf: str) -> DataFrame:
    flat = _t(spark, sf, "part").groupBy(F.col("p_brand").alias("row_key"), F.col("p_type").alias("col_key")).agg(F.max("p_retailprice").alias("value"))
    back = tables.from_maps(tables.to_maps(flat))
    return back.groupBy("row_key").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


# --- text ----------------------------------------------------------------------------------------


@query("SELECT n_nationkey, 'nation ' || n_name || ' of region ' || n_regionkey || ' <^other^>' AS text, 3 AS n_names FROM nation".replace("3 AS", "CAST(3 AS BIGINT) AS"))
def cat_ears_template(spark: SparkSession, sf: str) -> DataFrame:
    template = F.lit("nation <^name^> of region <^region^> <^other^>")
    return _t(spark, sf, "nation").select("n_nationkey", text.fill_template(template, {"name": F.col("n_name"), "region": F.col("n_regionkey")}).alias("text"), F.size(text.template_names(template)).cast("long").alias("n_names"))


@query("SELECT page_id, regexp_extract(regexp_extract(url, '^(.*)/[^/]*$', 1), '^(.*)/[^/]*$', 1) AS prior, regexp_extract(regexp_extract(url, '^(.*)/[^/]*$', 1), '([^/]*)$', 1) AS parent, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\\.[^.]*$', '') AS root FROM pages")
def path_parts(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "pages").select("page_id", text.path_parts(F.col("url")).alias("p"))
    return p.select("page_id", "p.prior", "p.parent", "p.root")


@query("SELECT page_id, split_part(url, '://', 1) AS scheme, list_extract(string_split(split_part(url, '://', 2), '/'), 1) AS host FROM pages")
def url_parts(spark: SparkSession, sf: str) -> DataFrame:
    both = text.split_two(F.col("url"), "://")
    return _t(spark, sf, "pages").select("page_id", both[0].alias("scheme"), F.split(both[1], "/")[0].alias("host"))


@query("SELECT o_orderkey, CASE WHEN s IN ('TRUE','True','true','T','t','1','FALSE','False','false','F','f','0') THEN 'bool' WHEN contains(s, '.') AND TRY_CAST(s AS DOUBLE) IS NOT NULL THEN 'float' WHEN TRY_CAST(s AS BIGINT) IS NOT NULL THEN 'int' ELSE 'str' END AS kind FROM (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN '2.5' WHEN 2 THEN o_orderstatus ELSE 'true' END AS s FROM orders)")
def implied_types(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, F.col("o_orderkey").cast("string")).when(k == 1, "2.5").when(k == 2, F.col("o_orderstatus")).otherwise("true")
    return _t(spark, sf, "orders").select("o_orderkey", scalar.implied_type(s)["kind"].alias("kind"))


@query("SELECT n_nationkey, trim(string_split(s, ',')[2]) AS second, len(string_split(s, ',')) AS n FROM (SELECT n_nationkey, n_name || ', ' || n_regionkey || ', x' AS s FROM nation)")
def list_literals(spark: SparkSession, sf: str) -> DataFrame:
    parts = text.list_literal(F.concat(F.lit("["), F.col("n_name"), F.lit(", "), F.col("n_regionkey").cast("string"), F.lit(", x]")))
    return _t(spark, sf, "nation").select("n_nationkey", parts[1].alias("second"), F.size(parts).cast("long").alias("n"))


@query("SELECT n_nationkey, r AS \"row\", c AS col, CAST((r + 1) * (c + 2) + n_nationkey AS DOUBLE) AS value FROM nation, range(3) a(r), range(4) b(c)")
def parse_2d_text(spark: SparkSession, sf: str) -> DataFrame:
    line = lambda r: F.concat_ws(",", *[(F.lit((r + 1) * (c + 2)) + F.col("n_nationkey")).cast("string") for c in range(4)])
    return src.parse_2d_text(_t(spark, sf, "nation").select("n_nationkey", F.concat_ws("\n", *[line(r) for r in range(3)]).alias("text")))


# --- regression ----------------------------------------------------------------------------------


@query("SELECT 'p_size' AS term, round(regr_slope(p_retailprice, p_size), 6) AS coefficient, round(regr_r2(p_retailprice, p_size), 6) AS r2, count(*) AS n FROM part UNION ALL SELECT 'intercept', round(regr_intercept(p_retailprice, p_size), 6), round(regr_r2(p_retailprice, p_size), 6), count(*) FROM part")
def ols_simple(spark: SparkSession, sf: str) -> DataFrame:
    out = regress.least_squares(_t(spark, sf, "part"), "p_retailprice ~ p_size + intercept")
    return out.select("term", F.round("coefficient", 6).alias("coefficient"), F.round("r2", 6).alias("r2"), "n")


@query("SELECT p_retailprice AS y, CAST(p_size AS DOUBLE) AS p_size, CAST(p_size AS DOUBLE) ** 2 AS \"p_size_2\", round(ln(p_retailprice), 9) AS \"log_p_retailprice\", CAST(p_size = 5 AS INTEGER)::DOUBLE AS \"p_size_5\" FROM part WHERE p_size IN (1, 5, 10, 20) AND p_retailprice > 1000")
def design_matrix(spark: SparkSession, sf: str) -> DataFrame:
    out = formula.design(_t(spark, sf, "part"), "p_retailprice ~ p_size + p_size^2 + log(p_retailprice) + dummy(p_size)[5] + valuemask(p_size)[1,5,10,20] + conditionalmask(p_retailprice, 1000, >) + intercept")
    return _rounded(out, 9, "log_p_retailprice")


@query()
def ols_multiple(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(regress.least_squares(_t(spark, sf, "lineitem"), "l_extendedprice ~ l_quantity + l_discount + l_quantity*l_discount + l_quantity^2 + intercept"), 6, "coefficient", "std_error", "t", "p_value", "r2", "aic")


# --- vectors -------------------------------------------------------------------------------------

# A box for each supplier, dealt over the grid of parts: 2 to 6 cells high, 3 to 9 wide, each over several others at any size.
_BOX_SQL = "(SELECT s_suppkey AS id, s_suppkey * 7 % 41 AS x, s_suppkey * 13 // 40 AS y, 3 + s_nationkey % 7 AS w, 2 + s_suppkey % 5 AS h FROM supplier)"
_TOP = f"(SELECT {_ROWS_P} AS top)"


def supplier_boxes(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    boxes = _t(spark, sf, "supplier").select(k.alias("id"), (k * 7 % 41).alias("x"), F.floor(k * 13 / 40).cast("long").alias("y"), (F.col("s_nationkey").cast("long") % 7 + 3).alias("w"), (k % 5 + 2).alias("h"))
    return boxes.select("id", grid.box_wkt(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias("wkt"), (F.col("id") * 10.0).alias("v"))


@query(f"SELECT top - 1 - (y + dy) AS \"row\", x + dx AS col, CAST(max(id) * 10 AS DOUBLE) AS value FROM {_BOX_SQL}, {_TOP}, range(9) a(dx), range(6) b(dy) WHERE dx < w AND dy < h AND y + dy < top AND x + dx < 50 GROUP BY 1, 2")
def rasterize_last(spark: SparkSession, sf: str) -> DataFrame:
    return vector.rasterize(supplier_boxes(spark, sf), _part_frame(spark, sf)[1], "v", "id")


@query(f"SELECT id, count(*) AS n, round(sum(value), 2) AS sums FROM {_BOX_SQL}, {_TOP}, range(9) a(dx), range(6) b(dy), rp WHERE dx < w AND dy < h AND rp.\"row\" = top - 1 - (y + dy) AND rp.col = x + dx GROUP BY id")
def zonal_by_polygon(spark: SparkSession, sf: str) -> DataFrame:
    p, frame, _ = _part_frame(spark, sf)
    inside = vector.covered(supplier_boxes(spark, sf), frame).select("id", "row", "col")
    return inside.join(p, ["row", "col"]).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("sums"))


@query(f"SELECT p.id AS a, q.id AS b FROM {_BOX_SQL} p, {_BOX_SQL} q WHERE p.id < q.id AND p.x < q.x + q.w AND q.x < p.x + p.w AND p.y < q.y + q.h AND q.y < p.y + p.h")
def overlapping_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return vector.touching_boxes(supplier_boxes(spark, sf), "id", 10.0)


@query()
def disjoint_polygon_sets(spark: SparkSession, sf: str) -> DataFrame:
    return vector.disjoint_sets(supplier_boxes(spark, sf), "id", 10.0)


_REACH = "SELECT id, id AS root FROM g UNION SELECT e.b, r.root FROM reach r JOIN e ON e.a = r.id"
_SIDES = "SELECT p.id AS a, q.id AS b FROM g p JOIN g q ON p.value = q.value AND ((p.\"row\" = q.\"row\" AND abs(p.col - q.col) = 1) OR (p.col = q.col AND abs(p.\"row\" - q.\"row\") = 1))"


@query(
    f"SELECT * FROM (WITH RECURSIVE g AS (SELECT \"row\", col, CAST(size > 25 AS INTEGER) AS value, \"row\" * 2147483648 + col AS id FROM rp), e AS ({_SIDES}), reach AS ({_REACH}), least AS (SELECT id, min(root) AS region FROM reach GROUP BY id) "
    "SELECT region, value, count(*) AS n_cells, min(\"row\") AS min_row, min(col) AS min_col, max(\"row\") AS max_row, max(col) AS max_col FROM g JOIN least USING (id) GROUP BY region, value)"
)
def connected_regions(spark: SparkSession, sf: str) -> DataFrame:
    p = part_grid(spark, sf).select("row", "col", (F.col("size") > 25).cast("int").alias("value"))
    return vector.region_boxes(p)


# --- windows in time -----------------------------------------------------------------------------


@query("SELECT date_trunc('day', ts) AS window_start, event_type AS zone, round(sum(value), 2) AS sums, count(value) AS counts FROM events GROUP BY 1, 2")
def daily_zonal_sums(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(windows.windowed_sums(_t(spark, sf, "events"), "event_type", "value"), 2, "sums")


@query("SELECT zone, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM rb GROUP BY zone")
def embedding_zone_stats(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_grid(spark, sf).groupBy("zone").agg(F.round(F.avg(F.col("value").cast("double")), 6).alias("mean"), F.round(F.stddev_pop(F.col("value").cast("double")), 6).alias("std"))


# --- pyramids and more ---------------------------------------------------------------------------


@query("SELECT CAST(k AS INTEGER) AS level, \"row\" // k AS \"row\", col // k AS col, round(avg(value), 6) AS value FROM rp, (VALUES (2), (4)) AS l(k) GROUP BY ALL")
def overviews(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(pyramid.overviews(part_grid(spark, sf), (2, 4)), 6, "value")


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY b, t) AS pyramid_id FROM (SELECT p_partkey, dense_rank() OVER (ORDER BY translate(p_brand, '_', '%'), p_brand) AS b, dense_rank() OVER (ORDER BY translate(p_type, '_', '%'), p_type) AS t FROM part)")
def composite_ids(spark: SparkSession, sf: str) -> DataFrame:
    return pyramid.composite_ids(_t(spark, sf, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"]).select("p_partkey", F.col("pyramid_id").cast("long").alias("pyramid_id"))


@query("SELECT \"row\" + 50 AS \"row\", col + 170 AS col, CASE WHEN size = 5 THEN 55.0::DOUBLE WHEN size BETWEEN 3 AND 60 THEN CAST(size AS DOUBLE) END AS value FROM (SELECT p_partkey % 40 AS \"row\", p_partkey // 40 % 50 AS col, min(p_size) AS size FROM part GROUP BY 1, 2)")
def to_standard_frame(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    cells = _t(spark, sf, "part").groupBy((k % 40).alias("row"), (F.floor(k / 40) % 50).cast("long").alias("col")).agg(F.min("p_size").cast("double").alias("value"))
    out, _ = pyramid.to_standard(spark, cells, grid.Frame(-10, 40, 1, 1, 40, 50), {5: 55.0}, 3, 60)
    return out.select("row", "col", "value")


@query("SELECT n_regionkey, count(*) AS n, min(n_nationkey) AS minx, max(n_nationkey) AS maxx, min(length(n_name)) AS miny, max(length(n_name)) AS maxy FROM nation GROUP BY n_regionkey".replace("min(length(n_name))", "CAST(min(length(n_name)) AS INTEGER)").replace("max(length(n_name))", "CAST(max(length(n_name)) AS INTEGER)"))
def dissolve_boxes(spark: SparkSession, sf: str) -> DataFrame:
    n = _t(spark, sf, "nation")
    x, y = F.col("n_nationkey"), F.length("n_name")
    return pyramid.dissolve(n, "n_regionkey", {"minx": x, "maxx": x, "miny": y, "maxy": y})


@query("SELECT event_type AS zone, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE value > 90) GROUP BY 1")
def semi_join_clip(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    return e.join(e.filter("value > 90").select("user_id").distinct(), "user_id", "left_semi").groupBy(F.col("event_type").alias("zone")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_join_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "customer").select("c_custkey").join(_t(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("SELECT \"row\", col, round(100 * value / sum(value) OVER (PARTITION BY \"row\"), 6) AS share FROM rp")
def row_shares(spark: SparkSession, sf: str) -> DataFrame:
    p = part_grid(spark, sf)
    weights = p.groupBy("row").agg(F.sum("value").alias("w"))
    return p.join(weights, "row").select("row", "col", F.round(100 * F.col("value") / F.col("w"), 6).alias("share"))


@query("SELECT block * 1024 AS first_row, count(*) AS n FROM (SELECT DISTINCT \"row\" // 1024 AS block FROM rp) GROUP BY 1".replace("count(*) AS n", "CAST(1 AS BIGINT) AS n"))
def npy_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return src.write_npy(part_grid(spark, sf), 50).groupBy("first_row").agg(F.count("content").alias("n"))


@query("SELECT page_id, regexp_replace(url, '\\.[^./]*$', '') || '.html' AS other, regexp_matches(url, '[/\\\\]|\\.[A-Za-z0-9]{1,8}$') AS is_path FROM pages")
def path_edits(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "pages").select("page_id", text.replace_ext(F.col("url"), ".html").alias("other"), text.looks_like_path(F.col("url")).alias("is_path"))


@query("SELECT n_nationkey, regexp_extract(n_name, 'N(.*?)_', 1) AS middle, n_name LIKE '%1%' OR n_name LIKE '%2%' AS hit FROM nation")
def strings_between(spark: SparkSession, sf: str) -> DataFrame:
    found = text.strings_between(F.col("n_name"), "N", "_")
    return _t(spark, sf, "nation").select("n_nationkey", F.coalesce(F.get(found, F.lit(0)), F.lit("")).alias("middle"), (F.col("n_name").contains("1") | F.col("n_name").contains("2")).alias("hit"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) ** 2 AS p_size_square, CAST(p_size AS DOUBLE) ** 3 AS p_size_cube, round(CASE WHEN p_size > 0 THEN log10(p_size) END, 9) AS p_size_log10 FROM part")
def variable_transforms(spark: SparkSession, sf: str) -> DataFrame:
    out = formula.transforms(_t(spark, sf, "part").select("p_partkey", "p_size"), "p_size", ("square", "cube", "log10"))
    return _rounded(out.drop("p_size"), 9, "p_size_log10")


@query("SELECT c_custkey, CAST(c_mktsegment = (SELECT min(c_mktsegment) FROM customer) AS INTEGER) AS first_segment FROM customer")
def dummy_variables(spark: SparkSession, sf: str) -> DataFrame:
    out, names = formula.dummies(_t(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment")
    return out.select("c_custkey", F.col(names[0]).alias("first_segment"))


@query("SELECT 6 AS n, 0 AS x".replace("SELECT 6 AS n, 0 AS x", "SELECT 'b' AS raster_id UNION ALL SELECT 'c'"))
def unaligned_rasters(spark: SparkSession, sf: str) -> DataFrame:
    table = metadata.rasters(spark, {"a": grid.Frame.world(3600), "b": grid.Frame(0, 10, 1, 1, 10, 10), "c": grid.Frame.world(900), "d": grid.Frame.world(3600)})
    return metadata.unaligned(table, "a")


@query("SELECT 'a' AS raster_id, 3600.0::DOUBLE AS arcseconds UNION ALL SELECT 'b', 300 UNION ALL SELECT 'c', NULL")
def raster_resolutions(spark: SparkSession, sf: str) -> DataFrame:
    table = metadata.rasters(spark, {"a": grid.Frame.world(3600), "b": grid.Frame(0, 10, 0.08333, 0.08333, 10, 10), "c": grid.Frame(0, 10, 0.6, 0.6, 10, 10)})
    return metadata.resolutions(table).withColumn("arcseconds", F.col("arcseconds").cast("double"))


@query("SELECT 5.0::DOUBLE AS minx, 0.0::DOUBLE AS miny, 10.0::DOUBLE AS maxx, 8.0::DOUBLE AS maxy")
def common_box(spark: SparkSession, sf: str) -> DataFrame:
    return metadata.common_box(metadata.rasters(spark, {"a": grid.Frame(0, 10, 1, 1, 10, 10), "b": grid.Frame(5, 8, 1, 1, 12, 20)}))


@query("SELECT r * 36 + c AS id, 'POLYGON((' || (c * 10 - 180) || ' ' || (r * 10 - 90) || ',' || (c * 10 - 180) || ' ' || (r * 10 - 80) || ',' || (c * 10 - 170) || ' ' || (r * 10 - 80) || ',' || (c * 10 - 170) || ' ' || (r * 10 - 90) || ',' || (c * 10 - 180) || ' ' || (r * 10 - 90) || '))' AS wkt FROM range(18) a(r), range(36) b(c)")
def graticule_polygons(spark: SparkSession, sf: str) -> DataFrame:
    return features.graticules(spark, 10)
