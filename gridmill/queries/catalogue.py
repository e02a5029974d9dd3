"""Registered queries of the engine over the test tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import scalar
from gridmill.operators import algebra, allocate, rank, reclass, zonal
from gridmill.operators.ordered import quantile, running_sum
from gridmill.sources import cells as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = _CTES + sql
        return f

    return add


# Grids that the tables contain: dense keys counted row by row.
_CTES = """WITH ro AS (SELECT o_orderkey // 100 AS "row", o_orderkey % 100 AS col, o_totalprice AS value, o_orderstatus AS status, o_orderpriority AS priority FROM orders),
re AS (SELECT event_id // 100 AS "row", event_id % 100 AS col, value, event_type FROM events),
rp AS (SELECT p_partkey // 50 AS "row", p_partkey % 50 AS col, p_retailprice AS value, CAST(p_size AS BIGINT) AS size FROM part),
rb AS (SELECT vec_id AS "row", CAST(unnest(generate_series(0, len(embedding) - 1)) AS BIGINT) AS col, unnest(embedding) AS value, CAST(label AS BIGINT) AS zone FROM embeddings),
lz AS (SELECT CAST(s_nationkey AS BIGINT) AS zone, l_extendedprice AS value, l_quantity AS quantity, l_returnflag AS flag, l_linestatus AS status, l_discount AS discount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)
"""


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders_grid(spark: SparkSession, sf: str) -> DataFrame:
    return src.from_keys(_t(spark, sf, "orders"), "o_orderkey", 100, "o_totalprice", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


def events_grid(spark: SparkSession, sf: str) -> DataFrame:
    return src.from_keys(_t(spark, sf, "events"), "event_id", 100, "value", F.col("event_type"))


def part_grid(spark: SparkSession, sf: str) -> DataFrame:
    return src.from_keys(_t(spark, sf, "part"), "p_partkey", 50, "p_retailprice", F.col("p_size").cast("long").alias("size"))


def embedding_grid(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("row"), F.col("label").cast("long").alias("zone"), F.posexplode("embedding").alias("col", "value")).select("row", F.col("col").cast("long").alias("col"), F.col("value"), "zone")


def line_zones(spark: SparkSession, sf: str) -> DataFrame:
    lines, suppliers = _t(spark, sf, "lineitem"), _t(spark, sf, "supplier")
    joined = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey)
    return joined.select(F.col("s_nationkey").cast("long").alias("zone"), F.col("l_extendedprice").alias("value"), F.col("l_quantity").alias("quantity"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_discount").alias("discount"))


def _rounded(df: DataFrame, digits: int = 2, *names: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in names})


# --- zonal aggregation ---------------------------------------------------------------------------


@query("SELECT zone, round(sum(value), 2) AS sums, count(value) AS counts FROM lz GROUP BY zone")
def zonal_sums_counts(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(zonal.zonal_sums(line_zones(spark, sf)), 2, "sums")


@query("SELECT zone, round(sum(value), 4) AS sums FROM rb GROUP BY zone HAVING sum(value) > 0")
def zonal_sums_positive(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(zonal.zonal_sums(embedding_grid(spark, sf), counts=False, drop="nonpositive"), 4, "sums")


@query("SELECT zone, round(sum(value), 4) AS sums, count(value) AS counts FROM rb GROUP BY zone HAVING sum(value) <> 0 AND count(value) <> 0")
def zonal_sums_nonzero(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(zonal.zonal_sums(embedding_grid(spark, sf), drop="any_zero"), 4, "sums")


@query("SELECT zone, count(*) FILTER (flag = 'A') AS \"class_A\", count(*) FILTER (flag = 'N') AS \"class_N\", count(*) FILTER (flag = 'R') AS \"class_R\" FROM lz GROUP BY zone")
def zonal_enumeration(spark: SparkSession, sf: str) -> DataFrame:
    return zonal.zonal_classes(line_zones(spark, sf), ["A", "N", "R"], value="flag")


@query("SELECT zone, CAST(trunc(quantity) AS BIGINT) AS class, count(*) AS n FROM lz GROUP BY 1, 2")
def zonal_enumeration_long(spark: SparkSession, sf: str) -> DataFrame:
    return zonal.zonal_class_rows(line_zones(spark, sf), value="quantity")


@query("SELECT zone, coalesce(round(sum(quantity) FILTER (flag = 'A'), 2), 0) AS \"class_A\", coalesce(round(sum(quantity) FILTER (flag = 'R'), 2), 0) AS \"class_R\" FROM lz GROUP BY zone")
def zonal_enumeration_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(zonal.zonal_classes(line_zones(spark, sf), ["A", "R"], value="flag", weight="quantity"), 2, "class_A", "class_R")


@query("SELECT zone, round(sum(value), 2) AS price, round(sum(quantity), 2) AS quantity, round(sum(discount), 2) AS discount FROM lz GROUP BY zone")
def zonal_merge_multi(spark: SparkSession, sf: str) -> DataFrame:
    z = line_zones(spark, sf)
    merged = zonal.zonal_merge({"price": z.select("zone", "value"), "quantity": z.select("zone", F.col("quantity").alias("value")), "discount": z.select("zone", F.col("discount").alias("value"))})
    return _rounded(merged, 2, "price", "quantity", "discount")


@query("SELECT zone, round(min(value), 2) AS min, round(max(value), 2) AS max, round(avg(value), 2) AS mean, round(sum(value), 2) AS sums, count(value) AS counts, count(*) FILTER (value IS NULL) AS nodata_count FROM lz GROUP BY zone")
def zonal_flex_min_max_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(zonal.zonal_stats(line_zones(spark, sf)), 2, "min", "max", "mean", "sums")


@query("SELECT zone, round(greatest(0, sum(v) - 1000000), 2) AS total, count(v) AS n_pixels, min(v) AS pixel_min, max(v) AS pixel_max, round(greatest(0, sum(v) - 1000000) / count(v), 2) AS pixel_mean FROM (SELECT zone, CASE WHEN flag <> 'N' THEN value END AS v FROM lz) GROUP BY zone")
def zonal_threshold_totals(spark: SparkSession, sf: str) -> DataFrame:
    z = line_zones(spark, sf).withColumn("value", F.when(F.col("flag") != "N", F.col("value")))
    return _rounded(zonal.zonal_totals(z, 1_000_000), 2, "total", "pixel_mean")


@query("SELECT r_name, coalesce(round(sum(value), 2), 0) AS sums FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN lz ON zone = n_nationkey GROUP BY r_name")
def zonal_with_attributes(spark: SparkSession, sf: str) -> DataFrame:
    nation, region = _t(spark, sf, "nation"), _t(spark, sf, "region")
    named = zonal.attach(zonal.zonal_sums(line_zones(spark, sf)), nation.select(F.col("n_nationkey").cast("long").alias("zone"), "n_regionkey"))
    return named.join(region, F.col("n_regionkey") == F.col("r_regionkey"), "right").groupBy("r_name").agg(F.coalesce(F.round(F.sum("sums"), 2), F.lit(0.0)).alias("sums"))


@query("SELECT size AS zone, \"row\" // 16 AS tile_row, col // 16 AS tile_col, string_agg(\"row\" || ':' || col, ' ' ORDER BY \"row\", col) AS places FROM rp GROUP BY 1, 2, 3")
def zone_cell_lists(spark: SparkSession, sf: str) -> DataFrame:
    z = zonal.zone_cells(part_grid(spark, sf).select(F.col("size").alias("zone"), "row", "col"), 16)
    place = lambda c: F.concat(c["row"].cast("string"), F.lit(":"), c["col"].cast("string"))
    return z.select("zone", "tile_row", "tile_col", F.array_join(F.transform("cells", place), " ").alias("places"))


@query("SELECT flag AS class, count(*) FILTER (status = 'O') AS \"to_O\", count(*) FILTER (status = 'F') AS \"to_F\" FROM (SELECT l_returnflag AS flag, l_linestatus AS status FROM lineitem) WHERE flag IN ('O', 'F', 'A', 'N', 'R') AND status IN ('O', 'F', 'A', 'N', 'R') GROUP BY flag")
def change_matrix(spark: SparkSession, sf: str) -> DataFrame:
    lines = _t(spark, sf, "lineitem").select(F.col("l_returnflag").alias("before"), F.col("l_linestatus").alias("after"))
    return zonal.change_matrix(lines, ["O", "F", "A", "N", "R"]).select("class", "to_O", "to_F")


@query("SELECT size AS value, count(*) AS n FROM rp GROUP BY size")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return zonal.value_counts(part_grid(spark, sf).select(F.col("size").alias("value")))


@query("SELECT DISTINCT size AS value FROM rp WHERE size IS NOT NULL")
def distinct_values(spark: SparkSession, sf: str) -> DataFrame:
    return zonal.distinct_values(part_grid(spark, sf).select(F.col("size").alias("value")))


@query("SELECT CAST(least(floor((value - lo) * 10 / (hi - lo)), 9) AS BIGINT) AS bin, count(*) AS n FROM ro, (SELECT min(value) AS lo, max(value) AS hi FROM ro) GROUP BY 1")
def value_histogram_10(spark: SparkSession, sf: str) -> DataFrame:
    return zonal.histogram(orders_grid(spark, sf), 10)


@query("SELECT min(value) AS min, max(value) AS max, round(avg(value), 2) AS mean, round(stddev_pop(value), 2) AS std, round(sum(value), 2) AS sum, count(value) AS n_valid, count(*) FILTER (value <> 0) AS n_nonzero FROM ro")
def raster_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(zonal.raster_stats(orders_grid(spark, sf)), 2, "mean", "std", "sum")


@query("SELECT \"row\" // 10 AS \"row\", col // 10 AS col, count(*) FILTER (status = 'F') AS \"class_F\", count(*) FILTER (status = 'O') AS \"class_O\", count(*) FILTER (status = 'P') AS \"class_P\" FROM ro GROUP BY 1, 2")
def state_stack(spark: SparkSession, sf: str) -> DataFrame:
    return zonal.class_stack(orders_grid(spark, sf), 10, ["F", "O", "P"], "status")


@query("SELECT \"row\" // 10 AS \"row\", col // 10 AS col, round(sum(value), 2) AS value FROM ro GROUP BY 1, 2")
def upscale_sum(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(zonal.upscale(orders_grid(spark, sf), 10, "sum"), 2, "value")


@query("SELECT \"row\" // 10 AS \"row\", col // 10 AS col, round(avg(value), 4) AS value FROM ro GROUP BY 1, 2")
def upscale_mean(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(zonal.upscale(orders_grid(spark, sf), 10, "avg"), 4, "value")


@query("SELECT \"row\" // 7 AS \"row\", col // 7 AS col, round(sum(value), 2) AS value FROM rp, (SELECT (max(\"row\") + 1) // 7 * 7 AS nr FROM rp) WHERE \"row\" < nr AND col < 49 GROUP BY 1, 2")
def upscale_whole_blocks(spark: SparkSession, sf: str) -> DataFrame:
    g = part_grid(spark, sf)
    n_rows = src.info(g).first()["n_rows"]
    return _rounded(zonal.upscale(zonal.whole_blocks(g, 7, n_rows, 50), 7, "sum"), 2, "value")


@query("SELECT \"row\" * 2 + dr AS \"row\", col * 2 + dc AS col, value FROM rp, (VALUES (0), (1)) AS a(dr), (VALUES (0), (1)) AS b(dc)")
def downscale(spark: SparkSession, sf: str) -> DataFrame:
    return zonal.downscale(part_grid(spark, sf), 2)


@query("SELECT \"row\" // 8 AS \"row\", col // 8 AS col, count(CASE WHEN value > 1500 THEN 1 END) / 64.0::DOUBLE AS proportion FROM rp GROUP BY 1, 2")
def valid_proportion(spark: SparkSession, sf: str) -> DataFrame:
    return zonal.valid_proportion(part_grid(spark, sf).withColumn("value", F.when(F.col("value") > 1500, F.col("value"))), 8)


@query("SELECT \"row\" // 25 AS tile_row, col // 25 AS tile_col, round(sum(value), 2) AS sums, count(value) AS counts FROM ro GROUP BY 1, 2")
def tile_sum_conservation(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(zonal.tile_sums(orders_grid(spark, sf), 25), 2, "sums")


# --- map algebra ---------------------------------------------------------------------------------


def _binary(name: str, sql: str, op: Callable[[Column, Column], Column]) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return algebra.calc([part_grid(spark, sf), events_grid(spark, sf)], op).withColumn("value", F.round("value", 6))

    run.__name__ = name
    query(f'SELECT a."row", a.col, round({sql}, 6) AS value FROM rp a JOIN re b ON a."row" = b."row" AND a.col = b.col')(run)


_binary("map_add", "a.value + b.value", algebra.add)
_binary("map_subtract", "a.value - b.value", algebra.subtract)
_binary("map_multiply", "a.value * b.value", algebra.multiply)
_binary("map_divide", "a.value / nullif(b.value, 0)", algebra.divide)
_binary("map_proportion_change", "(a.value - b.value) / nullif(b.value, 0)", algebra.proportion_change)


@query('SELECT a."row", a.col, CAST(a.value > b.value AS INTEGER) AS value FROM rp a JOIN re b ON a."row" = b."row" AND a.col = b.col')
def map_greater_than(spark: SparkSession, sf: str) -> DataFrame:
    return algebra.calc([part_grid(spark, sf), events_grid(spark, sf)], algebra.greater_than)


@query("SELECT \"row\", col, CASE WHEN value < 1200 THEN 0 ELSE value END AS value FROM rp")
def map_where_below(spark: SparkSession, sf: str) -> DataFrame:
    return part_grid(spark, sf).select("row", "col", algebra.below_set_to(F.col("value"), 1200, 0.0).alias("value"))


@query("SELECT \"row\", col, CASE WHEN value >= 1000 AND value <= 1800 THEN value END AS value FROM rp")
def map_between(spark: SparkSession, sf: str) -> DataFrame:
    return part_grid(spark, sf).select("row", "col", algebra.between_or_nodata(F.col("value"), 1000, 1800).alias("value"))


@query('SELECT a."row", a.col, round((a.value + b.value) * a.value - 1, 4) AS value FROM rp a JOIN re b ON a."row" = b."row" AND a.col = b.col')
def map_grid_expression(spark: SparkSession, sf: str) -> DataFrame:
    a, b = algebra.Grid(part_grid(spark, sf)), algebra.Grid(events_grid(spark, sf))
    return ((a + b) * a - 1).cells.select("row", "col", F.round("value", 4).alias("value"))


@query('SELECT a."row", a.col, CASE WHEN b.value > 50 THEN a.value * b.value ELSE a.value END AS value FROM rp a JOIN re b ON a."row" = b."row" AND a.col = b.col')
def map_multiply_or_keep(spark: SparkSession, sf: str) -> DataFrame:
    high = events_grid(spark, sf).withColumn("value", F.when(F.col("value") > 50, F.col("value")))
    return algebra.calc([part_grid(spark, sf), high], algebra.multiply_or_keep)


@query("SELECT \"row\", col, CASE WHEN size % 2 = 0 THEN value END AS value FROM rp")
def map_masked(spark: SparkSession, sf: str) -> DataFrame:
    p = part_grid(spark, sf)
    return algebra.masked(p, p.withColumn("value", (F.col("size") % 2 == 0).cast("int")))


@query("SELECT count(*) FILTER (size > 25) AS valid, count(*) FILTER (size <= 25) AS nodata, count(*) FILTER (size > 25 AND value = 0) AS zero, count(*) FILTER (size > 25 AND value <> 0) AS nonzero FROM rp")
def masks(spark: SparkSession, sf: str) -> DataFrame:
    m = algebra.masks(part_grid(spark, sf).withColumn("value", F.when(F.col("size") > 25, F.col("value"))))
    return m.agg(*[F.sum(c).alias(c) for c in ("valid", "nodata", "zero", "nonzero")])


@query("SELECT \"row\", col, round((value - lo) / (hi - lo) * 100, 6) AS value FROM rp, (SELECT min(value) AS lo, max(value) AS hi FROM rp)")
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(algebra.normalized(part_grid(spark, sf), 0, 100).drop("size"), 6, "value")


@query("SELECT \"row\", col, round(ln(value - lo + 1) / ln(hi - lo + 1), 6) AS value FROM rp, (SELECT min(value) AS lo, max(value) AS hi FROM rp)")
def normalize_log(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(algebra.normalized(part_grid(spark, sf), log=True).drop("size"), 6, "value")


@query("SELECT p_partkey, CAST(round_even(p_size / 5, 0) * 5 AS BIGINT) AS nearest, CAST(ceil(p_size / 5) * 5 AS BIGINT) AS up, CAST(floor(p_size / 5) * 5 AS BIGINT) AS down, CASE WHEN p_size = 0 THEN 0 ELSE round_even(p_size * pow(10, 0 - floor(log10(abs(p_size)))), 0) / pow(10, 0 - floor(log10(abs(p_size)))) END AS one_digit FROM part")
def rounding_family(spark: SparkSession, sf: str) -> DataFrame:
    x = F.col("p_size").cast("double")
    return _t(spark, sf, "part").select("p_partkey", scalar.round_to_base(x, 5).cast("long").alias("nearest"), scalar.round_up_to_base(x, 5).cast("long").alias("up"), scalar.round_down_to_base(x, 5).cast("long").alias("down"), scalar.round_significant(x, 1).alias("one_digit"))


@query("SELECT \"row\", col, coalesce(n.v, value) AS value FROM rp LEFT JOIN (SELECT \"row\", col, max_by(v, pos) AS v FROM (SELECT event_id AS pos, event_id % 7 AS \"row\", event_id % 50 AS col, value AS v FROM events) GROUP BY 1, 2) n USING (\"row\", col)")
def apply_change_list(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    changes = e.select(F.col("event_id").alias("pos"), (F.col("event_id") % 7).alias("row"), (F.col("event_id") % 50).alias("col"), "value")
    return algebra.apply_changes(part_grid(spark, sf).drop("size"), changes)


@query("SELECT \"row\", col, round(value + 5 * coalesce(n, 0), 2) AS value FROM rp LEFT JOIN (SELECT event_id % 7 AS \"row\", event_id % 50 AS col, count(*) AS n FROM events GROUP BY 1, 2) USING (\"row\", col)")
def add_at_change_list(spark: SparkSession, sf: str) -> DataFrame:
    e = _t(spark, sf, "events")
    return _rounded(algebra.add_at(part_grid(spark, sf).drop("size"), e.select((F.col("event_id") % 7).alias("row"), (F.col("event_id") % 50).alias("col")), 5.0), 2, "value")


@query("SELECT \"row\", round(pi() * 6356752.3142 * 6356752.3142 * (z(lat + 0.5) - z(lat - 0.5)) / 360 / 10000, 3) AS hectares FROM (SELECT range AS \"row\", 90 - range - 0.5 AS lat FROM range(180))".replace("z(lat + 0.5)", "(ln((1 + e * sin(radians(lat + 0.5))) / (1 - e * sin(radians(lat + 0.5)))) / (2 * e) + sin(radians(lat + 0.5)) / (1 - e * e * sin(radians(lat + 0.5)) * sin(radians(lat + 0.5))))").replace("z(lat - 0.5)", "(ln((1 + e * sin(radians(lat - 0.5))) / (1 - e * sin(radians(lat - 0.5)))) / (2 * e) + sin(radians(lat - 0.5)) / (1 - e * e * sin(radians(lat - 0.5)) * sin(radians(lat - 0.5))))").replace("FROM range(180))", "FROM range(180)), (SELECT sqrt(1 - (6356752.3142 / 6378137.0) * (6356752.3142 / 6378137.0)) AS e)"))
def pixel_area_by_row(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.range(180).select(F.col("id").alias("row"))
    return rows.select("row", F.round(scalar.pixel_area(F.lit(90.0) - F.col("row") - 0.5, 1.0) / 10_000, 3).alias("hectares"))


@query("SELECT \"row\", col, round(CASE WHEN dc = 0 AND dr = 0 THEN -1 WHEN dc = 0 THEN CASE WHEN dr > 0 THEN 90 ELSE -90 END ELSE degrees(atan2(dr, dc)) END, 6) AS angle, round(sqrt(dr * dr + dc * dc), 6) AS distance FROM (SELECT \"row\", col, CAST(\"row\" - 5 AS DOUBLE) AS dr, CAST(col - 7 AS DOUBLE) AS dc FROM rp)")
def angle_and_distance(spark: SparkSession, sf: str) -> DataFrame:
    at = (F.lit(5), F.lit(7), F.col("row"), F.col("col"))
    return part_grid(spark, sf).select("row", "col", F.round(scalar.angle(*at), 6).alias("angle"), F.round(scalar.distance(*at), 6).alias("distance"))


# --- reclassification ----------------------------------------------------------------------------

_RULES = {1: 100, 2: 200, 3: 300, 10: 1000, 50: -1}
_CASE = "CASE size " + " ".join(f"WHEN {k} THEN {v}" for k, v in _RULES.items())


def _reclass(name: str, unlisted: str, rest: str) -> None:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = reclass.reclassify(part_grid(spark, sf).select("row", "col", F.col("size").alias("value")), _RULES, unlisted)
        return out.withColumn("value", F.col("value").cast("double"))

    run.__name__ = name
    query(f'SELECT "row", col, CAST({_CASE} ELSE {rest} END AS DOUBLE) AS value FROM rp')(run)


_reclass("reclass_keep", "keep", "size")
_reclass("reclass_zero", "zero", "0")
_reclass("reclass_nodata", "nodata", "NULL")


@query('SELECT "row", col, coalesce(dst, CAST(size AS DOUBLE)) AS value FROM rp LEFT JOIN (SELECT CAST(p_size AS DOUBLE) AS src, avg(floor(p_retailprice)) AS dst FROM part WHERE p_size < 20 GROUP BY 1) ON size = src')
def reclass_by_table(spark: SparkSession, sf: str) -> DataFrame:
    rules = _t(spark, sf, "part").filter("p_size < 20").groupBy(F.col("p_size").cast("double").alias("src")).agg(F.avg(F.floor("p_retailprice").cast("double")).alias("dst"))
    return reclass.reclassify(part_grid(spark, sf).select("row", "col", F.col("size").cast("double").alias("value")), rules)


@query("SELECT n_regionkey, min(n_nationkey) AS first_src, array_to_string(list_sort(list(DISTINCT n_nationkey)), ',') AS all_src FROM nation GROUP BY n_regionkey")
def correspondence(spark: SparkSession, sf: str) -> DataFrame:
    return reclass.correspondence(_t(spark, sf, "nation"), "n_nationkey", "n_regionkey").withColumn("all_src", F.array_join(F.col("all_src").cast("array<string>"), ","))


@query("SELECT c_custkey, coalesce(r_name, 'none') AS label FROM (SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey) JOIN nation USING (n_name) JOIN region ON n_regionkey = r_regionkey")
def relabel(spark: SparkSession, sf: str) -> DataFrame:
    nation, region, customer = _t(spark, sf, "nation"), _t(spark, sf, "region"), _t(spark, sf, "customer")
    names = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")
    labelled = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("label"))
    return reclass.relabel(labelled, names, "n_name", "label", "r_name")


# --- ranking and allocation ----------------------------------------------------------------------


@query("SELECT \"row\", col, value, row_number() OVER (ORDER BY value DESC, \"row\", col) AS rank FROM ro")
def rank_cells(spark: SparkSession, sf: str) -> DataFrame:
    return rank.rank_cells(orders_grid(spark, sf).select("row", "col", "value"))


@query("SELECT \"row\", col, coalesce(rank, -9999) AS rank FROM ro LEFT JOIN (SELECT \"row\", col, row_number() OVER (ORDER BY value DESC, \"row\", col) AS rank FROM ro WHERE NOT (\"row\" BETWEEN 1 AND 2 AND col BETWEEN 2 AND 40)) USING (\"row\", col)")
def rank_masked(spark: SparkSession, sf: str) -> DataFrame:
    return rank.rank_grid(orders_grid(spark, sf), F.col("row").between(1, 2) & F.col("col").between(2, 40)).select("row", "col", "rank")


@query("SELECT \"row\", col, row_number() OVER (ORDER BY value, \"row\", col) AS rank FROM ro WHERE value BETWEEN 50000 AND 200000")
def rank_ascending_clipped(spark: SparkSession, sf: str) -> DataFrame:
    return rank.rank_cells(orders_grid(spark, sf), False, 50_000, 200_000).select("row", "col", "rank")


@query("SELECT \"row\", col, CASE WHEN rank < cut THEN value ELSE 0 END AS value FROM (SELECT \"row\", col, value, row_number() OVER (ORDER BY value DESC, \"row\", col) AS rank FROM ro), (SELECT quantile_cont(rank, 0.05) AS cut FROM (SELECT row_number() OVER () AS rank FROM ro))")
def top_percentile_values(spark: SparkSession, sf: str) -> DataFrame:
    return rank.top_percentile(orders_grid(spark, sf).select("row", "col", "value"), 5)


@query("SELECT CAST(CASE WHEN rank < cut THEN 1 ELSE 0 END AS DOUBLE) AS value, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY value DESC, \"row\", col) AS rank FROM ro), (SELECT quantile_cont(rank, 0.1) AS cut FROM (SELECT row_number() OVER () AS rank FROM ro)) GROUP BY 1")
def top_percentile_set(spark: SparkSession, sf: str) -> DataFrame:
    return rank.top_percentile(orders_grid(spark, sf), 10, True).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT \"row\", col, CASE WHEN rank < cut THEN rank ELSE 0 END AS rank FROM (SELECT \"row\", col, row_number() OVER (ORDER BY value DESC, \"row\", col) AS rank FROM ro), (SELECT quantile_cont(rank, 0.05) AS cut FROM (SELECT row_number() OVER () AS rank FROM ro))")
def top_percentile_ranks(spark: SparkSession, sf: str) -> DataFrame:
    return rank.rank_of_top_percentile(rank.rank_cells(orders_grid(spark, sf)).select("row", "col", "rank"), 5)


@query("SELECT allocated, count(*) AS n FROM (SELECT CAST(sum(value) OVER (ORDER BY value DESC, \"row\", col) < 5000000 AS INTEGER) AS allocated FROM ro) GROUP BY allocated")
def allocate_greedy(spark: SparkSession, sf: str) -> DataFrame:
    return rank.allocate(orders_grid(spark, sf), 5_000_000).groupBy("allocated").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT \"row\", col, CASE WHEN run - gain < 300000 THEN share ELSE 0 END AS allocated FROM (SELECT \"row\", col, share, value * share AS gain, sum(value * share) OVER (ORDER BY size DESC, \"row\", col) AS run FROM (SELECT *, (size % 4) / 4.0::DOUBLE AS share FROM rp) WHERE share > 0)")
def allocate_eligible(spark: SparkSession, sf: str) -> DataFrame:
    p = part_grid(spark, sf).withColumn("share", (F.col("size") % 4) / F.lit(4.0))
    return rank.allocate_eligible(p, 300_000, "size").select("row", "col", "allocated")


@query("SELECT \"row\", col, round(sum(value) OVER (ORDER BY \"row\", col), 2) AS running FROM ro")
def running_total(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(running_sum(orders_grid(spark, sf), F.col("value"), F.asc("row"), F.asc("col")), 2, "running").select("row", "col", "running")


@query("SELECT quantile_cont(value, 0.975) AS high FROM ro")
def exact_quantile(spark: SparkSession, sf: str) -> DataFrame:
    return quantile(orders_grid(spark, sf), "value", 0.975, "high")


@query("SELECT (v + nx) / 2 AS unused FROM (SELECT v, lead(v) OVER (ORDER BY v) AS nx FROM (SELECT DISTINCT value AS v FROM rp)) WHERE nx IS NOT NULL ORDER BY nx - v DESC, v LIMIT 1")
def value_gap(spark: SparkSession, sf: str) -> DataFrame:
    return rank.unused_value(part_grid(spark, sf))


@query("SELECT p_partkey, dense_rank() OVER (ORDER BY translate(p_type, '_', '%'), p_type) AS id FROM part")
def pyramid_ids(spark: SparkSession, sf: str) -> DataFrame:
    return rank.dense_ids(_t(spark, sf, "part").select("p_partkey", "p_type"), "p_type").select("p_partkey", F.col("id").cast("long").alias("id"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 2")
def top_two_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return rank.top_by_group(_t(spark, sf, "events"), "user_id", 2, F.desc("value"), F.asc("event_id")).select("user_id", "event_id")


@query("SELECT \"row\", col, round(value - 20 * sqrt((\"row\" - 10) ** 2 + (col - 10) ** 2), 4) AS score FROM rp ORDER BY value - 20 * sqrt((\"row\" - 10) ** 2 + (col - 10) ** 2) DESC, \"row\", col LIMIT 1")
def best_cell(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(rank.best_cell(part_grid(spark, sf), 10, 10, 20.0), 4, "score")


@query()
def allocate_classes(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part").select((F.col("p_partkey") % 4).alias("zone"), F.col("p_partkey").alias("cell"), (F.col("p_size") % 3).cast("long").alias("class"), "p_retailprice")
    cells = p.withColumn("target", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("score", F.col("p_retailprice") * (F.col("target") + 1) % 97)
    goals = spark.createDataFrame([(z, c, n) for z in range(4) for c, n in ((0, 20), (1, -30), (2, 10))], "zone long, class long, net long")
    return allocate.allocate_classes(cells.drop("p_retailprice"), goals)


@query()
def allocate_sectors(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "part").select((F.col("p_partkey") % 4).alias("zone"), F.col("p_partkey").alias("cell"), (F.col("p_size") / 50).alias("land"), F.col("p_retailprice").alias("output"))
    cells = p.withColumn("sector", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long")))).withColumn("score", F.col("output") * (F.col("sector") + 1) % 97)
    demand = spark.createDataFrame([(z, s, 5000.0 * (s + 1)) for z in range(4) for s in range(3)], "zone long, sector long, amount double")
    return allocate.allocate_sectors(cells, demand)
