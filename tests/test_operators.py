"""Operators that SQL cannot express, and edge cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.functions import text
from gridmill.operators import algebra, allocate, focal, frames, grid, ordered, pyramid, rank, reclass, regress, vector, zonal
from gridmill.plans import config, formula
from gridmill.plans.tasks import Project
from gridmill.sources import cells as src
from gridmill.sources import features, metadata, tables
from gridmill.streaming import windows


def test_grid_sources(spark, tmp_path):
    assert src.pattern(spark, 50, 50, "gradient").agg(F.sum("value")).first()[0] == 61250
    assert abs(src.known_sum(spark, 10, 10, 1000.0).agg(F.sum("value")).first()[0] - 1000) < 1e-9
    array = np.arange(24.0).reshape(2, 3, 4)
    np.save(tmp_path / "a.npy", array)
    got = src.read_npy(spark, str(tmp_path / "a.npy")).toPandas().sort_values(["band", "row", "col"])
    assert got["value"].tolist() == list(range(24))
    (tmp_path / "g.asc").write_text("ncols 2\nnrows 2\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9999\n1 2\n-9999 4\n")
    rows = {(r["row"], r["col"]): r["value"] for r in src.read_ascii_grid(spark, str(tmp_path / "g.asc")).collect()}
    assert rows == {(0, 0): 1.0, (0, 1): 2.0, (1, 0): None, (1, 1): 4.0}
    src.write_tiled(src.pattern(spark, 8, 8, "checkerboard"), str(tmp_path / "tiles"), 4)
    assert src.read_tiled(spark, str(tmp_path / "tiles")).count() == 64


def test_quad_order_is_a_permutation(spark):
    got = src.quad_order(src.blank(spark, 5, 7), 5, 7).toPandas()
    assert sorted(got["pos"]) == list(range(35))
    assert got[(got.row == 2) & (got.col == 0)]["pos"].item() == 2 * 3


@pytest.mark.parametrize("shape,tile,n", [((10, 10), 5, 4), ((12, 8), 4, 6), ((7, 5), 3, 6)])
def test_tiles(spark, shape, tile, n):
    assert zonal.tiles(src.blank(spark, *shape), tile).select("tile_row", "tile_col").distinct().count() == n


def test_nodata_modes(spark):
    df = spark.createDataFrame([(0, 0, 235.0), (0, 1, 241.0), (0, 2, None)], "row long, col long, value double")
    get = lambda **k: [r["value"] for r in reclass.reclassify(df, {235: 34}, **k).orderBy("col").collect()]
    assert get() == [34.0, 241.0, None]
    assert get(unlisted="zero") == [34.0, 0.0, None]
    assert get(unlisted="nodata") == [34.0, None, None]
    with pytest.raises(ValueError):
        reclass.reclassify(df, {235: 34}, unlisted="raise")


def test_division_and_empty(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "row long, col long, value double")
    b = spark.createDataFrame([(0, 0, 0.0), (0, 1, 2.0)], "row long, col long, value double")
    assert [r["value"] for r in algebra.calc([a, b], algebra.divide).collect()] == [None, None]
    assert zonal.zonal_sums(zonal.with_zones(a.limit(0), b.withColumn("zone", F.lit(1)).drop("value"))).count() == 0
    assert rank.rank_cells(a.limit(0)).count() == 0


def test_rank_with_mask(spark):
    ranks = rank.rank_grid(src.pattern(spark, 6, 6, "random"), F.col("row").between(1, 2) & F.col("col").between(2, 4)).toPandas()
    assert (ranks["rank"] == -9999).sum() == 6
    assert sorted(ranks[ranks["rank"] > 0]["rank"]) == list(range(1, 31))


def test_allocation_invariants(spark):
    cells = spark.createDataFrame([(0, c, c % 3, t, float((c * 7 + t * 3) % 11)) for c in range(60) for t in range(3)], "zone long, cell long, class long, target long, score double")
    goals = spark.createDataFrame([(0, 0, 6), (0, 1, -9), (0, 2, 3)], "zone long, class long, net long")
    after = allocate.allocate_classes(cells, goals).groupBy("class").count().toPandas().set_index("class")["count"].to_dict()
    assert after == {0: 26, 1: 11, 2: 23}
    land = spark.createDataFrame([(0, c, 1.0, s, float(c), 10.0) for c in range(8) for s in (1, 2)], "zone long, cell long, land double, sector long, score double, output double")
    demand = spark.createDataFrame([(0, 1, 35.0), (0, 2, 500.0)], "zone long, sector long, amount double")
    used = allocate.allocate_sectors(land, demand).toPandas()
    assert used.groupby("cell")["share"].sum().max() <= 1 + 1e-9
    assert abs(used[used.sector == 1]["output"].sum() - 35) < 1e-9


def test_frames(spark):
    left = spark.createDataFrame([("california", 1), ("texas", 2)], "name string, a int")
    right = spark.createDataFrame([("californa", 10), ("nowhere", 20)], "name string, b int")
    got = {r["name"]: (r["a"], r["b"]) for r in frames.fuzzy_merge(left, right, "name").collect()}
    assert got == {"california": (1, 10), "texas": (2, None), "nowhere": (None, 20)}
    assert [r["match"] for r in frames.match_candidates(left, right, "name").collect()] == ["california"]
    assert frames.merge(left, left.withColumn("b", F.lit(1)), "name", drop_identical=True).columns == ["name", "a", "b"]
    assert frames.smart_cast(spark.createDataFrame([("1", "a", "1.5"), (None, "b", "2")], "x string, y string, z string")).dtypes == [("x", "bigint"), ("y", "string"), ("z", "double")]
    assert frames.move_column(left, "a", "name").columns == ["a", "name"]
    assert frames.reorder(right, ["b"]).columns == ["b", "name"]
    assert frames.infer_key(left, right) == "name"
    with pytest.raises(Exception, match="different values"):
        frames.group(spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), ["k"], preserve="all", conflict="raise").collect()
    nested = {"row_1": {"col_1": 1, "col_2": 2}, "row_2": {"col_1": 3, "col_2": 4}}
    back = {r["row_key"]: r["cells"] for r in tables.to_maps(tables.from_nested(spark, nested)).collect()}
    assert back == nested
    assert frames.same_multiset(left, left.orderBy("name")) and not frames.same_multiset(left, left.union(left))


def test_text(spark):
    assert text.parse_flex("{a: 1, b: [1, 2.5, x]}") == {"a": 1, "b": [1, 2.5, "x"]}
    assert text.parse_flex("None") is None and text.parse_flex("3") == 3 and text.parse_flex('{"k": [1]}') == {"k": [1]}
    assert text.split_outside_brackets("a,[b,c],{d:e,f}") == ["a", "[b,c]", "{d:e,f}"]
    one = spark.createDataFrame([("/data/x/run_20240102_030405.tif", "<^region^>_scenario", "lat lon")], "p string, t string, d string")
    row = one.select(text.timestamp_in(F.col("p")).alias("ts"), text.insert_before_ext(F.col("p"), "_v2").alias("ins"), text.attribute_kind(F.lit("x"), F.col("t")).alias("kind"), text.template_parts(F.col("t")).alias("parts"), text.cast_token(F.lit("float(2.5)")).alias("f"), text.dict_literal(F.lit("{k: 1, j: hello}")).alias("m")).first()
    assert str(row["ts"]) == "2024-01-02 03:04:05" and row["ins"].endswith("030405_v2.tif") and row["kind"] == "template"
    assert [tuple(p) for p in row["parts"]] == [("region", None), (None, "_scenario")] and row["f"] == 2.5 and row["m"] == {"k": "1", "j": "hello"}


def test_frame_arithmetic():
    world = grid.Frame.world(3600)
    assert world.window((-10, 20, 10, 40)) == (170, 50, 20, 20)
    assert world.window((-10.4, 20.2, 10.3, 40.1), "inclusive") == (169, 49, 22, 21)
    assert grid.snap((-10, 0.2, 5.5, 3), 1.0) == (-10, 0, 6, 3)
    assert grid.intersection([(0, 0, 5, 5), (2, 1, 9, 4)]) == (2, 1, 5, 4)
    with pytest.raises(ValueError):
        grid.intersection([(0, 0, 1, 1), (2, 2, 3, 3)])
    assert grid.resolution_of(0.0833333) == 300


def test_vectors(spark):
    shapes = spark.createDataFrame([(1, "POLYGON((0 0,0 10,10 10,10 0,0 0),(2 2,2 8,8 8,8 2,2 2))", 1.0)], "id long, wkt string, v double")
    assert vector.rasterize(shapes, grid.Frame(0, 10, 1, 1, 10, 10), "v", "id").count() == 100 - 36
    cells = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 1, 1), (3, 3, 1), (0, 3, 2)], "row long, col long, value long")
    assert sorted(r["n_cells"] for r in vector.region_boxes(cells).collect()) == [1, 1, 3]


def test_focal(spark):
    assert abs(sum(focal.gaussian(9, 2).values()) - 1) < 1e-12
    flat = src.blank(spark, 4, 4, 5.0)
    assert {r["slope"] for r in focal.terrain(flat).collect()} == {0.0}
    points = spark.createDataFrame([(0, 0, 1.0), (3, 3, 2.0)], "row long, col long, value double")
    got = {(r["row"], r["col"]): r["value"] for r in focal.interpolate_nearest(spark, points, 4, 4, 8).collect()}
    assert got[(0, 1)] == 1.0 and got[(3, 2)] == 2.0 and len(got) == 16


def test_regression(spark):
    df = spark.range(200).select((F.col("id") % 17).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), "id").withColumn("y", 2 * F.col("a") - 3 * F.col("b") + 1)
    coef = {r["term"]: r["coefficient"] for r in regress.least_squares(df, "y ~ a + b + intercept").collect()}
    assert abs(coef["a"] - 2) < 1e-9 and abs(coef["b"] + 3) < 1e-9 and abs(coef["intercept"] - 1) < 1e-8
    assert regress.predict(df, "y ~ a + b + intercept", coef).filter(F.abs(F.col("predicted") - F.col("y")) > 1e-6).count() == 0
    assert set(formula.parse("y ~ a*b + dummy(b)[1,2] + intercept").terms) == {"a_b", "b_1", "b_2"}
    weights, confusion = regress.logistic(df.withColumn("y", (F.col("a") > 8).cast("double")), "y ~ a + b + intercept", "id")
    assert weights["a"] > 0 and confusion.agg(F.sum("n")).first()[0] > 0
    chosen, _ = regress.lasso(df, "y ~ a + b + intercept", folds=2, strengths=(0.01,))
    assert chosen["a"] > 1.5


def test_tasks(spark, tmp_path):
    def build() -> Project:
        p = Project(spark, str(tmp_path / "out"))
        p.add_task(lambda q: q.spark.range(3).toDF("x"), "first", skip_existing=True)
        loop = p.add_iterator(lambda q: [{"k": 1}, {"k": 2}], "each")
        p.add_task(lambda q: q.results["first"].withColumn("k", F.lit(q.k)), "scaled", parent=loop)
        return p.execute()

    assert build().log == ["ran first", "ran each-0/scaled", "ran each-1/scaled"]
    again = build()
    assert again.log[0] == "skipped first" and again.results["each-1/scaled"].first()["k"] == 2


def test_stream(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").repartition(2).write.parquet(str(tmp_path / "in"))
    sums = windows.windowed_sums(windows.read_events(spark, str(tmp_path / "in")), "event_type", "value")
    windows.write(sums, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    batch = windows.windowed_sums(spark.read.parquet(str(tmp_path / "in")), "event_type", "value")
    assert 0 < spark.read.parquet(str(tmp_path / "out")).count() <= batch.count()


def test_features(spark, tmp_path):
    (tmp_path / "a.geojson").write_text('{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"id":7,"name":"x"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[0,4],[4,4],[4,0],[0,0]]]}}]}')
    got = features.read_geojson(spark, str(tmp_path / "a.geojson"), "id long, name string")
    assert got.first().asDict() == {"id": 7, "name": "x", "wkt": "POLYGON((0 0,0 4,4 4,4 0,0 0))"}
    line = features.to_geojson(got).first()["value"]
    assert json.loads(line)["geometry"]["coordinates"] == [[[0, 0], [0, 4], [4, 4], [4, 0], [0, 0]]]
    assert features.select_features(got, "id", [7]).count() == 1
    with pytest.raises(ValueError):
        features.select_features(got, "id", [8])
    assert features.layer_info(got).first()["maxx"] == 4


def test_config(spark):
    assert config.parse_value("x", "[a, int(2), float(3.5)]") == ["a", 2, 3.5]
    assert config.parse_value("x", "{k: int(1), j: hello}") == {"k": 1, "j": "hello"}
    assert config.parse_value("years", "2017 2020 2030") == [2017, 2020, 2030] and config.parse_value("key_base_year", "2017") == 2017
    assert config.parse_value("dimensions", "lat lon time") == ["lat", "lon", "time"] and config.parse_value("x", "nan") is None
    assert config.parse_value("x", "<^region^>_scenario") == "<^region^>_scenario"
    rows = spark.createDataFrame([("years", "2017 2020"), ("label", "base")], "key string, value string")
    assert config.parameters(rows, {"label": "other", "n": 1}) == {"label": "base", "n": 1, "years": [2017, 2020]}
    assert config.fill("<^a^>-<^b^>", {"a": 1}) == "1-<^b^>" and config.runs([1, {"a": 1}, {"b": 2}, 2, 3]) == [[1], {"a": 1, "b": 2}, [2, 3]]


def test_metadata(spark):
    table = metadata.rasters(spark, {"a": grid.Frame.world(3600), "b": grid.Frame.world(900)})
    assert metadata.frame_of(table, "b") == grid.Frame.world(900) and not metadata.agree(table, "xres") and metadata.agree(table, "crs", "dtype")
    assert metadata.common_box(table).first()["maxx"] == 180 and pyramid.is_standard(grid.Frame.world(300))
    assert pyramid.transform_box((0, 0, 2, 1), lambda x, y: (y, x)) == (0, 0, 1, 2) and pyramid.standard_box((-9.5, 0.2, 3, 4), 3600) == (-10, 0, 3, 4)


def test_tiff_forms():
    from gridmill.operators.grid import Frame
    from gridmill.sources import tiff

    rng = np.random.default_rng(1)
    for kind in ("uint8", "int16", "float32", "float64"):
        for shape in ((1, 5, 7), (3, 130, 20)):
            values = (rng.random(shape) * 100).astype(kind)
            for deflate in (True, False):
                back = tiff.decode(tiff.encode(tiff.Raster(values, Frame(-10, 40, 0.5, 0.25, *shape[1:]), -1.0), deflate, 16))
                assert (back.values == values).all() and back.values.dtype == kind and back.frame == Frame(-10, 40, 0.5, 0.25, *shape[1:]) and back.nodata == -1.0
    # A big-endian file of one strip, written out by hand: 2 x 2 unsigned shorts.
    import struct

    fields = [(256, 3, 1, 2), (257, 3, 1, 2), (258, 3, 1, 16), (273, 4, 1, 8), (277, 3, 1, 1), (278, 3, 1, 2), (279, 4, 1, 8)]
    ifd = struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHI", t, k, n) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, n, v in fields) + b"\0" * 4
    raster = tiff.decode(b"MM\0*" + struct.pack(">I", 16) + struct.pack(">4H", 1, 2, 3, 65535) + ifd)
    assert raster.values.tolist() == [[[1, 2], [3, 65535]]] and raster.frame is None and raster.nodata is None
    with pytest.raises(ValueError):
        tiff.decode(b"nothing of the kind")


def test_netcdf_records(spark):
    """A file with two record variables, an attribute and a fill value, written out by hand."""
    import struct

    from gridmill.sources import netcdf

    text = lambda s: struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    head = b"CDF\x01" + struct.pack(">I", 2) + struct.pack(">II", 10, 2) + text("time") + struct.pack(">I", 0) + text("x") + struct.pack(">I", 3) + struct.pack(">II", 0, 0)
    head += struct.pack(">II", 11, 2)
    fill = struct.pack(">II", 12, 1) + text("_FillValue") + struct.pack(">II", 4, 1) + struct.pack(">i", -9)
    a = text("a") + struct.pack(">III", 2, 0, 1) + fill + struct.pack(">II", 4, 12)
    b = text("b") + struct.pack(">II", 1, 0) + struct.pack(">II", 0, 0) + struct.pack(">II", 3, 4)
    start = len(head) + len(a) + len(b) + 8
    data = head + a + struct.pack(">I", start) + b + struct.pack(">I", start + 12)
    data += struct.pack(">3i", 1, -9, 3) + struct.pack(">hh", 7, 0) + struct.pack(">3i", 4, 5, 6) + struct.pack(">hh", 8, 0)
    found = netcdf.decode(data)
    assert found["a"][0] == ["time", "x"] and found["a"][1].tolist() == [[1, -9, 3], [4, 5, 6]] and found["b"][1].tolist() == [7, 8]
    files = spark.createDataFrame([("f", data)], "path string, content binary")
    rows = {tuple(r["at"]): r["value"] for r in netcdf.values(files, "a").collect()}
    assert rows[(0, 1)] is None and rows[(1, 2)] == 6 and len(rows) == 6
    assert {r["variable"]: list(r["shape"]) for r in netcdf.listing(files).collect()} == {"a": [2, 3], "b": [2]}


def test_outlines_have_holes(spark):
    from gridmill.operators import grid, vector

    ring = [(r, c, 1.0 if (r, c) != (1, 1) else 2.0) for r in range(3) for c in range(3)] + [(0, 4, 1.0), (1, 5, 1.0)]
    cells = spark.createDataFrame(ring, "row long, col long, value double")
    frame = grid.Frame(0, 3, 1, 1, 3, 6)
    shapes = vector.outlines(cells, frame)
    found = {r["wkt"]: r["n_cells"] for r in shapes.collect()}
    assert found["POLYGON((0.0 3.0,3.0 3.0,3.0 0.0,0.0 0.0,0.0 3.0),(1.0 2.0,1.0 1.0,2.0 1.0,2.0 2.0,1.0 2.0))"] == 8 and len(found) == 4
    back = {(r["row"], r["col"]): r["value"] for r in vector.covered(shapes, frame).collect()}
    assert back == {(r, c): v for r, c, v in ring}
    bent = spark.createDataFrame([("POLYGON((0 0,5 0.4,10 0,10 10,5 9.7,0 10,0 0))",)], "w string").select(vector.simplify(F.col("w"), 1.0).alias("w")).first()["w"]
    assert bent == "POLYGON((0.0 0.0,10.0 0.0,10.0 10.0,0.0 10.0,0.0 0.0))"


def test_rules_and_parameters_are_checked(spark):
    from gridmill.operators import reclass
    from gridmill.plans import config

    cells = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "row long, col long, value double")
    twice = spark.createDataFrame([(1.0, 5.0), (1.0, 5.0), (2.0, 6.0)], "src double, dst double")
    assert sorted(r["value"] for r in reclass.reclassify(cells, twice).collect()) == [5.0, 6.0]
    with pytest.raises(Exception, match="two targets"):
        reclass.reclassify(cells, twice.unionByName(spark.createDataFrame([(2.0, 7.0)], "src double, dst double"))).collect()
    with pytest.raises(ValueError):
        config.parameters(spark.range(config.MOST_ROWS + 1).selectExpr("cast(id as string) name", "'1' value"))


def test_tiles_agree_with_plain_sums(spark, monkeypatch):
    """Convolutions and aggregates over several tiles, with holes and missing cells."""
    from gridmill.operators import focal

    monkeypatch.setattr(focal, "TILE", 8)
    rng = np.random.default_rng(3)
    cells = {(r, c): (None if rng.random() < 0.2 else float(rng.integers(0, 50))) for r in range(21) for c in range(19) if rng.random() < 0.9}
    df = spark.createDataFrame([(r, c, v, "x") for (r, c), v in cells.items()], "row long, col long, value double, note string")
    kernel = {(r, c): float(1 + r * r + c) for r in range(-2, 3) for c in range(-3, 2)}
    near = lambda r, c: [(w, cells[r + a, c + b]) for (a, b), w in kernel.items() if cells.get((r + a, c + b)) is not None]
    got = {(x["row"], x["col"]): x["value"] for x in focal.convolve(df, kernel).collect()}
    assert got.keys() == cells.keys() and all(abs(got[k] - sum(w * v for w, v in near(*k))) < 1e-9 for k in cells)
    got = {(x["row"], x["col"]): x for x in focal.convolve(df, kernel, ignore_nodata=True, mask_nodata=True).collect()}
    total = sum(kernel.values())
    for k, v in cells.items():
        share = sum(w for w, _ in near(*k))
        assert got[k]["note"] == "x" and (got[k]["value"] is None if v is None or not share else abs(got[k]["value"] - sum(w * x for w, x in near(*k)) / share * total) < 1e-9)
    around = lambda r, c: [cells[r + a, c + b] for a in range(-2, 3) for b in range(-2, 3) if cells.get((r + a, c + b)) is not None]
    for how, plain in (("sum", sum), ("min", min), ("max", max), ("count", len), ("avg", lambda x: sum(x) / len(x))):
        got = {(x["row"], x["col"]): x["value"] for x in focal.focal(df.drop("note"), 2, how).collect()}
        assert all((got[k] is None) == (not around(*k)) and (got[k] is None or abs(got[k] - plain(around(*k))) < 1e-9) for k in cells)


def test_disjoint_sets_follow_one_greedy_walk(spark):
    boxes = [(i, i * 7 % 23, i * 5 % 19, 1 + i % 6, 1 + i % 4) for i in range(90)] + [(200, 500, 500, 1, 1)]
    rows = [(i, f"POLYGON(({x} {y}, {x + w} {y}, {x + w} {y + h}, {x} {y + h}, {x} {y}))") for i, x, y, w, h in boxes]
    touch = lambda p, q: p[1] < q[1] + q[3] and q[1] < p[1] + p[3] and p[2] < q[2] + q[4] and q[2] < p[2] + p[4]
    near = {p[0]: {q[0] for q in boxes if q[0] != p[0] and touch(p, q)} for p in boxes}
    want: dict[int, int] = {}
    for k in sorted(near, key=lambda k: (-len(near[k]), k)):
        taken = {want[o] for o in near[k] if o in want}
        want[k] = next(i for i in range(len(taken) + 1) if i not in taken)
    frame = spark.createDataFrame(rows, "id long, wkt string")
    got = {r["key"]: r["set"] for r in vector.disjoint_sets(frame, "id", 4.0).collect()}
    assert got == want and len(set(got.values())) > 3
    assert vector.disjoint_sets(frame.limit(0), "id", 4.0).count() == 0


def test_quantile_of_common_values(spark):
    values = [3.0] * 500 + [1.0, 2.0, None, 7.5, 9.0] + [4.0] * 40
    frame = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    there = sorted(v for v in values if v is not None)
    for q in (0.0, 0.001, 0.5, 0.93, 0.998, 1.0):
        assert abs(ordered.quantile(frame, "v", q).first()[0] - np.quantile(there, q)) < 1e-9
    assert ordered.quantile(frame.limit(0), "v", 0.5).first()[0] is None


def test_zone_cells_are_lists_of_tiles(spark):
    cells = spark.createDataFrame([(1 if c < 5 else None, r, c) for r in range(6) for c in range(7)], "zone int, row long, col long")
    got = zonal.zone_cells(cells, 4).collect()
    assert all(len(r["cells"]) <= 16 for r in got) and all(r["cells"] == sorted(r["cells"]) for r in got)
    assert sorted((p["row"], p["col"]) for r in got for p in r["cells"]) == [(r, c) for r in range(6) for c in range(5)]
