"""Features with geometry (WKT polygons) against grids, and grids as features."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.checkpoints import saved
from gridmill.operators.components import stars
from gridmill.operators.grid import Frame


def rings(wkt: Column) -> Column:
    """All rings of a POLYGON or MULTIPOLYGON as arrays of structs (x, y)."""
    text = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), 1)
    point = lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y"))
    return F.transform(text, lambda r: F.transform(F.split(r, ","), point))


def bounds(wkt: Column) -> Column:
    points = F.flatten(rings(wkt))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def contains(polygon_rings: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings, so holes are outside."""
    def crossings(ring: Column) -> Column:
        edges = F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        cross = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
        return F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(cross(e), 1).otherwise(0))

    return F.aggregate(F.transform(polygon_rings, crossings), F.lit(0), lambda n, c: n + c) % 2 == 1


def rasterize(features: DataFrame, frame: Frame, value: str, order: str, wkt: str = "wkt", merge: str = "replace") -> DataFrame:
    """Cells whose centres lie in a feature: the value of the last feature in ``order``, or with ``add`` the sum.

    Each feature makes only the candidate cells of its own box, then tests their centres.
    """
    cells = covered(features, frame, wkt)
    out = F.max_by(value, order) if merge == "replace" else F.sum(value)
    return cells.groupBy("row", "col").agg(out.alias("value"))


def covered(features: DataFrame, frame: Frame, wkt: str = "wkt") -> DataFrame:
    """One row a feature and cell whose centre it holds; a feature's columns are kept."""
    shaped = features.withColumn("_rings", rings(F.col(wkt))).withColumn("_box", bounds(F.col(wkt)))
    first_col = F.greatest(F.ceil((F.col("_box.minx") - frame.ulx) / frame.xres - 0.5), F.lit(0))
    last_col = F.least(F.floor((F.col("_box.maxx") - frame.ulx) / frame.xres - 0.5), F.lit(frame.n_cols - 1))
    first_row = F.greatest(F.ceil((F.lit(frame.uly) - F.col("_box.maxy")) / frame.yres - 0.5), F.lit(0))
    last_row = F.least(F.floor((F.lit(frame.uly) - F.col("_box.miny")) / frame.yres - 0.5), F.lit(frame.n_rows - 1))
    span = lambda a, b: F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))
    cells = shaped.withColumn("row", F.explode(span(first_row, last_row))).withColumn("col", F.explode(span(first_col, last_col)))
    x, y = F.lit(frame.ulx) + (F.col("col") + 0.5) * frame.xres, F.lit(frame.uly) - (F.col("row") + 0.5) * frame.yres
    return cells.filter(contains(F.col("_rings"), x, y)).drop("_rings", "_box")


def touching_boxes(features: DataFrame, key: str, size: float, wkt: str = "wkt") -> DataFrame:
    """(a, b) pairs of features whose boxes overlap, by way of the buckets of ``size`` that they share."""
    boxed = features.select(F.col(key), bounds(F.col(wkt)).alias("box"))
    span = lambda low, high: F.sequence(F.floor(F.col(low) / size), F.floor(F.col(high) / size))
    dealt = boxed.withColumn("bx", F.explode(span("box.minx", "box.maxx"))).withColumn("by", F.explode(span("box.miny", "box.maxy")))
    a = dealt.select(F.col(key).alias("a"), F.col("box").alias("p"), "bx", "by")
    b = dealt.select(F.col(key).alias("b"), F.col("box").alias("q"), "bx", "by")
    hit = (F.col("p.minx") < F.col("q.maxx")) & (F.col("q.minx") < F.col("p.maxx")) & (F.col("p.miny") < F.col("q.maxy")) & (F.col("q.miny") < F.col("p.maxy"))
    return a.join(b, ["bx", "by"]).filter((F.col("a") < F.col("b")) & hit).select("a", "b").distinct()


def regions(cells: DataFrame) -> DataFrame:
    """Connected regions of equal values (four neighbours): each cell with the least cell number of its region.

    Labels spread along region edges and are then replaced by their labels' labels,
    so the number of rounds grows with the logarithm of a region's extent, not with the extent.
    """
    wide = 1 << 31
    named = saved(cells.filter("value is not null").select("row", "col", "value", (F.col("row") * wide + F.col("col")).alias("id")))
    right = named.select(F.col("row"), (F.col("col") + 1).alias("col"), "value", F.col("id").alias("other"))
    down = named.select((F.col("row") + 1).alias("row"), F.col("col"), "value", F.col("id").alias("other"))
    edges = saved(named.select("row", "col", "value", "id").join(right.union(down), ["row", "col", "value"]).select(F.col("id").alias("x"), F.col("other").alias("y")))
    roots = stars(edges)
    return named.join(roots.withColumnRenamed("x", "id"), "id", "left").select("row", "col", "value", F.coalesce("y", "id").alias("region"))


def region_boxes(cells: DataFrame) -> DataFrame:
    """One row a connected region: its value, size and extent in cells."""
    return regions(cells).groupBy("region", "value").agg(F.count(F.lit(1)).alias("n_cells"), F.min("row").alias("min_row"), F.min("col").alias("min_col"), F.max("row").alias("max_row"), F.max("col").alias("max_col"))


def outlines(cells: DataFrame, frame: Frame) -> DataFrame:
    """(region, value, n_cells, wkt): the connected regions as polygons, outer ring first, holes after it.

    Sides between two cells of a region cancel where the rows are; what is left, the region's border,
    is chained to rings in one task a region.
    """
    named = saved(regions(cells))
    r, c = F.col("row"), F.col("col")
    corner = lambda y, x: F.struct(y.alias("r"), x.alias("c"))
    # Clockwise around each cell.
    sides = [(corner(r, c), corner(r, c + 1)), (corner(r, c + 1), corner(r + 1, c + 1)), (corner(r + 1, c + 1), corner(r + 1, c)), (corner(r + 1, c), corner(r, c))]
    edges = named.select("region", "value", F.explode(F.array(*[F.struct(a.alias("a"), b.alias("b")) for a, b in sides])).alias("e"))
    border = edges.groupBy("region", "value", F.least("e.a", "e.b").alias("p"), F.greatest("e.a", "e.b").alias("q")).agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("e")).filter("n = 1")
    flat = border.select("region", "value", F.col("e.a.r").alias("ar"), F.col("e.a.c").alias("ac"), F.col("e.b.r").alias("br"), F.col("e.b.c").alias("bc"))

    def chain(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        onward: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for ar, ac, br, bc in part[["ar", "ac", "br", "bc"]].sort_values(["ar", "ac", "br", "bc"]).itertuples(index=False):
            onward.setdefault((ar, ac), []).append((br, bc))
        found: list[list[tuple[int, int]]] = []
        for start in sorted(onward):
            while onward[start]:
                ring, here, way = [start], onward[start].pop(0), None
                way = (here[0] - start[0], here[1] - start[1])
                while here != start or (onward[here] and len(ring) == 1):
                    ring.append(here)
                    # Where two borders touch, the sharpest turn to the right stays with this one's cell.
                    options = sorted(onward[here], key=lambda p, here=here, way=way: -((p[1] - here[1]) * -way[0] + (p[0] - here[0]) * way[1]))
                    onward[here].remove(options[0])
                    way = (options[0][0] - here[0], options[0][1] - here[1])
                    here = options[0]
                found.append(_corners([*ring, start]))
        area = lambda ring: sum(a[1] * b[0] - b[1] * a[0] for a, b in zip(ring, ring[1:], strict=False)) / 2
        found.sort(key=lambda ring: (area(ring) < 0, ring))
        text = ",".join("(" + ",".join(f"{float(frame.ulx + x * frame.xres)!r} {float(frame.uly - y * frame.yres)!r}" for y, x in ring) + ")" for ring in found)
        return pd.DataFrame({"region": [key[0]], "value": [float(key[1])], "wkt": [f"POLYGON({text})"]})

    shapes = flat.withColumn("value", F.col("value").cast("double")).groupBy("region", "value").applyInPandas(chain, "region long, value double, wkt string")
    sizes = named.groupBy("region").agg(F.count(F.lit(1)).alias("n_cells"))
    return shapes.join(sizes, "region").select("region", "value", "n_cells", "wkt")


def _corners(ring: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The closed ring without points on straight lines."""
    inner = ring[:-1]
    straight = lambda a, b, c: (b[0] - a[0]) * (c[1] - b[1]) == (b[1] - a[1]) * (c[0] - b[0])
    kept = [p for i, p in enumerate(inner) if not straight(inner[i - 1], p, inner[(i + 1) % len(inner)])]
    return [*kept, kept[0]]


def simplify(wkt: Column, tolerance: float) -> Column:
    """Polygons without the points that lie within ``tolerance`` of the lines between those kept (Douglas and Peucker)."""

    def thin(points: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(points), bool)
        far = int(np.hypot(*(points - points[0]).T).argmax())
        keep[[0, far, -1]] = True
        todo = [(0, far), (far, len(points) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            p, way = points[a + 1 : b], points[b] - points[a]
            size = float(np.hypot(*way))
            off = np.abs(way[0] * (p[:, 1] - points[a, 1]) - way[1] * (p[:, 0] - points[a, 0])) / size if size else np.hypot(*(p - points[a]).T)
            k = int(off.argmax())
            if off[k] > tolerance:
                keep[a + 1 + k] = True
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
        return points[keep]

    @F.pandas_udf("string")
    def thinned(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            if text is None:
                return None

            def ring(m: re.Match) -> str:
                points = np.array([[float(x) for x in p.split()[:2]] for p in m[1].split(",")])
                return "(" + ",".join(f"{x!r} {y!r}" for x, y in thin(points).tolist()) + ")"

            return re.sub(r"\(([^()]+)\)", ring, text)

        return texts.map(one, na_action="ignore")

    return thinned(wkt)


def disjoint_sets(features: DataFrame, key: str, size: float, wkt: str = "wkt") -> DataFrame:
    """(key, set): features in sets without overlapping boxes; greedy, those with the most neighbours (then the least key) first.

    In a round each feature whose neighbours before it all have a set gets the least set
    that none of them has, so the sets are those of one walk in that order, and no group
    of overlapping features has to fit into a task.
    """
    pairs = touching_boxes(features, key, size, wkt)
    near = saved(pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    degree = saved(near.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    ranked = near.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("n").alias("m")), "b")
    before = saved(ranked.filter((F.col("m") > F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("b") < F.col("a")))).select("a", "b"))
    done = saved(degree.join(before, "a", "left_anti").select("a", F.lit(0).alias("set")))
    total, have = degree.count(), done.count()
    while have < total:
        seen = before.join(done, "a", "left_anti").join(done.withColumnsRenamed({"a": "b", "set": "other"}), "b", "left")
        taken = seen.groupBy("a").agg(F.bool_and(F.col("other").isNotNull()).alias("ready"), F.collect_set("other").alias("others")).filter("ready")
        least = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("others")), "others"))
        done = saved(done.union(taken.select("a", least.alias("set"))))
        have = done.count()
    keyed = features.select(F.col(key).alias("key"))
    return keyed.join(done.withColumnRenamed("a", "key"), "key", "left").select("key", F.coalesce("set", F.lit(0)).cast("long").alias("set"))


def read_points(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Point WKT to x and y, for ``mapInPandas``."""
    for f in frames:
        xy = f["wkt"].str.extract(r"\(\s*([-+.\deE]+)\s+([-+.\deE]+)\s*\)").astype(np.float64)
        yield f.assign(x=xy[0], y=xy[1])
