"""Column functions on numbers and flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The semi-axes of the WGS84 ellipsoid in metres.
WGS84_A, WGS84_B = 6378137.0, 6356752.3142


def round_to_base(x: Column, base: float) -> Column:
    """Nearest multiple; halves go to the even multiple."""
    return F.bround(x / base) * base


def round_up_to_base(x: Column, base: float) -> Column:
    return F.ceil(x / base) * base


def round_down_to_base(x: Column, base: float) -> Column:
    return F.floor(x / base) * base


def round_containing(x: Column, step: float, up: bool) -> Column:
    return (F.ceil(x / step) if up else F.floor(x / step)).cast("long") * step


def round_significant(x: Column, n: int) -> Column:
    """``n`` significant digits; 0 stays 0."""
    scale = F.pow(F.lit(10.0), F.lit(n - 1) - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.bround(x * scale) / scale)


def str_to_bool(s: Column) -> Column:
    return F.lower(F.trim(s)).isin("yes", "true", "t", "1", "y")


def is_nan(x: Column) -> Column:
    """NaN numbers, and the word in any case; NULL and other values are not."""
    return F.coalesce(F.lower(x.cast("string")) == "nan", F.lit(False))


def implied_type(s: Column) -> Column:
    """Struct of what a string stands for: bool, then a number with a point, then a whole number, else text."""
    low = s
    as_bool = F.when(low.isin("TRUE", "True", "true", "T", "t", "1"), True).when(low.isin("FALSE", "False", "false", "F", "f", "0"), False)
    as_float = F.when(F.contains(s, F.lit(".")), s.try_cast("double"))
    as_int = s.try_cast("long")
    kind = F.when(as_bool.isNotNull(), "bool").when(as_float.isNotNull(), "float").when(as_int.isNotNull(), "int").otherwise("str")
    return F.struct(kind.alias("kind"), as_bool.alias("b"), as_float.alias("f"), as_int.alias("i"), s.alias("s"))


def distance(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    return F.hypot(r1 - r2, c1 - c2)


def angle(r1: Column, c1: Column, r2: Column, c2: Column) -> Column:
    """Degrees from one cell to another; straight up and down are 90 and -90, no distance is -1."""
    dr, dc = (r2 - r1).cast("double"), (c2 - c1).cast("double")
    return F.when((dc == 0) & (dr == 0), F.lit(-1.0)).when(dc == 0, F.when(dr > 0, F.lit(90.0)).otherwise(F.lit(-90.0))).otherwise(F.degrees(F.atan2(dr, dc)))


def pixel_area(lat: Column, size: float) -> Column:
    """Square metres of a WGS84 cell of ``size`` degrees centred at ``lat``: the zone between two parallels, by the cell's share of the circle."""
    e = (1 - (WGS84_B / WGS84_A) ** 2) ** 0.5

    def zone(at: Column) -> Column:
        s = F.sin(F.radians(at))
        return F.pi() * F.lit(WGS84_B**2) * (F.log((1 + e * s) / (1 - e * s)) / (2 * e) + s / (1 - e * e * s * s))

    return (zone(lat + size / 2) - zone(lat - size / 2)) * (size / 360.0)
