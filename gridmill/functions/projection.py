"""Map projections as closed formulas over Columns: degrees to metres and back, on a sphere of the WGS84 major axis."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmill.functions.scalar import WGS84_A

Pair = tuple[Column, Column]


@dataclass(frozen=True)
class Projection:
    """``forward`` takes (lon, lat) in degrees to (x, y) in metres, ``inverse`` goes back."""

    name: str
    forward: Callable[[Column, Column], Pair]
    inverse: Callable[[Column, Column], Pair]


R = WGS84_A


def geographic() -> Projection:
    """Degrees as they are."""
    return Projection("geographic", lambda lon, lat: (lon, lat), lambda x, y: (x, y))


def plate_carree(true_lat: float = 0.0) -> Projection:
    k = math.cos(math.radians(true_lat))
    return Projection("plate_carree", lambda lon, lat: (F.radians(lon) * (R * k), F.radians(lat) * R), lambda x, y: (F.degrees(x / (R * k)), F.degrees(y / R)))


def sinusoidal(centre: float = 0.0) -> Projection:
    def inverse(x: Column, y: Column) -> Pair:
        return F.degrees(F.try_divide(x, F.cos(y / R) * R)) + centre, F.degrees(y / R)

    return Projection("sinusoidal", lambda lon, lat: (F.radians(lon - centre) * F.cos(F.radians(lat)) * R, F.radians(lat) * R), inverse)


def equal_area(true_lat: float = 0.0) -> Projection:
    """Cylindrical; with 30 degrees Behrmann's, with 45 Gall and Peters'."""
    k = math.cos(math.radians(true_lat))
    return Projection("equal_area", lambda lon, lat: (F.radians(lon) * (R * k), F.sin(F.radians(lat)) * (R / k)), lambda x, y: (F.degrees(x / (R * k)), F.degrees(F.asin(F.greatest(F.least(y * (k / R), F.lit(1.0)), F.lit(-1.0))))))


def web_mercator() -> Projection:
    half = math.pi / 4
    return Projection(
        "web_mercator",
        lambda lon, lat: (F.radians(lon) * R, F.log(F.tan(F.radians(lat) / 2 + half)) * R),
        lambda x, y: (F.degrees(x / R), F.degrees(F.atan(F.exp(y / R)) * 2 - math.pi / 2)),
    )


def between(source: Projection, target: Projection) -> Callable[[Column, Column], Pair]:
    """Coordinates of ``source`` as ones of ``target``."""
    return lambda x, y: target.forward(*source.inverse(x, y))
