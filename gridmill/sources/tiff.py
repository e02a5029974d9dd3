"""Baseline TIFF with georeferencing: strips or tiles, plain or deflated, whole numbers and floats.

A file is decoded in one task, strip by strip; a large grid is written as a file for
each block of rows.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.operators.grid import Frame

#: Fixed values of the format: field types with their sizes and struct codes, and the tags used here.
_TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES, FORMAT, PIXEL_SCALE, TIE_POINT, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
_PLAIN, _DEFLATE = (1,), (8, 32946)
_KINDS = {1: "u", 2: "i", 3: "f"}


@dataclass
class Raster:
    """``values`` is bands x rows x columns; ``frame`` is None without georeferencing."""

    values: np.ndarray
    frame: Frame | None
    nodata: float | None


def _tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(order + "H", data[2:4])[0] != 42:
        raise ValueError("not a TIFF of the baseline kind")
    at = struct.unpack(order + "I", data[4:8])[0]
    found: dict[int, tuple] = {}
    for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
        entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
        tag, kind, n = struct.unpack(order + "HHI", entry[:8])
        if kind not in _TYPES:
            continue
        size, code = _TYPES[kind]
        place = 0 if size * n <= 4 else struct.unpack(order + "I", entry[8:])[0]
        raw = entry[8 : 8 + size * n] if size * n <= 4 else data[place : place + size * n]
        found[tag] = (raw.split(b"\0")[0].decode("latin-1"),) if kind == 2 else struct.unpack(order + (code * n if len(code) > 1 else f"{n}{code}"), raw)
    return order, found


def decode(data: bytes) -> Raster:
    order, tags = _tags(data)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, height, samples = one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1)
    if one(COMPRESSION, 1) not in (*_PLAIN, *_DEFLATE) or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError("only plain and deflated TIFFs are read")
    kind = np.dtype(f"{order}{_KINDS[one(FORMAT, 1)]}{one(BITS, 8) // 8}")
    tiled = TILES in tags
    rows, cols = (one(TILE_HEIGHT, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(STRIP_ROWS, height), height), width)
    across, down = -(-width // cols), -(-height // rows)
    apart = one(PLANAR, 1) == 2
    depth = 1 if apart else samples
    out = np.zeros((samples, height, width), kind.newbyteorder("="))
    for i, (at, size) in enumerate(zip(tags[TILES if tiled else STRIPS], tags[TILE_BYTES if tiled else STRIP_BYTES], strict=True)):
        raw = data[at : at + size]
        raw = zlib.decompress(raw) if one(COMPRESSION, 1) in _DEFLATE else raw
        band, place = divmod(i, across * down)
        r, c = place // across * rows, place % across * cols
        part = np.frombuffer(raw, kind)
        part = part.reshape(len(part) // (cols * depth), cols, depth).astype(kind.newbyteorder("="))
        if one(PREDICTOR, 1) == 2:
            part = np.cumsum(part, axis=1, dtype=part.dtype)
        part = part[: height - r, : width - c]
        for k in range(depth):
            out[band if apart else k, r : r + part.shape[0], c : c + part.shape[1]] = part[:, :, k]
    frame = None
    if PIXEL_SCALE in tags and TIE_POINT in tags:
        (xres, yres), (i, j, _, x, y) = tags[PIXEL_SCALE][:2], tags[TIE_POINT][:5]
        frame = Frame(x - i * xres, y + j * yres, xres, yres, height, width)
    nodata = float(tags[NODATA][0]) if NODATA in tags and tags[NODATA][0].strip() else None
    return Raster(out, frame, nodata)


def encode(raster: Raster, deflate: bool = True, strip_rows: int = 64) -> bytes:
    """Little-endian, bands one after the other, in strips."""
    bands, height, width = raster.values.shape
    values = raster.values.astype(raster.values.dtype.newbyteorder("<"))
    strips = [values[b, r : r + strip_rows].tobytes() for b in range(bands) for r in range(0, height, strip_rows)]
    strips = [zlib.compress(s) for s in strips] if deflate else strips
    kind = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    offsets = [8 + sum(map(len, strips[:i])) for i in range(len(strips))]
    fields: list[tuple[int, int, tuple]] = [
        (WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (values.dtype.itemsize * 8,) * bands), (COMPRESSION, 3, (8 if deflate else 1,)), (262, 3, (1,)), (STRIPS, 4, tuple(offsets)),
        (SAMPLES, 3, (bands,)), (STRIP_ROWS, 4, (strip_rows,)), (STRIP_BYTES, 4, tuple(map(len, strips))), (PLANAR, 3, (2 if bands > 1 else 1,)), (FORMAT, 3, (kind,) * bands),
    ]
    if raster.frame:
        f = raster.frame
        fields += [(PIXEL_SCALE, 12, (f.xres, f.yres, 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, f.ulx, f.uly, 0.0))]
    if raster.nodata is not None:
        fields.append((NODATA, 2, (f"{raster.nodata!r}\0".encode(),)))
    start = 8 + sum(map(len, strips))
    start += start % 2
    more, extra_at = b"", start + 2 + 12 * len(fields) + 4
    entries = b""
    for tag, kind, content in sorted(fields):
        size, code = _TYPES[kind]
        raw = content[0] if kind == 2 else struct.pack(f"<{len(content)}{code}", *content)
        n = len(raw) // size
        if len(raw) > 4:
            entries += struct.pack("<HHII", tag, kind, n, extra_at + len(more))
            more += raw + b"\0" * (len(raw) % 2)
        else:
            entries += struct.pack("<HHI", tag, kind, n) + raw.ljust(4, b"\0")
    body = b"".join(strips)
    return b"II*\0" + struct.pack("<I", start) + body + b"\0" * (start - 8 - len(body)) + struct.pack("<H", len(fields)) + entries + b"\0" * 4 + more


def cells(files: DataFrame) -> DataFrame:
    """(path, band, row, col, value, ulx, uly, xres, yres) of rows (path, content); no-data values are NULL."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                raster = decode(content)
                where = raster.frame or Frame(0.0, 0.0, 1.0, 1.0, *raster.values.shape[1:])
                for band, values in enumerate(raster.values):
                    for a in range(0, len(values), 256):
                        part = values[a : a + 256].astype("float64")
                        if raster.nodata is not None:
                            part[part == raster.nodata] = np.nan
                        r, c = np.indices(part.shape)
                        flat = pd.Series(part.ravel(), dtype="object")
                        flat[np.isnan(part.ravel())] = None
                        yield pd.DataFrame({"path": path, "band": band, "row": r.ravel() + a, "col": c.ravel(), "value": flat, "ulx": where.ulx, "uly": where.uly, "xres": where.xres, "yres": where.yres})

    return files.select("path", "content").mapInPandas(read, "path string, band int, row long, col long, value double, ulx double, uly double, xres double, yres double")


def read_tiff(spark: SparkSession, path: str) -> DataFrame:
    return cells(spark.read.format("binaryFile").load(path))


def blocks(grid: DataFrame, frame: Frame, rows_per_block: int = 1024, nodata: float = -9999.0) -> DataFrame:
    """(first_row, content): a georeferenced file for each block of rows; write the rows with any binary sink."""

    def one(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        first = int(key[0]) * rows_per_block
        n = min(rows_per_block, frame.n_rows - first)
        values = np.full((1, n, frame.n_cols), nodata)
        valid = part[part["value"].notna()]
        values[0, valid["row"].to_numpy() - first, valid["col"].to_numpy()] = valid["value"].to_numpy()
        return pd.DataFrame({"first_row": [first], "content": [encode(Raster(values, frame.cropped(0, first, frame.n_cols, n), nodata))]})

    inside = grid.select("row", "col", F.col("value").cast("double").alias("value")).filter(F.col("row").between(0, frame.n_rows - 1) & F.col("col").between(0, frame.n_cols - 1))
    return inside.groupBy(F.floor(F.col("row") / rows_per_block).alias("block")).applyInPandas(one, "first_row long, content binary")
