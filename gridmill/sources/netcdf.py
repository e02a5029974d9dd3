"""netCDF in its classic form (versions 1 and 2): arrays with named dimensions."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the format: type numbers, and the marks of the header's lists.
_TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8"}
_DIMENSIONS, _VARIABLES, _ATTRIBUTES = 10, 11, 12


class _Header:
    def __init__(self, data: bytes) -> None:
        if data[:3] != b"CDF" or data[3] not in (1, 2):
            raise ValueError("not a netCDF file of the classic kind")
        self.data, self.at, self.wide = data, 4, data[3] == 2
        self.records = self.number()
        self.dimensions = [(self.name(), self.number()) for _ in range(self.listed(_DIMENSIONS))]
        self.attributes = self.attribute_list()
        self.variables = {}
        for _ in range(self.listed(_VARIABLES)):
            name = self.name()
            dims = [self.number() for _ in range(self.number())]
            attributes, kind, size = self.attribute_list(), self.number(), self.number()
            begin = struct.unpack(">Q", self.take(8))[0] if self.wide else self.number()
            self.variables[name] = (dims, attributes, np.dtype(_TYPES[kind]), size, begin)

    def take(self, n: int) -> bytes:
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self) -> int:
        return struct.unpack(">I", self.take(4))[0]

    def name(self) -> str:
        n = self.number()
        return self.take(n + -n % 4)[:n].decode()

    def listed(self, mark: int) -> int:
        kind, n = self.number(), self.number()
        if kind not in (0, mark):
            raise ValueError("a broken netCDF header")
        return n

    def attribute_list(self) -> dict[str, object]:
        out: dict[str, object] = {}
        for _ in range(self.listed(_ATTRIBUTES)):
            name, kind, n = self.name(), np.dtype(_TYPES[self.number()]), self.number()
            size = n * kind.itemsize
            raw = self.take(size + -size % 4)[:size]
            out[name] = raw.decode("utf-8", "replace") if kind.kind == "S" else np.frombuffer(raw, kind).tolist()
        return out


def decode(data: bytes) -> dict[str, tuple[list[str], np.ndarray, dict[str, object]]]:
    """variable -> (names of its dimensions, values, attributes)."""
    h = _Header(data)
    out = {}
    varying = [v for v in h.variables.values() if v[0] and h.dimensions[v[0][0]][1] == 0]
    # Records of all varying variables follow one another; a lone one is not padded.
    if len(varying) == 1:
        dims, _, kind, _, _ = varying[0]
        step = int(np.prod([h.dimensions[d][1] for d in dims[1:]], dtype=np.int64)) * kind.itemsize
    else:
        step = sum(v[3] for v in varying)
    for name, (dims, attributes, kind, _, begin) in h.variables.items():
        shape = [h.dimensions[d][1] for d in dims]
        if shape and shape[0] == 0:
            n = int(np.prod(shape[1:], dtype=np.int64))
            rows = [np.frombuffer(data, kind, n, begin + step * r) for r in range(h.records)]
            values = np.concatenate(rows).reshape([h.records, *shape[1:]]) if rows else np.empty([0, *shape[1:]], kind)
        else:
            values = np.frombuffer(data, kind, int(np.prod(shape, dtype=np.int64)), begin).reshape(shape)
        out[name] = ([h.dimensions[d][0] for d in dims], values, attributes)
    return out


def encode(dimensions: Mapping[str, int], variables: Mapping[str, tuple[Sequence[str], np.ndarray]]) -> bytes:
    """A file of fixed-size variables of doubles."""
    text = lambda s: struct.pack(">I", len(s.encode())) + s.encode() + b"\0" * (-len(s.encode()) % 4)
    names = list(dimensions)
    head = b"CDF\x01" + struct.pack(">I", 0) + struct.pack(">II", _DIMENSIONS, len(names)) + b"".join(text(k) + struct.pack(">I", n) for k, n in dimensions.items()) + struct.pack(">II", 0, 0)
    head += struct.pack(">II", _VARIABLES, len(variables))
    entries = [text(k) + struct.pack(">I", len(d)) + b"".join(struct.pack(">I", names.index(x)) for x in d) + struct.pack(">IIII", 0, 0, 6, v.size * 8) for k, (d, v) in variables.items()]
    at = len(head) + sum(len(e) + 4 for e in entries)
    for e, (_, v) in zip(entries, variables.values(), strict=True):
        head += e + struct.pack(">I", at)
        at += v.size * 8
    return head + b"".join(np.ascontiguousarray(v, ">f8").tobytes() for _, v in variables.values())


def values(files: DataFrame, variable: str) -> DataFrame:
    """(path, dims, at, value) of a variable of rows (path, content): names of the dimensions, the place along each, and the value (fill values are NULL)."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                dims, found, attributes = decode(content)[variable]
                flat = found.ravel().astype("float64")
                for fill in (attributes.get("_FillValue"), attributes.get("missing_value")):
                    if fill:
                        flat[flat == fill[0]] = np.nan
                places = np.indices(found.shape).reshape(found.ndim, -1).T
                for a in range(0, len(flat), 50_000):
                    part = pd.Series(flat[a : a + 50_000], dtype="object")
                    part[part.isna()] = None
                    yield pd.DataFrame({"path": path, "dims": [dims] * len(part), "at": list(places[a : a + 50_000]), "value": part})

    return files.select("path", "content").mapInPandas(read, "path string, dims array<string>, at array<long>, value double")


def read_netcdf(spark: SparkSession, path: str, variable: str) -> DataFrame:
    return values(spark.read.format("binaryFile").load(path), variable)


def listing(files: DataFrame) -> DataFrame:
    """(path, variable, dims, shape, type) of all variables of rows (path, content)."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"], strict=True):
                found = decode(content)
                yield pd.DataFrame([(path, k, d, list(v.shape), v.dtype.newbyteorder("=").name) for k, (d, v, _) in found.items()], columns=["path", "variable", "dims", "shape", "type"])

    return files.select("path", "content").mapInPandas(read, "path string, variable string, dims array<string>, shape array<long>, type string")
