"""Interpolated modified Kneser-Ney models of character n-grams, kept and joined as shards.

A token is a Unicode character, whatever its script; before a text stand ORDER - 1
characters that no text has.  Counts are added up by n-gram, continuation counts,
discounts and back-off weights come from joins of counts with the sums of their
contexts, and the model is a table of (n-gram, discounted share, back-off weight).
Texts may be dealt into groups; ``count`` then also counts each n-gram without each
group, and one table has the models of all texts and of those without a group, so
that they are made by as many Spark stages as one model.

Documents are scored by shards (``shardjoin``): each block of texts asks for its
distinct n-grams of all orders, the shards join them with the model, and the
block puts the shares and weights that come back together to probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm import shardjoin
from gridmill.llm.shared import saved
from gridmill.llm.textbytes import mix64, utf8_buffers
from gridmill.llm.workers import tidy

ORDER = 4
#: The last code point, which is no character, stands before a text.
PAD = 0x10FFFF
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Blocks are this part of a unit: a character takes more room than its bytes.
PARTS = 2
#: Tables of this many cells number pairs directly, larger ones by sorting.
_CELLS = 1 << 24


@dataclass
class Grams:
    """The n-grams of a block: ``ids[k]`` is the number of the (k+1)-gram that ends at each place, ``where[k]`` a place of each number."""

    symbols: np.ndarray
    ids: list[np.ndarray]
    where: list[np.ndarray]
    starts: np.ndarray
    ends: np.ndarray

    @staticmethod
    def of(data: np.ndarray, offsets: np.ndarray) -> Grams:
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))[offsets]
        if before[-1] != len(points):  # bytes that are no UTF-8
            rows = [data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            points, before = np.frombuffer(b"".join(rows), np.uint32), np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows])))
        n, size = len(offsets) - 1, np.diff(before)
        starts = before[:-1] + (ORDER - 1) * np.arange(1, n + 1)
        symbols = np.full(len(points) + (ORDER - 1) * n, PAD, np.uint32)
        inner = np.ones(len(symbols), bool)
        for k in range(1, ORDER):
            inner[starts - k] = False
        symbols[inner] = points
        del inner, points
        ids, where = [], []
        for k in range(ORDER):
            if k:
                small = len(where[-1]) * len(where[0]) <= _CELLS
                codes = np.empty(len(symbols), np.int32 if small else np.int64)
                codes[:1] = ids[0][:1]
                np.multiply(ids[-1][:-1], len(where[0]), out=codes[1:], dtype=codes.dtype)
                codes[1:] += ids[0][1:]
            now, at = _numbered(codes if k else symbols)
            ids.append(now)
            where.append(at)
        return Grams(symbols, ids, where, starts, starts + size)

    def keys(self) -> tuple[np.ndarray, list[int]]:
        """Keys of the distinct n-grams, order by order, and where the orders end."""
        out = [self._keys(k) for k in range(ORDER)]
        return np.concatenate(out), np.cumsum([len(x) for x in out])[:-1].tolist()

    def _keys(self, k: int) -> np.ndarray:
        at = self.where[k]
        return gram_keys([self.symbols[np.maximum(at - j, 0)] for j in range(k, -1, -1)])


def _numbered(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a number for each code, a place of each number); numbers are dense and follow the codes' order."""
    if not len(codes):
        return np.empty(0, np.int32), np.empty(0, np.int64)
    cells = int(codes.max()) + 1
    if cells > _CELLS:
        _, where, number = np.unique(codes, return_index=True, return_inverse=True)
        return number.astype(np.int32), where
    place = np.full(cells, -1, np.int32)
    place[codes] = np.arange(len(codes), dtype=np.int32)
    used = np.flatnonzero(place >= 0)
    where = place[used].astype(np.int64)
    place[used] = np.arange(len(used), dtype=np.int32)
    return place[codes], where


def gram_keys(symbols: list[np.ndarray]) -> np.ndarray:
    """Keys of n-grams given by their characters, first to last."""
    key = np.full(len(symbols[0]), np.uint64(len(symbols)))
    for s in symbols:
        key = mix64(key * _STEP + s.astype(np.uint64) + np.uint64(1))
    return shardjoin.as_keys(key)


def count(docs: DataFrame, text_col: str = "text", group_col: str | None = None, groups: int = 0) -> DataFrame:
    """(gram, n) of the ORDER-grams of all texts, as strings; with groups 0 to ``groups`` - 1 also without_0, ..., the counts without the texts of each."""
    unit = shardjoin.UNIT // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in shardjoin.text_blocks(batches, unit):
            g = Grams.of(*utf8_buffers(table.column(1)))
            top = g.ids[-1]
            real = np.concatenate([top[a:b] for a, b in zip(g.starts, g.ends, strict=True)] or [top])
            n = np.bincount(real, minlength=len(g.where[-1]))
            at = g.where[-1][n > 0]
            n = n[n > 0]
            letters = np.stack([g.symbols[at - j] for j in range(ORDER - 1, -1, -1)], axis=1).astype("<u4").tobytes().decode("utf-32-le")
            group = shardjoin.group_of(table)
            for a in range(0, len(n), 50_000):
                names = [letters[ORDER * i : ORDER * (i + 1)] for i in range(a, min(len(n), a + 50_000))]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(n[a : a + 50_000]), pa.array([group] * len(names), pa.int32())], names=["gram", "n", "part"])

    narrow = docs.select(F.lit(0).alias("doc_id"), F.col(text_col).alias("text"), *shardjoin.grouped(group_col))
    others = [F.sum(F.when(F.col("part") != i, F.col("n")).otherwise(0)).alias(f"without_{i}") for i in range(groups)]
    return narrow.mapInArrow(tidy(run), "gram string, n long, part int").groupBy("gram").agg(F.sum("n").alias("n"), *others)


def _discounts(level: DataFrame, columns: list[str]) -> list[tuple[float, float, float]]:
    """The three discounts of Chen and Goodman from counts of counts, for each column; plain ones where too few n-grams tell."""
    row = level.agg(*[F.count_if(F.col(c) == k).alias(f"{c}_{k}") for c in columns for k in (1, 2, 3, 4)]).first()
    out = []
    for c in columns:
        n1, n2, n3, n4 = (row[f"{c}_{k}"] or 0 for k in (1, 2, 3, 4))
        if not (n1 and n2 and n3 and n4):
            out.append((0.5, 0.75, 0.9))
            continue
        y = n1 / (n1 + 2 * n2)
        raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
        out.append(tuple(min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3), strict=True)))
    return out


@dataclass
class Model:
    """``table`` has gram and, for each of ``names``, share_ and weight_: an n-gram's discounted share under its context, and its weight as a context (null: not seen); the rest is for no context, by name."""

    table: DataFrame
    names: list[str]
    weight: list[float]
    even: list[float]

    def of(self, *names: str) -> Model:
        """The models of these names only."""
        at = [self.names.index(n) for n in names]
        return Model(self.table, list(names), [self.weight[i] for i in at], [self.even[i] for i in at])

    @property
    def empty(self) -> list[bool]:
        """Whether each has seen no character."""
        return [e == 1.0 for e in self.even]


def model(counts: DataFrame) -> Model:
    """The models of (gram, n, ...), one for each column of counts.  Without counts every character has probability 1."""
    level = saved(counts)
    columns = [c for c in counts.columns if c != "gram"]
    parts: list[DataFrame] = []
    weight, even = [1.0] * len(columns), [1.0] * len(columns)
    none = F.lit(None).cast("double")
    for k in range(ORDER, 0, -1):
        cuts = dict(zip(columns, _discounts(level, columns), strict=True))
        discount = {c: F.when(F.col(c) == 1, d1).when(F.col(c) == 2, d2).otherwise(d3) for c, (d1, d2, d3) in cuts.items()}
        # Whole numbers are summed, so that the model does not depend on the order of rows.
        cut = {c: d1 * F.count_if(F.col(c) == 1) + d2 * F.count_if(F.col(c) == 2) + d3 * F.count_if(F.col(c) > 2) for c, (d1, d2, d3) in cuts.items()}
        shard = level.withColumn("context", F.substring("gram", 1, k - 1))
        sums = shard.groupBy("context").agg(*[x for c in columns for x in (F.sum(c).alias(f"total_{c}"), cut[c].alias(f"cut_{c}"))])
        share = shard.join(sums, "context").select("gram", *[x for c in columns for x in (F.when(F.col(c) > 0, (F.col(c) - discount[c]) / F.col(f"total_{c}")).alias(f"share_{c}"), none.alias(f"weight_{c}"))])
        parts.append(share)
        if k > 1:
            parts.append(sums.select(F.col("context").alias("gram"), *[x for c in columns for x in (none.alias(f"share_{c}"), F.when(F.col(f"total_{c}") > 0, F.col(f"cut_{c}") / F.col(f"total_{c}")).alias(f"weight_{c}"))]))
            level = saved(level.groupBy(F.substring("gram", 2, k - 1).alias("gram")).agg(*[F.count_if(F.col(c) > 0).alias(c) for c in columns]))
        elif row := sums.first():
            seen = level.agg(*[F.count_if(F.col(c) > 0).alias(c) for c in columns]).first()
            weight = [row[f"cut_{c}"] / row[f"total_{c}"] if seen[c] else 1.0 for c in columns]
            even = [1 / (1 + seen[c]) for c in columns]
    table = parts[0]
    for p in parts[1:]:
        table = table.unionByName(p)
    return Model(saved(table.groupBy("gram").agg(*[F.max(f"{x}_{c}").alias(f"{x}_{c}") for c in columns for x in ("share", "weight")])), columns, weight, even)


def _shards_of(model: Model, shards: int) -> DataFrame:
    """(shard, keys, share, weight): the models' rows as packed arrays, in the order of keys; shares and weights of one model after the other's."""
    many = len(model.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            size = np.fromiter(map(len, names), np.int64, len(names))
            keys = np.zeros(len(names), np.uint64)
            for k in np.unique(size):
                at = np.flatnonzero(size == k)
                points = np.frombuffer("".join(names[i] for i in at).encode("utf-32-le"), np.uint32).reshape(len(at), int(k))
                keys[at] = gram_keys(list(points.T))
            order = np.argsort(keys)
            keys = keys[order]
            values = [np.stack([batch.column(1 + at + i).to_numpy(zero_copy_only=False)[order].astype(np.float32) for i in range(many)]) for at in (0, many)]
            values = [np.where(np.isnan(v), np.float32(d), v) for v, d in zip(values, (0, 1), strict=True)]
            cuts = np.searchsorted(shardjoin.shard_of(keys, shards), np.arange(shards + 1))
            for s in range(shards):
                a, b = int(cuts[s]), int(cuts[s + 1])
                if a < b:
                    row = [pa.array([s], pa.int32()), *(pa.array([x], pa.binary()) for x in (shardjoin.packed_keys(keys[a:b]), *(v[:, a:b].tobytes() for v in values)))]
                    yield pa.RecordBatch.from_arrays(row, names=["shard", "keys", "share", "weight"])

    return model.table.select("gram", *[f"{x}_{c}" for x in ("share", "weight") for c in model.names]).mapInArrow(tidy(run), "shard int, keys binary, share binary, weight binary")


def _keys_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[int], Grams]:
    grams = Grams.of(data, offsets)
    return *grams.keys(), grams


def losses(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), group_col: str | None = None, ordered: bool = False) -> DataFrame:
    """(doc_id, *keep, n_tokens, loss): the summed negative log-likelihood in nats of each whole text under the first model, or the one whose place is the text's group.

    ``ordered``: ``docs`` come in one order whenever they are read.
    """
    docs = docs if ordered else shardjoin.stable(docs)
    shards = shardjoin.shard_number(docs, text_col)
    asked = shardjoin.ask(docs, _keys_of, shards, True, id_col, text_col, PARTS, group_col).select("shard", "block", "keys", *[F.lit(None).cast("binary").alias(c) for c in ("share", "weight")])
    known = _shards_of(model, shards).withColumn("block", F.lit(None).cast("binary"))
    dealt = asked.unionByName(known).repartition(shardjoin.partitions(shards), "shard").sortWithinPartitions("shard", "block")
    many, start = len(model.names), np.array([w * e for w, e in zip(model.weight, model.even, strict=True)])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in shardjoin.runs(batches, "shard"):
            mine = [r for r in rows if r["block"] is None]
            keys = np.concatenate([np.array([1 << 63], np.uint64), *(shardjoin.unpacked_keys(r["keys"]) for r in mine)])
            order = np.argsort(keys)
            keys = keys[order]
            values = [np.concatenate([np.full((many, 1), d, np.float32), *(np.frombuffer(r[c], np.float32).reshape(many, -1) for r in mine)], axis=1)[:, order] for c, d in (("share", 0), ("weight", 1))]
            seen = None
            for r in rows:
                if r["block"] is not None and r["block"] != seen:
                    seen = r["block"]
                    wanted = shardjoin.unpacked_keys(r["keys"])
                    at = np.searchsorted(keys, wanted)
                    hit = keys[at] == wanted
                    own = seen[0] if group_col else 0
                    found = [np.where(hit, v[own][at], np.float32(d)).view(np.uint32) for v, d in zip(values, (0, 1), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([r["shard"]], pa.int32()), *(pa.array([x], pa.binary()) for x in (seen, *map(shardjoin.narrowed, found)))], names=["shard", "block", "v0", "v1"])

    def finish(grams: Grams, ranks: list[np.ndarray], found: list[np.ndarray], group: int = 0) -> list[np.ndarray]:
        share, back = (x.astype(np.uint32).view(np.float32).astype(np.float64) for x in found)
        p = share[ranks[0]] + start[group]
        for k in range(1, ORDER):
            at = grams.where[k]
            p = share[ranks[k]] + back[ranks[k - 1]][grams.ids[k - 1][np.maximum(at - 1, 0)]] * p[grams.ids[k - 1][at]]
        sums = np.concatenate(([0.0], np.cumsum(-np.log(p)[grams.ids[-1]])))
        return [grams.ends - grams.starts, sums[grams.ends] - sums[grams.starts]]

    answers = dealt.mapInArrow(tidy(answer), "shard int, block binary, v0 binary, v1 binary")
    return shardjoin.meet(docs, answers, _keys_of, finish, [None, None], ["n_tokens", "loss"], shards, id_col, text_col, keep, PARTS, group_col)
