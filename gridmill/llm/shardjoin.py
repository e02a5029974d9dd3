"""Look-ups of the n-grams of texts in tables that are dealt into shards.

Texts are read in blocks of a bounded number of bytes.  A block asks once for
each distinct n-gram in it, by a key of 56 bits: its sorted keys are cut by shard
(a range of keys) and shuffled as packed arrays, and each shard answers with an
array in the same order.  The answers meet the block's text again, so every
occurrence is looked up where it stands.  What is shuffled are distinct n-grams
of blocks and compressed texts, not occurrences; a hot n-gram comes once a block
and a hot context has its n-grams in all shards.

A block is known by a hash of its texts.  Rows may have a group (a number under 256):
a block then holds rows of one group, and its name begins with it.  Both passes read the documents in one
order: files are scanned twice, and anything else is written to the shared
folder first (``stable``).  A block whose answers are incomplete raises an error.

Two of n n-grams share a key with a chance below n**2 / 2**57; their counts are then
added up.  Key 0 is asked for once a block and counts its occurrences of the first kind.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.llm.shared import saved
from gridmill.llm.textbytes import utf8_buffers
from gridmill.llm.workers import tidy

#: Bytes of text a block, and on average a shard.
UNIT = 8 << 20
KEY_BITS = 56
MOST_PARTITIONS = 20_000
ANSWER, TEXTS = 0, 1
#: The column of a row's group, where rows have one.
GROUP = "group"

#: From a block's bytes and offsets: keys, where their parts end, and what ``finish`` needs besides.
Keys = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, list[int], object]]


def stable(docs: DataFrame) -> DataFrame:
    """``docs`` itself if it is read straight from files, else written once, so that two readings give one order."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    plain = "Scan parquet" in plan and not any(x in plan for x in ("Exchange", "Join", "Sample", "Python", "Arrow", "Pandas", "Limit", "nondeterministic", "rand"))
    return docs if plain else saved(docs)


def shard_number(docs: DataFrame, text_col: str) -> int:
    """How many shards the n-grams of all texts are dealt into."""
    return 1 + (docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0) // UNIT


def partitions(shards: int) -> int:
    return min(MOST_PARTITIONS, shards)


def narrowed(values: np.ndarray, squeeze: bool = True) -> bytes:
    """Whole numbers that are not negative: how many, then the bytes of all by their place, as far as the largest needs them."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    raw = np.ascontiguousarray(values.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    head = len(values).to_bytes(7, "little") + bytes([width + 128 * squeeze])
    return head + (pa.compress(raw, "zstd", asbytes=True) if squeeze else raw)


def widened(data: bytes) -> np.ndarray:
    n, width = int.from_bytes(data[:7], "little"), data[7] % 128
    raw = pa.decompress(data[8:], n * width, "zstd", asbytes=True) if data[7] >= 128 and n else data[8:]
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width).reshape(width, n).T
    return out.view("<u8").ravel()


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences."""
    return narrowed(np.concatenate((keys[:1], np.diff(keys))), squeeze=False)


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(widened(data), dtype=np.uint64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key; it grows with the key."""
    return ((keys >> np.uint64(KEY_BITS - 32)) * np.uint64(shards)) >> np.uint64(32)


def as_keys(hashes: np.ndarray) -> np.ndarray:
    return np.maximum(hashes >> np.uint64(64 - KEY_BITS), np.uint64(1))


def _by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows, cut where the group changes."""
    for batch in batches:
        ends = [batch.num_rows]
        if GROUP in batch.schema.names:
            ends = [*(np.flatnonzero(np.diff(batch.column(GROUP).to_numpy(zero_copy_only=False))) + 1).tolist(), *ends]
        for a, b in zip([0, *ends], ends, strict=False):
            yield batch.slice(a, b - a)


def group_of(rows: pa.RecordBatch | pa.Table) -> int | None:
    return rows.column(GROUP)[0].as_py() if GROUP in rows.schema.names else None


def text_blocks(batches: Iterator[pa.RecordBatch], most_bytes: int) -> Iterator[pa.Table]:
    """Rows (doc_id, text) in tables of about ``most_bytes`` of text, or one row, and of one group."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in _by_group(batches):
        if held and batch.num_rows and group_of(batch) != group_of(held[0]):
            yield pa.Table.from_batches(held)
            held, size = [], 0
        _, offsets = utf8_buffers(batch.column(1))
        at = 0
        while at < batch.num_rows:
            end = max(at + (0 if held else 1), int(np.searchsorted(offsets, offsets[at] + most_bytes - size, side="right")) - 1)
            if end > at:
                held.append(batch.slice(at, end - at))
                size += int(offsets[end] - offsets[at])
            if end < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            at = end
    if held:
        yield pa.Table.from_batches(held)


def block_name(table: pa.Table) -> bytes:
    data, offsets = utf8_buffers(table.column(1))
    digest = hashlib.blake2b(np.diff(offsets).tobytes(), digest_size=16)
    digest.update(data)
    group = group_of(table)
    return (b"" if group is None else bytes([group])) + digest.digest()


def grouped(group_col: str | None) -> list[Column]:
    return [F.col(group_col).cast("int").alias(GROUP)] if group_col else []


def ask(docs: DataFrame, keys_of: Keys, shards: int, named: bool, id_col: str = "doc_id", text_col: str = "text", parts: int = 1, group_col: str | None = None) -> DataFrame:
    """(shard, block, keys, counts): the distinct keys of each block by shard and how often each occurs; block is null unless ``named``.  Blocks hold the ``parts``-th part of a unit."""
    unit = UNIT // parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches, unit):
            data, offsets = utf8_buffers(table.column(1))
            every, ends, _ = keys_of(data, offsets)
            name = block_name(table) if named else None
            keys, times = np.unique(every, return_counts=True)
            keys, times = np.concatenate((np.zeros(1, np.uint64), keys)), np.concatenate((np.array(ends[:1] or [len(every)]), times))
            del every, table
            cuts = np.searchsorted(shard_of(keys, shards), np.arange(shards + 1))
            for s in range(shards):
                a, b = int(cuts[s]), int(cuts[s + 1])
                if a < b:
                    row = [[s], [name], [packed_keys(keys[a:b])], [narrowed(times[a:b])]]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["shard", "block", "keys", "counts"])

    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *grouped(group_col))
    return narrow.mapInArrow(tidy(run), "shard int, block binary, keys binary, counts binary")


def runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[list[dict]]:
    """Rows that agree in ``column`` and follow one another."""
    held: list[dict] = []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {k: batch.column(k)[i].as_py() for k in batch.schema.names}
            if held and held[0][column] != row[column]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def meet(docs: DataFrame, answers: DataFrame, keys_of: Keys, finish: Callable[..., list[np.ndarray]], kinds: list[str], names: list[str],
         shards: int, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), parts: int = 1, group_col: str | None = None) -> DataFrame:
    """(*keep, doc_id, *names) of every row: ``finish`` gets what ``keys_of`` hands on, its parts as ranks of keys (key 0 is the first), the answers by rank, and with groups the block's.

    ``answers`` has (shard, block, values...): one array of ``kinds`` (numpy types, None for ``narrowed`` whole numbers) each, in the order of the block's keys.
    """
    # The text itself travels once, whether it is kept or not.
    rest = [k for k in keep if k != text_col]
    fields = ["doc_id", *rest, *([text_col] if text_col in keep else [])]
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.struct(F.col(id_col).alias("doc_id"), *[F.col(f"`{k}`") for k in rest]).alias("row"), *grouped(group_col))
    kept_types = [(f.name, f.dataType.simpleString()) for f in docs.schema["row"].dataType.fields] + [(text_col, "string")] * (text_col in keep)
    values, unit = [f"v{i}" for i in range(len(kinds))], UNIT // parts

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in text_blocks(batches, unit):
            name = block_name(table)
            sink = pa.BufferOutputStream()
            table = table.select(["doc_id", "text", "row"])
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            columns = [pa.array([TEXTS], pa.int32()), pa.array([0], pa.int32()), pa.array([name], pa.binary()), pa.array([sink.getvalue().to_pybytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.nulls(1, pa.binary()) for _ in values]], names=["kind", "shard", "block", "texts", *values])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "block"):
            # Blocks of the same texts ask, and are answered, more than once.
            given = {r["shard"]: r for r in rows if r["kind"] == ANSWER}
            read = lambda data, kind: widened(data) if kind is None else np.frombuffer(data, kind)
            found = [np.concatenate([read(given[s][v], k) for s in sorted(given)] or [np.empty(0, k or np.uint64)]) for v, k in zip(values, kinds, strict=True)]
            for r in rows:
                if r["kind"] != TEXTS:
                    continue
                table = pa.ipc.open_stream(r["texts"]).read_all()
                data, offsets = utf8_buffers(table.column(1))
                every, cuts, state = keys_of(data, offsets)
                order = np.argsort(every)
                every = every[order]
                new = np.concatenate(([True], every[1:] != every[:-1])) if len(every) else np.empty(0, bool)
                keys = every[new]
                del every
                rank = np.empty(len(order), np.int32)
                rank[order] = np.cumsum(new, dtype=np.int32)
                del order, new
                if len(keys) + 1 != len(found[0]):
                    raise RuntimeError("the documents were read in another order the second time: write them before scoring")
                del keys
                results = finish(state, np.split(rank, cuts), found, *([r["block"][0]] if group_col else []))
                del rank, state
                rows_of = table.column("row").combine_chunks()
                out = [rows_of.field(k) for k in range(1 + len(rest))] + [table.column("text").combine_chunks()] * (len(fields) - 1 - len(rest))
                for a in range(0, table.num_rows, 10_000):
                    yield pa.RecordBatch.from_arrays([*(c[a : a + 10_000] for c in out), *(pa.array(x[a : a + 10_000]) for x in results)], names=[*fields, *names])

    sent = docs.mapInArrow(tidy(send), "kind int, shard int, block binary, texts binary, " + ", ".join(f"{v} binary" for v in values))
    both = sent.unionByName(answers.select(F.lit(ANSWER).alias("kind"), "shard", "block", F.lit(None).cast("binary").alias("texts"), *values))
    dealt = both.repartition(partitions(shards), "block").sortWithinPartitions("block", "kind", "shard")
    types = ", ".join([f"`{k}` {t}" for k, t in kept_types] + [f"{n} {'long' if n.startswith('n_') else 'double'}" for n in names])
    return dealt.mapInArrow(tidy(score), types)
