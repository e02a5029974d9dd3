"""Near-duplicates by BagMinHash signatures, banding, and exact multiset overlap.

1. One pass over the texts makes, for each document, a 128-bit key of its bag of
   five-word shingles, band keys from ``BANDS`` x ``BAND_ROWS`` registers, and a
   sketch of one byte from each of ``REGISTERS`` registers.  Documents with equal
   bags are one node from here on, so exact copies cost nothing further.
2. Nodes that share a band key form a bucket.  Each is compared with its bucket's
   least node: links grow with the bucket, not with its square, and the least node's
   text is salted.
3. Nodes that are not yet connected but share a bucket are compared too, bucket by
   bucket: the sketches rule out most pairs, likelier ones come first, and pairs that
   links connect meanwhile are left out.  Large buckets are dealt out in pairs of
   chunks, so no task holds more than two chunks.
4. A link is a weighted Jaccard similarity of at least ``SIMILARITY``, computed
   from the two texts' bags.  Connected components of links are the classes.

A pair at the threshold itself is missed by banding with a chance of 7e-5, and by
the sketches' bound (``SKETCH_LEAST``) with one below 1e-3 if nothing else connects it.

Null and empty texts, and texts of white space, have no words: each such row is a
class of its own.  Texts of fewer than five words are compared as one shingle.
Repeated rows are in one class.  The class id is the least document id in it.
An empty table gives an empty one.  Shingles are compared by 52 bits of their hashes:
two different ones of two texts of n shingles count as shared with a chance below
n**2 / 2**52.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.llm import bagminhash
from gridmill.llm.shared import release, saved
from gridmill.llm.textbytes import bags, blocks, mix64, shingles, utf8_buffers
from gridmill.operators.components import stars
from gridmill.llm.workers import tidy

WIDTH = 5
SIMILARITY = 0.8
REGISTERS, BANDS, BAND_ROWS = 256, 24, 5
SKETCH_LEAST = 0.72
#: Pairs of one hub that are verified together.
SALTED_PAIRS = 500
#: Rows of a bucket that are compared with one another at a time.
CHUNK = 1200
_SIG_BYTES = BANDS * 8 + REGISTERS


def _signed(data: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(data).view(np.int64)


def _bag_keys(rows: np.ndarray, elements: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(high, low, size): a 128-bit key of each row's bag, and its number of shingles."""
    sums = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    if len(rows):
        first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        for out, salt in zip(sums, (0x2545F4914F6CDD1D, 0x9FB21C651E98DF25), strict=True):
            out[rows[first]] = np.add.reduceat(mix64(mix64(elements ^ np.uint64(salt)) + counts.astype(np.uint64)), first)
    return _signed(sums[0]), _signed(sums[1]), np.bincount(rows, weights=counts, minlength=n).astype(np.int64)


def _keyed(docs: DataFrame, id_col: str, text_col: str, signed: bool) -> DataFrame:
    """(doc_id, hi, lo, size, then sig or text, text_key) of every row that has a word; the same columns with nulls for others."""
    last = "sig" if signed else "text"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(1), 3 << 19, 2000):
                part = batch.slice(a, b - a)
                n = b - a
                rows, elements, counts = bags(*shingles(*utf8_buffers(part.column(1)), WIDTH))
                hi, lo, size = _bag_keys(rows, elements, counts, n)
                none = size == 0
                if signed:
                    times = bagminhash.signatures(rows, elements, counts, n, REGISTERS)
                    bands = bagminhash.band_keys(times[:, : BANDS * BAND_ROWS], BANDS, BAND_ROWS)
                    sketch = (mix64(np.ascontiguousarray(times).view(np.uint64)) >> np.uint64(56)).astype(np.uint8).reshape(n, REGISTERS)
                    raw = np.concatenate((bands.view(np.uint8).reshape(n, -1), sketch), axis=1)
                    column = pa.array([None if e else r.tobytes() for e, r in zip(none, raw, strict=True)], pa.binary())
                else:
                    column = part.column(1).cast(pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(hi, mask=none), pa.array(lo, mask=none), pa.array(size), column, part.column(2)], names=["doc_id", "hi", "lo", "size", last, "text_key"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))
    return narrow.mapInArrow(tidy(run), f"doc_id long, hi long, lo long, size long, {last} {'binary' if signed else 'string'}, text_key long")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """(x, y, ok) of node pairs, by the overlap of the bags of both texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(3), 1 << 20, 2000):
                part = batch.slice(a, b - a)
                left, right = (shingles(*utf8_buffers(part.column(k)), WIDTH) for k in (2, 3))
                shared, total = bagminhash.overlaps(*left, *right, b - a)
                ok = shared >= similarity * total - 1e-9
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ok)], names=["x", "y", "ok"])

    of = lambda name: texts.select(F.col("node").alias(name), F.col("text").alias(f"text_{name}"))
    # A hub's text is copied once for each SALTED_PAIRS of its pairs, so that no task gets all pairs of a large group.
    parts = F.ceil(F.count(F.lit(1)) / SALTED_PAIRS).cast("int").alias("parts")
    sizes = saved(pairs.groupBy("y").agg(parts))
    dealt = pairs.select("x", "y").join(sizes, "y").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("parts")).cast("int")).drop("parts")
    hubs = of("y").join(sizes, "y").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    both = dealt.join(of("x"), "x").join(hubs, ["y", "salt"]).select("x", "y", "text_x", "text_y")
    return both.mapInArrow(tidy(run), "x long, y long, ok boolean")


def _links_in_group(cols: dict[str, np.ndarray], texts: pa.Array, similarity: float) -> list[tuple[int, int]]:
    """Verified links (larger node, smaller node) that connect left with right rows of one bucket.

    The sketches rule out most pairs.  Each left row's likeliest partner is verified
    first; then, in order of likeness, all pairs that the links found so far do not
    connect - each only in the first bucket that its two rows share.
    """
    n = len(cols["node"])
    sig = np.frombuffer(b"".join(cols["sig"]), np.uint8).reshape(n, _SIG_BYTES)
    sketch, bands = sig[:, BANDS * 8 :], np.ascontiguousarray(sig[:, : BANDS * 8]).view(np.int64)
    node, size, band = cols["node"], cols["size"], int(cols["band"][0])
    label = np.unique(cols["comp"], return_inverse=True)[1]
    lefts, rights = np.flatnonzero(cols["left"]), np.flatnonzero(cols["right"])
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for a in range(0, len(lefts), 32):
        i = lefts[a : a + 32]
        alike = (sketch[i][:, None, :] == sketch[rights][None, :, :]).mean(axis=2, dtype=np.float32)
        small, large = np.minimum(size[i][:, None], size[rights]), np.maximum(size[i][:, None], size[rights])
        p, q = np.nonzero((alike >= SKETCH_LEAST) & (label[i][:, None] != label[rights]) & (small >= similarity * large))
        found.append((i[p], rights[q], alike[p, q]))
    u, v, alike = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
    if not len(u):
        return []
    row, element, count = bags(*shingles(*utf8_buffers(texts), WIDTH))
    starts = np.searchsorted(row, np.arange(n + 1))
    order = np.argsort(-alike, kind="stable")
    u, v = u[order], v[order]
    links: list[tuple[int, int]] = []

    def verify(x: np.ndarray, y: np.ndarray) -> None:
        shared, total = bagminhash.overlaps_of(starts, element, count, x, y)
        for k in np.flatnonzero(shared >= similarity * total - 1e-9):
            if label[x[k]] != label[y[k]]:
                links.append((int(max(node[x[k]], node[y[k]])), int(min(node[x[k]], node[y[k]]))))
                label[label == label[x[k]]] = label[y[k]]

    best = np.unique(u, return_index=True)[1]
    verify(u[best], v[best])
    rest = np.ones(len(u), bool)
    rest[best] = False
    if band:
        rest[rest] = ~(bands[u[rest], :band] == bands[v[rest], :band]).any(axis=1)
    u, v = u[rest], v[rest]
    while len(u):
        verify(u[:1000], v[:1000])
        u, v = u[1000:], v[1000:]
        apart = label[u] != label[v]
        u, v = u[apart], v[apart]
    return links


def _links(rows: DataFrame, keys: list[str], similarity: float) -> DataFrame:
    """(x, y) links of all groups of ``keys``; rows: keys, band, left, right, node, comp, size, sig, text."""
    names = ["band", "left", "right", "node", "comp", "size"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in _with_end(batches):
            table = rest if batch is None else pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
            if table is None or not table.num_rows:
                continue
            ids = [table[k].to_numpy() for k in keys]
            new = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in ids])) + 1
            cuts = [0, *new.tolist(), table.num_rows]
            if batch is not None:  # the last group may go on
                rest = table.slice(cuts[-2])
                cuts.pop()
            for a, b in zip(cuts, cuts[1:], strict=False):
                part = table.slice(a, b - a)
                cols = {k: part[k].to_numpy() for k in names} | {"sig": part["sig"].to_pylist()}
                if links := _links_in_group(cols, part["text"].combine_chunks(), similarity):
                    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["x", "y"])

    return rows.repartition(*keys).sortWithinPartitions(*keys).select(*keys, *names, "sig", "text").mapInArrow(tidy(run), "x long, y long")


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _labelled(members: DataFrame, links: DataFrame | None) -> DataFrame:
    """``members`` with the component of each node."""
    if links is None:
        return members.withColumn("comp", F.col("node"))
    root = links.select(F.col("x").alias("node"), F.col("y").alias("_root"))
    return members.join(root, "node", "left").withColumn("comp", F.coalesce("_root", "node")).drop("_root")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(doc_id, class_id, hi, lo, comp, text_key): one row for each row of ``docs``; hi and lo are the key of its bag, comp its class (null without words)."""
    rows = saved(_keyed(docs, id_col, text_col, signed=True))
    nodes = rows.filter(F.col("sig").isNotNull()).groupBy("hi", "lo").agg(F.min("doc_id").alias("first_id"), F.first("size").alias("size"), F.first("sig").alias("sig"))
    nodes = saved(nodes.withColumn("node", F.monotonically_increasing_id()))
    keyed = nodes.select("node", F.posexplode(_band_keys()).alias("band", "key"))
    buckets = saved(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("hub")).filter("n > 1"))
    members = saved(keyed.join(buckets, "key"))
    in_buckets = saved(members.select("node").distinct().join(nodes.drop("sig", "size"), "node"))
    text_rows = _keyed(docs, id_col, text_col, signed=False).filter(F.col("hi").isNotNull()).select("doc_id", "hi", "lo", "text")
    wanted = in_buckets.select("node", F.col("first_id").alias("_id"), F.col("hi").alias("_hi"), F.col("lo").alias("_lo"))
    texts = text_rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")))
    texts = saved(texts.groupBy("node").agg(F.first("text").alias("text")))

    release(docs.sparkSession)

    # Everyone against the bucket's least node.
    tested = saved(_verified(members.filter("node != hub").select(F.col("node").alias("x"), F.col("hub").alias("y")).distinct(), texts, similarity))
    found = stars(tested.filter("ok"))
    release(docs.sparkSession)

    # In buckets that the links leave in several parts: all rows outside the least node's part against all others.
    now = _labelled(members, found)
    mixed = saved(now.groupBy("key").agg(F.min(F.struct("node", "comp"))["comp"].alias("hub_comp"), F.min("comp").alias("low"), F.max("comp").alias("high")).filter("low != high"))
    rest = now.join(mixed.select("key", "hub_comp"), "key").withColumn("left", F.col("comp") != F.col("hub_comp"))
    chunks = F.ceil(F.col("n") / CHUNK).cast("int")
    rest = rest.withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int"))
    each = F.sequence(F.lit(0), chunks - 1)
    alone = rest.filter(chunks == 1).withColumn("other", F.lit(0)).withColumn("right", F.lit(True))
    # A pair of chunks of a large bucket is a group: left rows of the one, all rows of the other.
    as_left = rest.filter((chunks > 1) & F.col("left")).withColumn("other", F.explode(each)).withColumn("right", F.lit(False))
    as_right = rest.filter(chunks > 1).withColumn("other", F.col("chunk")).withColumn("chunk", F.explode(each)).withColumn("left", F.lit(False)).withColumn("right", F.lit(True))
    dealt = alone.unionByName(as_left).unionByName(as_right).join(nodes.select("node", "size", "sig").join(texts, "node"), "node")
    more = saved(_links(dealt, ["key", "chunk", "other"], similarity))
    release(docs.sparkSession)
    found = stars(found.unionByName(more))

    comp = _labelled(nodes.select("node", "hi", "lo", "first_id"), found)
    least = saved(comp.groupBy("comp").agg(F.min("first_id").alias("class_id")))
    release(docs.sparkSession)
    named = comp.join(least, "comp").select(F.col("hi").alias("_hi"), F.col("lo").alias("_lo"), F.col("class_id").alias("_class"), "comp")
    out = rows.select("doc_id", "hi", "lo", "text_key").join(named, (F.col("hi") == F.col("_hi")) & (F.col("lo") == F.col("_lo")), "left")
    return out.select("doc_id", F.coalesce("_class", "doc_id").alias("class_id"), "hi", "lo", "comp", "text_key")


def _band_keys() -> Column:
    """The band keys at the front of ``sig``, as numbers (any fixed reading of the bytes does)."""
    part = lambda k: F.xxhash64(F.substring(F.col("sig"), 8 * k + 1, 8), F.lit(k))
    return F.array(*[part(k) for k in range(BANDS)])


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class: the one with the least id; documents without words all stay.

    Ids and texts together name rows, so rows with one id, or with none, but unrelated texts stay too.
    """
    marked = classes(docs, id_col, text_col, similarity)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("least")
    chosen = saved(marked.filter(F.col("comp").isNotNull()).groupBy("comp").agg(least).select(F.col("least.doc_id").alias("doc_id"), F.col("least.text_key").alias("chosen_key")))
    has_word = F.coalesce(F.regexp_like(F.col(text_col), F.lit("[^\\x20\\x09-\\x0D]")), F.lit(False))
    # The row travels as one struct, so that no column of ``docs`` can clash with those made here.
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("text_key"), has_word.alias("has_word"))
    with_words = inner.filter("has_word").join(chosen, (F.col("text_key") == F.col("chosen_key")) & F.col("id").eqNullSafe(F.col("doc_id")), "left_semi").dropDuplicates(["id", "text_key"])
    kept = with_words.unionByName(inner.filter(~F.col("has_word")))
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
