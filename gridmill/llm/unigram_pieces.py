"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The vocabulary (pieces, log scores, kinds) is read from a SentencePiece model
file.  A file of merges has ranks in place of log scores; there the piece of rank r
gets the probability that Zipf's law gives it, 1 / (r + ZIPF) over their sum (nothing
is trained).  User-defined pieces win over others, as in SentencePiece.  A text is marked (spaces become U+2581, one more is put in front), and cut
where no piece can reach across: before each run of markers, and around line ends
if no piece holds one.  The parts are few compared with the text, so each distinct
part of a batch is segmented once, all of them together: the trie is walked for
all parts in step, and the best score of each prefix is kept (Viterbi).  A
character that no piece covers is written as its bytes' pieces, or as the
unknown piece where the vocabulary lacks them.  Parts of more than ``LONG_PART`` bytes
are segmented one by one in time linear in their length.

Null text counts as empty and has no pieces.  Repeated rows get equal results, an empty
table gives an empty one, and clashing extra columns do not matter.  Decoding inverts encoding except
that U+2581 itself becomes a space, as the marker always does.  Rows are
independent; memory is bounded by one block of texts plus ``CACHE`` parts.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.piececache import PieceCache
from gridmill.llm.textbytes import blocks
from gridmill.llm.workers import tidy

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: A character without a piece scores this much below the lowest piece.
UNKNOWN_PENALTY = 10.0
#: Distinct parts remembered between batches; the memory is emptied when full.
CACHE = 800_000
BATCH_PARTS = 20_000
LONG_PART = 512
ZIPF = 100
_MERGES = 2  # fixed value: the trainer's model type of files of merges


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        else:
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def by_rank(scores: list[float], kinds: list[int]) -> list[float]:
    """Log-probabilities of pieces by their ranks: the higher the score, the lower the rank."""
    normal = [i for i, k in enumerate(kinds) if k == NORMAL]
    order = sorted(normal, key=lambda i: (-scores[i], i))
    total = sum(1 / (r + ZIPF) for r in range(len(order)))
    out = list(scores)
    for r, i in enumerate(order):
        out[i] = -math.log((r + ZIPF) * total)
    return out


@dataclass
class Vocabulary:
    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    prefix: bool = True  # a marker is put in front
    unknown: int = 0
    byte_ids: np.ndarray = field(default_factory=lambda: np.full(256, -1))

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, "rb") as f:
            return Vocabulary.parse(f.read())

    @staticmethod
    def parse(data: bytes) -> Vocabulary:
        pieces, scores, kinds, prefix, merges = [], [], [], True, False
        for number, value in _fields(data):
            if number == 1:
                entry = {1: b"", 2: struct.pack("<f", 0.0), 3: NORMAL} | dict(_fields(value))
                pieces.append(entry[1].decode())
                scores.append(struct.unpack("<f", entry[2])[0])
                kinds.append(entry[3])
            elif number == 2:
                merges = dict(_fields(value)).get(3) == _MERGES
            elif number == 3:
                prefix = bool(dict(_fields(value)).get(3, 1))
        if merges:
            scores = by_rank(scores, kinds)
        return Vocabulary.of(pieces, scores, kinds, prefix)

    @staticmethod
    def of(pieces: list[str], scores: list[float], kinds: list[int], prefix: bool = True) -> Vocabulary:
        out = Vocabulary(pieces, np.array(scores, np.float64), np.array(kinds, np.int64), prefix)
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == BYTE:
                out.byte_ids[int(p[3:5], 16)] = i
            elif k == UNKNOWN:
                out.unknown = i
        return out


@dataclass
class DoubleArray:
    """base[s] + byte is the next state if its check is s; ``value`` is the piece that ends in a state, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    longest: int

    @staticmethod
    def build(keys: list[tuple[bytes, int]]) -> DoubleArray:
        keys = sorted(keys)
        size = 1 << 12
        base, check, value, used = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32), np.zeros(size, bool)
        used[0] = True
        check[0] = 0
        free_from = 1
        todo = [(0, 0, len(keys), 0)]  # (state, first key, end, depth)
        while todo:
            state, a, b, depth = todo.pop()
            if a < b and len(keys[a][0]) == depth:
                value[state] = keys[a][1]
                a += 1
            if a == b:
                continue
            starts: list[tuple[int, int]] = []
            for k in range(a, b):
                c = keys[k][0][depth]
                if not starts or starts[-1][0] != c:
                    starts.append((c, k))
            labels = np.array([c for c, _ in starts])
            # The first place where all children fall on free cells; cells are tried in windows.
            window, at = free_from, 0
            while not at:
                while window + 4096 + 512 >= size:
                    grow = lambda x, v: np.concatenate((x, np.full(size, v, x.dtype)))
                    base, check, value, used = grow(base, 0), grow(check, -1), grow(value, -1), grow(used, False)
                    size *= 2
                places = np.flatnonzero(~used[window : window + 4096]) + window - int(labels[0])
                places = places[places >= 1]
                fits = places[~used[places[:, None] + labels].any(axis=1)] if len(labels) > 1 else places
                at = int(fits[0]) if len(fits) else 0
                window += 4096
            base[state] = at
            used[at + labels] = True
            check[at + labels] = state
            while used[free_from]:
                rest = np.flatnonzero(~used[free_from : free_from + 4096])
                free_from += int(rest[0]) if len(rest) else 4096
            ends = [k for _, k in starts[1:]] + [b]
            todo += [(at + c, k, e, depth + 1) for (c, k), e in zip(starts, ends, strict=True)]
        return DoubleArray(base, check, value, max((len(k) for k, _ in keys), default=0))


class Codec:
    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = v = vocabulary
        usable = [(p.encode(), i) for i, (p, k) in enumerate(zip(v.pieces, v.kinds, strict=True)) if k in (NORMAL, USER) and p]
        self.trie = DoubleArray.build(usable)
        top = float(v.scores[v.kinds == NORMAL].max(initial=-math.inf))
        self.scores = v.scores.copy()
        if math.isfinite(top):
            for i in np.flatnonzero(v.kinds == USER):
                self.scores[i] = len(v.pieces[i].encode()) * top - 0.1
        self.lowest = float(v.scores[v.kinds == NORMAL].min(initial=0.0)) - UNKNOWN_PENALTY
        names = [p for p, k in zip(v.pieces, v.kinds, strict=True) if k in (NORMAL, USER)]
        crossing = any(MARK in p.lstrip(MARK) for p in names)
        lines = "\n" if not any("\n" in p for p in names) else ""
        self.parts = re.compile(rf"(?s).+" if crossing else rf"{lines or '(?!)'}|{MARK}+[^{MARK}{lines}]*|[^{MARK}{lines}]+")
        self.fallback = bool((v.byte_ids >= 0).all())
        self.plain = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else p.replace(MARK, " ").encode() for p, k in zip(v.pieces, v.kinds, strict=True)]
        self.cache = PieceCache(self.segment, CACHE)

    def marked(self, text: str) -> str:
        return ((MARK if self.vocabulary.prefix else "") + text.replace(" ", MARK)) if text else ""

    def segment(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The best pieces of the parts, end to end, and how many each has; among equals the last piece is the longest."""
        raw = [p.encode("utf-8", "replace") for p in parts]
        order = np.array(sorted(range(len(raw)), key=lambda i: len(raw[i])), np.int64)
        found, sizes = [], np.zeros(len(raw), np.int64)
        a, most = 0, int(np.searchsorted([len(raw[i]) for i in order], LONG_PART, side="right"))
        while a < most:
            # Parts of like length share a table; a table has a bounded number of cells.
            least = len(raw[order[a]])
            b = a + 1
            while b < most and b - a < BATCH_PARTS and len(raw[order[b]]) <= least + 4 and (b - a) * len(raw[order[b]]) < 400_000:
                b += 1
            ids, sizes[order[a:b]] = self._viterbi([raw[i] for i in order[a:b]])
            found.append(ids)
            a = b
        for i in order[most:]:
            found.append(np.array(self._long(raw[i]), np.int32))
            sizes[i] = len(found[-1])
        if not found:
            return np.empty(0, np.int32), sizes
        # From the order of lengths back to the order of the parts.
        start = np.zeros(len(raw), np.int64)
        start[order] = np.cumsum(sizes[order]) - sizes[order]
        before = np.cumsum(sizes) - sizes
        return np.concatenate(found)[np.repeat(start - before, sizes) + np.arange(int(sizes.sum()))], sizes

    def _viterbi(self, raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        t = self.trie
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        n, width = len(raw), int(size.max())
        text = np.zeros((n, width + t.longest + 1), np.uint8)
        row = np.repeat(np.arange(n), size)
        text[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = np.frombuffer(b"".join(raw), np.uint8)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        came, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        for s in range(width):
            rows = np.flatnonzero((best[:, s] > -np.inf) & (size > s))
            if not len(rows):
                continue
            here = best[rows, s]
            lead = text[rows, s]
            char = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
            single = np.zeros(len(rows), bool)
            live, state = np.arange(len(rows)), np.zeros(len(rows), np.int64)
            for k in range(t.longest):
                at = t.base[state] + text[rows[live], s + k].astype(np.int64)
                good = (t.check[at] == state) & (t.base[state] > 0) & (s + k < size[rows[live]])
                live, state = live[good], at[good]
                if not len(live):
                    break
                ids = t.value[state]
                ends = ids >= 0
                single[live[ends & (char[live] == k + 1)]] = True
                r, score = rows[live[ends]], here[live[ends]] + self.scores[ids[ends]]
                better = score > best[r, s + k + 1]
                r = r[better]
                best[r, s + k + 1], came[r, s + k + 1], piece[r, s + k + 1] = score[better], s, ids[ends][better]
            bare = np.flatnonzero(~single)
            if len(bare):
                r, e = rows[bare], np.minimum(s + char[bare], size[rows[bare]])
                score = here[bare] + self.lowest
                better = score > best[r, e]
                r, e = r[better], e[better]
                best[r, e], came[r, e], piece[r, e] = score[better], s, -1
        # Back from the ends, all parts in step; pieces are written from the right.
        ids = np.full((n, width), -1, np.int32)
        at, left, unknown = size.copy(), np.full(n, width), np.zeros(n, bool)
        rows = np.flatnonzero(at)
        while len(rows):
            got = piece[rows, at[rows]]
            left[rows] -= 1
            ids[rows, left[rows]] = got
            unknown[rows] |= got < 0
            at[rows] = came[rows, at[rows]]
            rows = rows[at[rows] > 0]
        for i in np.flatnonzero(unknown).tolist():
            line = self._spelled(raw[i], came[i], piece[i])
            ids[i] = -1
            ids[i, width - len(line) :] = line
        return ids[ids >= 0], (ids >= 0).sum(axis=1)

    def _matches(self, data: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, piece) of the pieces that start in data[a:b], by start and length."""
        t = self.trie
        live, state = np.arange(a, b), np.zeros(b - a, np.int64)
        found = []
        for k in range(t.longest):
            inside = live + k < len(data)
            live, state = live[inside], state[inside]
            at = t.base[state] + data[live + k].astype(np.int64)
            at[at >= len(t.check)] = 0
            good = (t.check[at] == state) & (t.base[state] > 0)
            live, state = live[good], at[good]
            if not len(live):
                break
            ends = t.value[state] >= 0
            found.append((live[ends], np.full(int(ends.sum()), k + 1), t.value[state[ends]]))
        start, length, piece = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3
        order = np.lexsort((length, start))
        return start[order], length[order], piece[order]

    def _long(self, raw: bytes) -> list[int]:
        """One part's pieces, place by place."""
        data, n = np.frombuffer(raw, np.uint8), len(raw)
        best, came, piece = [-math.inf] * (n + 1), np.zeros(n + 1, np.int32), np.full(n + 1, -1, np.int32)
        best[0] = 0.0
        char = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4))).tolist()
        for a in range(0, n, 1 << 16):
            b = min(n, a + (1 << 16))
            start, length, ids = self._matches(data, a, b)
            cut = np.searchsorted(start, np.arange(a, b + 1)).tolist()
            lengths, numbers, scores = length.tolist(), ids.tolist(), self.scores[ids].tolist()
            for s in range(a, b):
                here = best[s]
                if here == -math.inf:
                    continue
                single = False
                for i in range(cut[s - a], cut[s - a + 1]):
                    e = s + lengths[i]
                    single |= lengths[i] == char[s]
                    if here + scores[i] > best[e]:
                        best[e] = here + scores[i]
                        came[e], piece[e] = s, numbers[i]
                if not single:
                    e = min(s + char[s], n)
                    if here + self.lowest > best[e]:
                        best[e] = here + self.lowest
                        came[e], piece[e] = s, -1
        return self._spelled(raw, came, piece)

    def _spelled(self, raw: bytes, came: np.ndarray, piece: np.ndarray) -> list[int]:
        """One part's pieces where some characters have none: their bytes' pieces, or the unknown piece."""
        out: list[int] = []
        end = len(raw)
        while end:
            start = int(came[end])
            if piece[end] >= 0:
                out.append(int(piece[end]))
            elif self.fallback:
                out += [int(self.vocabulary.byte_ids[b]) for b in reversed(raw[start:end])]
            else:
                out.append(self.vocabulary.unknown)
            end = start
        return out[::-1]

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets by text)."""
        find = self.parts.findall
        cut = [find(self.marked(t)) for t in texts]
        return self.cache.encode(cut)

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; bytes that are not UTF-8 become U+FFFD."""
        raw = b"".join(map(self.plain.__getitem__, ids))
        return (raw[1:] if self.vocabulary.prefix and raw[:1] == b" " else raw).decode("utf-8", "replace")





def encode(docs: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, n_pieces, n_byte_pieces, ids_crc32, round_trip): pieces of each whole text and whether decoding gives it back."""
    shared = docs.sparkSession.sparkContext.broadcast(Codec(vocabulary))
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_pieces", pa.int64()), ("n_byte_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        is_byte = codec.vocabulary.kinds == BYTE
        for batch in batches:
            for a, b in blocks(batch.column(1), 1 << 20):
                part = batch.slice(a, b - a)
                texts = [t or "" for t in part.column(1).to_pylist()]
                ids, offsets = codec.encode_batch(texts)
                bounds = list(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True))
                raw = ids.astype("<u4").tobytes()
                same = [codec.decode(ids[i:j].tolist()) == t for (i, j), t in zip(bounds, texts, strict=True)]
                bytes_before = np.concatenate(([0], np.cumsum(is_byte[ids])))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                        pa.array(np.diff(offsets)),
                        pa.array(bytes_before[offsets[1:]] - bytes_before[offsets[:-1]]),
                        pa.array([zlib.crc32(raw[4 * i : 4 * j]) for i, j in bounds], pa.int64()),
                        pa.array(same, pa.bool_()),
                    ],
                    schema=arrow,
                )

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(tidy(run), "doc_id long, ids array<int>, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean")


def decode(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text) from rows with doc_id and ids; null ids give null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Codec(vocabulary))
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else shared.value.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], schema=arrow)

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(tidy(run), "doc_id long, text string")
