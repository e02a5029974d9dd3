"""Token ids of texts by way of their distinct parts.

Corpora repeat a small set of words.  Each distinct part is segmented once and its
ids are stored end to end; the ids of whole texts are then gathered with numpy.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np

from gridmill.llm.textbytes import differ


class PieceStore:
    """Ids of numbered parts, end to end, in arrays that grow by doubling."""

    def __init__(self) -> None:
        self.flat, self.ends, self.n = np.empty(1024, np.int32), np.zeros(1024, np.int64), 0

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Further parts: their ids end to end, and how many each has."""
        used = int(self.ends[self.n])
        while used + len(ids) > len(self.flat):
            self.flat = np.concatenate((self.flat, np.empty(len(self.flat), np.int32)))
        while self.n + len(sizes) + 1 > len(self.ends):
            self.ends = np.concatenate((self.ends, np.zeros(len(self.ends), np.int64)))
        self.flat[used : used + len(ids)] = ids
        self.ends[self.n + 1 : self.n + 1 + len(sizes)] = used + np.cumsum(sizes)
        self.n += len(sizes)

    def gather(self, parts: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets by text) of part numbers, ``per_text`` of which belong to each text."""
        start = self.ends[parts]
        size = self.ends[parts + 1] - start
        before = np.concatenate(([0], np.cumsum(size)))
        ids = self.flat[np.repeat(start - before[:-1], size) + np.arange(before[-1])]
        return ids, before[np.concatenate(([0], np.cumsum(per_text)))]


class PieceCache:
    """Parts as strings."""

    def __init__(self, segment: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int) -> None:
        """``segment`` gives the ids of parts end to end and how many each has; ``most`` parts are remembered before all are forgotten."""
        self.segment, self.most = segment, most
        self.known: dict[str, int] = {}
        self.store = PieceStore()

    def encode(self, cut: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts end to end, offsets by text) of texts cut into parts."""
        if len(self.known) > self.most:
            self.known, self.store = {}, PieceStore()
        known, parts = self.known, list(chain.from_iterable(cut))
        numbers = list(map(known.get, parts))
        if None in numbers:
            new = list(dict.fromkeys(p for p, k in zip(parts, numbers, strict=True) if k is None))
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.store.add(*self.segment(new))
            numbers = list(map(known.__getitem__, parts))
        return self.store.gather(np.array(numbers, np.int64), np.fromiter(map(len, cut), np.int64, len(cut)))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct values in order, a place of each, the number of each place's value); np.unique sorts stably, which takes longer."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    number = np.empty(len(values), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], order[new], number


class SlicedCache:
    """Parts as slices of bytes, all in arrays, so that only new parts become Python objects.

    Parts are found by their hashes and compared by their bytes: a part that hashes like
    another one is segmented each time, and hashes never decide.  When more than ``most``
    are remembered, those that were not met again since the last time are forgotten.
    """

    def __init__(self, segment: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int) -> None:
        self.segment, self.most = segment, most
        self.clear()

    def clear(self) -> None:
        self.hashes, self.numbers = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.raw, self.used = np.empty(1 << 16, np.uint8), 0
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)
        self.again = np.zeros(0, bool)
        self.store = PieceStore()

    def _forget(self) -> None:
        """Keep the parts met again, at most half of ``most``."""
        met = np.flatnonzero(self.again[self.numbers])[: self.most // 2]
        hashes, old = self.hashes[met], self.numbers[met]
        ids, ends = self.store.gather(old, np.ones(len(old), np.int64))
        starts, sizes, raw = self.starts[old], self.sizes[old], self.raw
        self.clear()
        self.hashes, self.numbers = hashes, np.arange(len(old))
        self.starts, self.sizes, self.again = np.cumsum(sizes) - sizes, sizes, np.zeros(len(old), bool)
        self.used = int(sizes.sum())
        kept = raw[np.repeat(starts - self.starts, sizes) + np.arange(self.used)]
        self.raw = np.concatenate((kept, np.empty(1 << 16, np.uint8)))
        self.store.add(ids, np.diff(ends))

    def _add(self, data: bytes, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Numbers of new parts."""
        parts = [data[a : a + n] for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
        first = self.store.n
        self.store.add(*self.segment(parts))
        joined = np.frombuffer(b"".join(parts), np.uint8)
        while self.used + len(joined) > len(self.raw):
            self.raw = np.concatenate((self.raw, np.empty(len(self.raw), np.uint8)))
        self.raw[self.used : self.used + len(joined)] = joined
        self.starts = np.concatenate((self.starts, self.used + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.again = np.concatenate((self.again, np.zeros(len(sizes), bool)))
        self.used += len(joined)
        return first + np.arange(len(parts))

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.store.n > self.most:
            self._forget()
        size = ends - starts
        distinct, first, inverse = _distinct(hashes)
        at = np.searchsorted(self.hashes, distinct)
        known = at < len(self.hashes)
        known[known] = self.hashes[at[known]] == distinct[known]
        numbers = np.zeros(len(distinct), np.int64)
        numbers[known] = self.numbers[at[known]]
        self.again[numbers[known]] = True
        raw = data.tobytes()
        new = first[~known]
        if len(new):
            numbers[~known] = self._add(raw, starts[new], size[new])
            self.numbers = np.insert(self.numbers, at[~known], numbers[~known])
            self.hashes = np.insert(self.hashes, at[~known], distinct[~known])
        of = numbers[inverse]
        odd = size != self.sizes[of]
        alike = np.flatnonzero(~odd)
        odd[alike] = differ(data, starts[alike], self.raw[: self.used], self.starts[of[alike]], size[alike])
        if odd.any():
            of[odd] = self._add(raw, starts[odd], size[odd])
        return self.store.gather(of, per_text)
