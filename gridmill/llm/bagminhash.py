"""BagMinHash signatures of weighted sets (multisets of shingles).

For every element a Poisson process runs over its weight levels.  Levels are
discretised to integers and grouped in dyadic blocks (1), (2), (3, 4), (5..8),
...: one process per block, whose rate is the block's size, stands for the unit
processes of its levels; each of its points is split down to one level and
counts if that level lies within the element's weight.  Register k keeps the
time of the earliest counted point dealt to it.  Two multisets agree in a
register with the probability of their weighted Jaccard similarity, because the
points of the levels they share are the same and those of others are not.
"""

from __future__ import annotations

import numpy as np

from gridmill.llm.textbytes import mix64

_STEP = np.uint64(0x9E3779B97F4A7C15)


def signatures(rows: np.ndarray, elements: np.ndarray, counts: np.ndarray, n_rows: int, m: int) -> np.ndarray:
    """n_rows x m float64 times; a row without elements has inf throughout."""
    best = np.full(n_rows * m, np.inf)
    if not len(rows):
        return best.reshape(n_rows, m)
    # One process for each element and dyadic block that its weight reaches into.
    n_blocks = 1 + np.ceil(np.log2(np.maximum(counts, 1))).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), n_blocks)
    block = np.arange(len(of)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
    size = np.where(block == 0, 1, 1 << np.maximum(block - 1, 0)).astype(np.int64)
    below = np.where(block == 0, 0, size)
    row, weight = rows[of], counts[of]
    state = mix64(elements[of] * _STEP + block.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    time = np.zeros(len(of))
    left = np.full(n_rows, np.inf)
    each = 1
    while len(row):
        # ``each`` points of every process that is still alive, as a table.
        state = state[:, None] + _STEP * np.arange(1, each + 1, dtype=np.uint64)
        bits = mix64(state)
        state = state[:, -1]
        gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        times = time[:, None] + np.cumsum(gap, axis=1) / size[:, None]
        time = times[:, -1].copy()
        pick = mix64(bits ^ np.uint64(0x94D049BB133111EB))
        register = ((pick >> np.uint64(40)) * np.uint64(m) >> np.uint64(24)).astype(np.int64)
        level = below[:, None] + (((pick & np.uint64(0xFFFFFFFF)) * size[:, None].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        good = (level < weight[:, None]) & (times < left[row][:, None])
        np.minimum.at(best, (row[:, None] * m + register)[good], times[good])
        left = best.reshape(n_rows, m).max(axis=1)
        alive = time < left[row]
        row, weight, size, below, state, time = (x[alive] for x in (row, weight, size, below, state, time))
        each = int(min(256, max(1, 40_000 // max(1, len(row)))))
    return best.reshape(n_rows, m)


def band_keys(times: np.ndarray, bands: int, band_rows: int) -> np.ndarray:
    """n x bands signed 64-bit keys, each a hash of ``band_rows`` registers and the band's number."""
    bits = np.ascontiguousarray(times).view(np.uint64).reshape(len(times), -1)
    out = np.empty((len(times), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(times), np.uint64(b + 1))
        for k in range(band_rows):
            key = mix64(key * _STEP + bits[:, b * band_rows + k])
        out[:, b] = key
    return out.view(np.int64)


def overlaps(rows_a: np.ndarray, hash_a: np.ndarray, rows_b: np.ndarray, hash_b: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the minima and maxima of the counts of row i of either side, for each i < n."""
    from gridmill.llm.textbytes import bags

    ra, ea, ca = bags(rows_a, hash_a)
    rb, eb, cb = bags(rows_b, hash_b)
    ka = (ra.astype(np.uint64) << np.uint64(52)) | ea
    kb = (rb.astype(np.uint64) << np.uint64(52)) | eb
    at = np.searchsorted(kb, ka)
    hit = at < len(kb)
    hit[hit] = kb[at[hit]] == ka[hit]
    shared = np.bincount(ra[hit], weights=np.minimum(ca[hit], cb[at[hit]]), minlength=n)
    total = np.bincount(ra, weights=ca, minlength=n) + np.bincount(rb, weights=cb, minlength=n)
    return shared.astype(np.int64), (total - shared).astype(np.int64)


def overlaps_of(starts: np.ndarray, elements: np.ndarray, counts: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of minima and maxima for the pairs (x, y) of bags that lie end to end from ``starts``, sorted within each."""
    shared, total = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    ends = np.cumsum(np.concatenate(([0], counts)))
    weight = ends[starts[1:]] - ends[starts[:-1]]
    size = np.diff(starts)
    at = 0
    while at < len(x):
        # Pairs are taken in runs of a bounded number of elements (or one pair).
        n = int(np.searchsorted(np.cumsum(size[x[at:]] + size[y[at:]]), 2_000_000)) or 1
        p, q = x[at : at + min(n, 4000)], y[at : at + min(n, 4000)]
        key, which = [], []
        for side in (p, q):
            many = size[side]
            pair = np.repeat(np.arange(len(side)), many)
            index = starts[side][pair] + np.arange(len(pair)) - np.repeat(np.cumsum(many) - many, many)
            key.append((pair.astype(np.uint64) << np.uint64(52)) | elements[index])
            which.append((pair, index))
        found = np.searchsorted(key[1], key[0])
        hit = found < len(key[1])
        hit[hit] = key[1][found[hit]] == key[0][hit]
        low = np.minimum(counts[which[0][1][hit]], counts[which[1][1][found[hit]]])
        shared[at : at + len(p)] = np.bincount(which[0][0][hit], weights=low, minlength=len(p))
        total[at : at + len(p)] = weight[p] + weight[q]
        at += len(p)
    return shared, total - shared
