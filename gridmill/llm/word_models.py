"""Matched bigram models of words, whose counts grow with the corpus.

A token is a run of letters and digits, one other ASCII sign, or one character of
three or more UTF-8 bytes (scripts that write words without spaces); a text's
bounds are a token too.  Tokens and pairs are known by 64-bit hashes of their whole
bytes; nothing is folded and no count is dropped.

Both models have the vocabulary of both collections, the order and the smoothing in
common, and one size: the background's counts are scaled by ``r`` to as many tokens
as the target has, which are the expected counts of a sample of that size, taken
over all documents:

    p(w) = (r n(w) + KAPPA b(w)) / (r N + KAPPA),  b(w) the share of w in the background and target
    p(w | c) = (r n(c, w) + MU p(w)) / (r n(c) + MU)

Counts are added up in shards of keys, and come back to the blocks of texts that
asked for them (``shardjoin``); no task and not the driver holds a model.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm import shardjoin
from gridmill.llm.textbytes import SPACE_BYTES, mix64, word_hashes
from gridmill.llm.workers import tidy

MU, KAPPA = 20.0, 1000.0
_SPACE, _WORD, _SIGN = range(3)
_BOUND = np.uint64(1)  # stands before the first token and after the last
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def _kinds() -> np.ndarray:
    out = np.full(256, _SIGN, np.uint8)
    out[list(SPACE_BYTES)] = _SPACE
    for a, b in (("0", "9"), ("A", "Z"), ("a", "z")):
        out[ord(a) : ord(b) + 1] = _WORD
    out[0xC0:0xE0] = _WORD
    return out


_KIND = _kinds()


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every token in the rows' bytes."""
    if not len(data):
        none = np.empty(0, np.int64)
        return none, none, none
    places = np.flatnonzero((data & 0xC0) != 0x80)
    kind = _KIND[data[places]]
    edge = kind != _WORD
    edge[1:] |= kind[:-1] != _WORD
    edge[np.searchsorted(places, offsets[:-1][np.diff(offsets) > 0])] = True
    starts, kind = places[edge], kind[edge]
    ends = np.concatenate((starts[1:], [len(data)]))
    real = kind != _SPACE
    starts, ends = starts[real], ends[real]
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def events(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, context, token) of every token and of the end of every text that has one."""
    starts, ends, rows = tokens_of(data, offsets)
    n = np.bincount(rows, minlength=len(offsets) - 1)
    n = n[n > 0]
    last = np.cumsum(n) + np.arange(len(n))  # places of the ends
    token = np.full(len(rows) + len(n), _BOUND)
    inner = np.ones(len(token), bool)
    inner[last] = False
    token[inner] = word_hashes(data, starts, ends)
    row = np.empty(len(token), np.int64)
    row[inner] = rows
    row[last] = row[last - 1]
    # The token before a text's first one is the end of the text before it.
    return row, np.concatenate(([_BOUND], token[:-1])) if len(token) else token, token


def keys_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[int], tuple[np.ndarray, int]]:
    """Keys of all tokens, then those of all pairs; where the first part ends; rows of tokens and their number."""
    row, context, token = events(data, offsets)
    return shardjoin.as_keys(np.concatenate((mix64(token), mix64(mix64(context) * _PAIR + token)))), [len(token)], (row, len(offsets) - 1)


def _losses(state: tuple[np.ndarray, int], ranks: list[np.ndarray], found: list[np.ndarray]) -> list[np.ndarray]:
    """n_tokens and mean losses under the target and the background of each row."""
    row, n_rows = state
    token, pair = ranks
    size = np.bincount(row, minlength=n_rows)
    out = [np.maximum(size - 1, 0).astype(np.int64)]
    # A context is the token before it, and the bound, which is some text's end, before a first one.
    before = np.concatenate((token[-1:], token[:-1]))
    background, target = (x.astype(np.float64) for x in found)
    both = (background + target) / max(1.0, background[0] + target[0])
    for count in (target, background):
        total = count[0]
        r = target[0] / total if target[0] and total else 1.0
        p = (r * count + KAPPA * both) / (r * total + KAPPA)
        loss = -np.log((r * count[pair] + MU * p[token]) / (r * count[before] + MU))
        out.append(np.bincount(row, weights=loss, minlength=n_rows) / np.maximum(size, 1))
    return out


def losses(docs: DataFrame, target: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss): mean losses in nats a token of every row of ``docs``, which is the background."""
    docs = shardjoin.stable(docs)
    shards = shardjoin.shard_number(docs, text_col)
    asked = shardjoin.ask(docs, keys_of, shards, True, text_col=text_col).unionByName(shardjoin.ask(target, keys_of, shards, False, text_col=text_col))
    dealt = asked.repartition(shardjoin.partitions(shards), "shard").sortWithinPartitions("shard", "block")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in shardjoin.runs(batches, "shard"):
            keys = [shardjoin.unpacked_keys(r["keys"]) for r in rows]
            distinct, rank = np.unique(np.concatenate(keys), return_inverse=True)
            rank = np.split(rank.astype(np.int32), np.cumsum([len(k) for k in keys])[:-1])
            counts = np.zeros((2, len(distinct)), np.int64)
            for r, at in zip(rows, rank, strict=True):
                counts[0 if r["block"] is not None else 1][at] += shardjoin.widened(r["counts"]).astype(np.int64)
            seen = None
            for r, at in zip(rows, rank, strict=True):
                if r["block"] is not None and r["block"] != seen:
                    seen = r["block"]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r["shard"]], pa.int32()), pa.array([seen], pa.binary()), *(pa.array([shardjoin.narrowed(c[at])], pa.binary()) for c in counts)], names=["shard", "block", "v0", "v1"]
                    )

    answers = dealt.mapInArrow(tidy(answer), "shard int, block binary, v0 binary, v1 binary")
    return shardjoin.meet(docs, answers, keys_of, _losses, [None, None], ["n_tokens", "target_loss", "background_loss"], shards, text_col=text_col)
