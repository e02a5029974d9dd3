"""Language identification by a byte convolutional network.

Every text is cut into windows of ``WINDOW`` bytes (the last padded with zero
bytes).  Bytes are embedded, filters of several widths slide over a window, each
filter keeps its maximum, and a softmax turns the pooled maxima into language
probabilities.  A text's probabilities are the mean over its windows, weighted by
their bytes, so all of the text counts.  Training is plain numpy with Adam on a
bounded sample of labelled texts: about ``SAMPLE_PER_LANGUAGE`` texts a language,
chosen by a hash of the id, and ``WINDOWS_PER_TEXT`` windows of each, spread evenly
over the whole text.  More than ``MAX_LANGUAGES`` labels raise an error.

Null text, and text without a letter (Unicode category L), is ``und`` with score 0.
Without any labelled text every document is ``und``.  The prediction uses the text
alone, so repeated rows get equal results; a long text is read in blocks of windows,
and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.llm.textbytes import blocks, utf8_buffers
from gridmill.llm.workers import tidy

WINDOW = 192
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
SAMPLE_PER_LANGUAGE = 600
#: Windows of a sampled text that training looks at, from all over the text (prediction reads all).
WINDOWS_PER_TEXT = 24
MAX_LANGUAGES = 1000

_LETTER = regex.compile(r"\p{L}")


@dataclass
class ByteCNN:
    """Parameters: ``embed`` 256 x EMBED, one (width * EMBED) x FILTERS matrix a width, biases, softmax layer."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """n x (widths * FILTERS) maxima over the places of each window (n x WINDOW bytes)."""
        x = self.embed.astype(np.float32)[windows].reshape(len(windows), -1)
        parts = []
        for w, f, b in zip(WIDTHS, self.filters, self.bias, strict=True):
            view = np.lib.stride_tricks.sliding_window_view(x, w * EMBED, axis=1)[:, ::EMBED]
            n, places, _ = view.shape
            act = (np.ascontiguousarray(view).reshape(n * places, w * EMBED) @ f.astype(np.float32)).reshape(n, places, FILTERS)
            parts.append(np.maximum(act.max(axis=1) + b, 0))
        return np.concatenate(parts, axis=1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        if not self.langs:
            return np.zeros((len(windows), 1))
        z = self.pooled(windows) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n x WINDOW bytes, row, bytes) of the windows of all rows; an empty row has none."""
    length = np.diff(offsets)
    n = -(-length // WINDOW)
    row = np.repeat(np.arange(len(length)), n)
    start = offsets[:-1][row] + (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * WINDOW
    size = np.minimum(WINDOW, offsets[1:][row] - start)
    padded = np.concatenate((data, np.zeros(WINDOW, np.uint8)))
    out = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[start].copy() if len(start) else np.zeros((0, WINDOW), np.uint8)
    out[np.arange(WINDOW) >= size[:, None]] = 0
    return out, row, size


def windows_of(texts: list[str], most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(n x WINDOW bytes, row): windows of the texts, at most ``most`` of each at even steps; ends of a few bytes are left out."""
    data, offsets = utf8_buffers(pa.array(texts, pa.large_string()))
    windows, row, size = cut(data, offsets)
    good = size >= WINDOW // 8
    if most:
        n = np.bincount(row, minlength=len(texts))
        place = np.arange(len(row)) - (np.cumsum(n) - n)[row]
        # Of n windows the ones at which the even steps of length n / most begin.
        good &= (n[row] <= most) | ((place + 1) * most // n[row] > place * most // n[row])
    return windows[good], row[good]


def train(texts: list[str], labels: list[str], epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> ByteCNN:
    """A model of the labels of texts; classes weigh the same whatever their sizes."""
    windows, row = windows_of(texts, WINDOWS_PER_TEXT)
    return train_windows(windows, [labels[i] for i in row], sorted(set(labels)), epochs, batch, rate, seed)


def train_windows(windows: np.ndarray, labels: list[str], langs: list[str], epochs: int = 6, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> ByteCNN:
    """A model of labelled windows."""
    rng = np.random.default_rng(seed)
    y = np.searchsorted(langs, labels) if len(windows) else np.empty(0, int)
    # The windows of a class, dealt evenly: a bounded number a class and epoch.
    per_class = [np.flatnonzero(y == c) for c in range(len(langs))]
    each = int(min(2500, max((len(p) for p in per_class), default=0)))
    p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))), "ob": np.zeros(len(langs))}
    for i, w in enumerate(WIDTHS):
        p[f"f{i}"], p[f"b{i}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)), np.zeros(FILTERS)
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for _ in range(epochs if each else 0):
        order = rng.permutation(np.concatenate([rng.choice(c, each, replace=len(c) < each) for c in per_class if len(c)]))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            grads, t = _gradients(p, windows[pick], y[pick]), t + 1
            for k, g in grads.items():
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] -= rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)
    n = range(len(WIDTHS))
    return ByteCNN(langs, p["embed"], [p[f"f{i}"] for i in n], [p[f"b{i}"] for i in n], p["out"], p["ob"])


def _gradients(p: dict[str, np.ndarray], windows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean cross-entropy."""
    n = len(windows)
    x = p["embed"][windows].reshape(n, -1)
    pooled, kept = [], []
    for i, w in enumerate(WIDTHS):
        view = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, w * EMBED, axis=1)[:, ::EMBED])
        act = view.reshape(-1, w * EMBED) @ p[f"f{i}"]
        act = act.reshape(n, -1, FILTERS)
        at = act.argmax(axis=1)
        top = np.take_along_axis(act, at[:, None, :], axis=1)[:, 0] + p[f"b{i}"]
        pooled.append(np.maximum(top, 0))
        kept.append((view, at, top > 0))
    h = np.concatenate(pooled, axis=1)
    z = h @ p["out"] + p["ob"]
    z = np.exp(z - z.max(axis=1, keepdims=True))
    z /= z.sum(axis=1, keepdims=True)
    z[np.arange(n), y] -= 1
    z /= n
    grads = {"out": h.T @ z, "ob": z.sum(axis=0), "embed": np.zeros_like(p["embed"])}
    dh = z @ p["out"].T
    for i, w in enumerate(WIDTHS):
        view, at, on = kept[i]
        d = dh[:, i * FILTERS : (i + 1) * FILTERS] * on
        patches = view[np.arange(n)[:, None], at]  # n x FILTERS x (w * EMBED)
        grads[f"f{i}"] = np.einsum("nfk,nf->kf", patches, d, optimize=True)
        grads[f"b{i}"] = d.sum(axis=0)
        back = d[:, :, None] * p[f"f{i}"].T[None]
        places = windows[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]
        np.add.at(grads["embed"], places.ravel(), back.reshape(n, FILTERS, w, EMBED).reshape(-1, EMBED))
    return grads


def sample_limit(count: int, per_language: int) -> int:
    """A hash of 62 bits below this takes about 1.2 * ``per_language`` of ``count`` rows, whatever the count."""
    return min(1 << 62, max(1, (6 * per_language << 62) // (5 * count)))


def labelled_sample(docs: DataFrame, allowed: Column, per_language: int = SAMPLE_PER_LANGUAGE) -> tuple[np.ndarray, list[str], list[str]]:
    """(windows, their labels, all labels) of about ``per_language`` texts a language, at most twice that on average, by a hash of the id.

    Counts come first, so that each language's share of the hash range is known and
    the filter runs where the rows are; texts are cut there too, so the driver gets
    at most WINDOWS_PER_TEXT windows of a text.
    """
    usable = docs.filter(allowed & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES + 1).collect()
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), [], []
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} labels: raise MAX_LANGUAGES")
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], sample_limit(r["count"], per_language))])
    rank = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col("doc_id")), 2)
    most = WINDOWS_PER_TEXT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(0), 4 << 20):
                part = batch.slice(a, b - a)
                windows, row = windows_of(part.column(0).to_pylist(), most)
                texts = [windows[row == i].tobytes() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), part.column(1), part.column(2), part.column(3)], names=["windows", "lang", "rank", "doc_id"])

    chosen = usable.select("text", "lang", rank.alias("rank"), "doc_id").filter(F.col("rank") < share[F.col("lang")])
    doc_type = chosen.schema["doc_id"].dataType.simpleString()
    # Rows of one id and language share a rank; a bound on what the driver gets holds for them too.
    rows = chosen.mapInArrow(tidy(run), f"windows binary, lang string, rank long, doc_id {doc_type}").orderBy("rank", "doc_id", "windows").limit(2 * per_language * len(counts)).collect()
    raw = np.frombuffer(b"".join(r["windows"] for r in rows), np.uint8).reshape(-1, WINDOW)
    return raw, [r["lang"] for r in rows for _ in range(len(r["windows"]) // WINDOW)], sorted(r["lang"] for r in counts)


def held_out(id_col: str = "doc_id") -> Column:
    """Documents that training never sees: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, model: ByteCNN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    arrow = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])

    def predict(column: pa.Array) -> tuple[list[str], list[float]]:
        net = shared.value
        data, offsets = utf8_buffers(column)
        windows, row, size = cut(data, offsets)
        n = len(offsets) - 1
        totals = np.zeros((n, max(1, len(net.langs))))
        for a in range(0, len(windows), 512):
            part = net.probabilities(windows[a : a + 512]) * size[a : a + 512, None]
            np.add.at(totals, row[a : a + 512], part)
        totals /= np.maximum(np.diff(offsets), 1)[:, None]
        best = totals.argmax(axis=1)
        known = np.array([bool(net.langs) and t is not None and _LETTER.search(t) is not None for t in column.to_pylist()])
        return [net.langs[b] if k else "und" for b, k in zip(best, known, strict=True)], np.where(known, np.clip(totals.max(axis=1), 0, 1), 0.0).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in blocks(batch.column(1), 2 << 20):
                part = batch.slice(a, b - a)
                lang, score = predict(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], schema=arrow)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "doc_id long, lang_pred string, score double")


def language_of(docs: DataFrame) -> DataFrame:
    """Train on the documents that are not held out and predict all: doc_id, held_out, lang_pred, score."""
    return identify(docs, train_windows(*labelled_sample(docs, ~held_out()))).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score")
