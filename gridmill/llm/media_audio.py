"""Audio features of byte payloads: polyphase resampling, log-mel bands, energy segments.

A text's UTF-8 bytes, padded with spaces to a positive multiple of 192, are the
unsigned 8-bit samples of a mono WAV stream.  The stream is written, read back,
resampled by a rational polyphase filter, cut into overlapping frames, turned
into log-mel bands, and segmented by energy with hysteresis.  Per row there is a
tensor of fixed shape (``SPANS`` x ``MELS``: mean bands over equal time spans), the
spans' edges and the list of active segments with their times.  Features are stored
as blocks of Arrow's stream format, in which tensors and spans are fixed-shape tensor
columns (``stored_features``, ``read_block``).

Null text counts as empty (192 spaces); equal texts give equal rows; row order
and extra columns do not matter; an empty table gives an empty one.  Frames are
computed in blocks, so memory is a small multiple of one text.  The last frame is
padded with silence, so every sample is in a frame.
"""

from __future__ import annotations

import hashlib
import io
import struct
import wave
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.workers import tidy

UNIT = 192
RATE_IN = 16_000
UP, DOWN = 3, 8
RATE = RATE_IN * UP // DOWN
FRAME, HOP, MELS, SPANS = 256, 128, 16, 8
TAPS = 16
BLOCK_FRAMES = 2048

TENSOR = pa.fixed_shape_tensor(pa.float32(), [SPANS, MELS], dim_names=["span", "mel"])
EDGES = pa.fixed_shape_tensor(pa.float32(), [SPANS + 1], dim_names=["edge"])
_COUNTS = ("doc_id", "n_bytes", "payload_bytes")
#: The columns of a stored block.
STORED = pa.schema(
    [(k, pa.int64()) for k in _COUNTS]
    + [("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_frames", pa.int64())]
    + [("log_mel", TENSOR), ("span_ms", EDGES), ("segment_ms", pa.list_(pa.struct([("start", pa.float32()), ("end", pa.float32())])))]
)
BLOCK_ROWS = 500


def padded(raw: bytes) -> bytes:
    """``raw`` with spaces appended up to a positive multiple of 192 bytes."""
    return raw + b" " * ((-len(raw)) % UNIT if raw else UNIT)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE_IN)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


@lru_cache(maxsize=1)
def _filter() -> np.ndarray:
    """UP x TAPS: the phases of a windowed-sinc low-pass filter, each in reversed order."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.blackman(n)
    h *= UP / h.sum()
    return np.ascontiguousarray(h.reshape(TAPS, UP).T[:, ::-1]).astype(np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """ceil(len(x) * UP / DOWN) samples; each output phase is one strided product."""
    n_out = -(-len(x) * UP // DOWN)
    y = np.empty(n_out, np.float32)
    view = np.lib.stride_tricks.sliding_window_view(np.concatenate((np.zeros(TAPS - 1, np.float32), x, np.zeros(TAPS, np.float32))), TAPS)
    for first in range(min(UP, n_out)):
        n = np.arange(first, n_out, UP)
        at, phase = first * DOWN // UP, first * DOWN % UP
        y[n] = view[at : at + DOWN * len(n) : DOWN][: len(n)] @ _filter()[phase]
    return y


@lru_cache(maxsize=1)
def _mel() -> tuple[np.ndarray, np.ndarray]:
    """(window, FRAME/2+1 x MELS triangular bank)."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(30.0), mel(RATE / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / RATE)[:, None]
    up, down = (f - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - f) / (edges[2:] - edges[1:-1])
    return np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log bands, frame energies in dB); the signal is padded to whole frames."""
    n = 1 + max(0, -(-(len(y) - FRAME) // HOP))
    y = np.concatenate((y, np.zeros((n - 1) * HOP + FRAME - len(y), np.float32)))
    window, bank = _mel()
    frames = np.lib.stride_tricks.sliding_window_view(y, FRAME)[::HOP]
    bands, energy = np.empty((len(frames), MELS), np.float32), np.empty(len(frames), np.float32)
    for a in range(0, len(frames), BLOCK_FRAMES):
        part = frames[a : a + BLOCK_FRAMES] * window
        spectrum = np.fft.rfft(part, axis=1)
        power = spectrum.real**2 + spectrum.imag**2
        bands[a : a + len(part)] = np.log(power @ bank + 1e-6)
        energy[a : a + len(part)] = 10 * np.log10(power.sum(axis=1) + 1e-6)
    return bands, energy


def segments(energy: np.ndarray, above: float = 1.0, below: float = 0.0) -> list[tuple[int, int]]:
    """Runs of frames above mean + ``below`` dB that somewhere exceed mean + ``above`` dB."""
    level = energy - energy.mean()
    low = np.concatenate(([False], level > below, [False]))
    edges = np.flatnonzero(low[1:] != low[:-1])
    peaks = np.concatenate(([0], np.cumsum(level > above)))
    return [(int(a), int(b)) for a, b in edges.reshape(-1, 2) if peaks[b] > peaks[a]]


def features(payload: bytes) -> tuple[int, np.ndarray, np.ndarray, list[tuple[float, float]]]:
    """(frames, SPANS x MELS tensor, SPANS + 1 span edges in ms, active segments in ms)."""
    x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    bands, energy = log_mel(resample(x))
    n = len(bands)
    sums = np.concatenate((np.zeros((1, MELS)), np.cumsum(bands, axis=0, dtype=np.float64)))
    edge = np.arange(SPANS + 1) * n // SPANS
    lo, hi = edge[:-1], np.maximum(edge[1:], np.minimum(edge[:-1] + 1, n))
    lo = np.minimum(lo, hi - 1)
    tensor = (sums[hi] - sums[lo]) / (hi - lo)[:, None]
    ms = HOP * 1000 / RATE
    return n, tensor.astype(np.float32), (edge * ms).astype(np.float32), [(a * ms, b * ms) for a, b in segments(energy)]


def describe(doc_id: int | None, text: str | None) -> dict:
    raw = (text or "").encode("utf-8", "surrogatepass")
    payload = padded(raw)
    stored = to_wav(payload)
    back = from_wav(stored)
    n, tensor, edges, active = features(back)
    return {
        "doc_id": doc_id, "n_bytes": len(raw), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-16:]),
        "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "n_frames": n, "log_mel": tensor.ravel(), "span_ms": edges,
        "segment_ms": [{"start": a, "end": b} for a, b in active],
    }


def block_of(rows: list[dict]) -> bytes:
    """Rows of ``describe`` as one Arrow stream with fixed-shape tensor columns."""
    columns = []
    for f in STORED:
        if isinstance(f.type, pa.FixedShapeTensorType):
            values = pa.array(np.concatenate([np.asarray(r[f.name], np.float32) for r in rows]) if rows else np.empty(0, np.float32))
            columns.append(pa.ExtensionArray.from_storage(f.type, pa.FixedSizeListArray.from_arrays(values, int(np.prod(f.type.shape)))))
        else:
            columns.append(pa.array([r[f.name] for r in rows], f.type))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, STORED) as out:
        out.write_batch(pa.RecordBatch.from_arrays(columns, schema=STORED))
    return sink.getvalue().to_pybytes()


def read_block(block: bytes) -> pa.Table:
    """A stored block; ``log_mel`` and ``span_ms`` are fixed-shape tensor columns."""
    return pa.ipc.open_stream(block).read_all()


def stored_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(n_rows, block): the features of all rows in blocks of at most BLOCK_ROWS rows; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(a, BLOCK_ROWS)
                rows = [describe(*x) for x in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([len(rows)], pa.int64()), pa.array([block_of(rows)], pa.binary())], names=["n_rows", "block"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run), "n_rows long, block binary")


def digest(stored: DataFrame) -> DataFrame:
    """A row for each row of the stored blocks, with tensor, spans and segments condensed to one string."""
    names = [*_COUNTS, "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in batch.column(1):
                table = read_block(block.as_py())
                mel, edges = (table.column(k).combine_chunks() for k in ("log_mel", "span_ms"))
                # Thousandths of the natural logarithm.
                mel = np.round(mel.to_numpy_ndarray().reshape(table.num_rows, -1) * 1000).astype("<i4")
                edges = np.round(edges.to_numpy_ndarray().reshape(table.num_rows, -1)).astype("<i4")
                found = []
                for i, (n, active) in enumerate(zip(table.column("n_frames").to_pylist(), table.column("segment_ms").to_pylist(), strict=True)):
                    times = ",".join(f"{s['start']:.0f}-{s['end']:.0f}" for s in active)
                    found.append(f"frames={n};mel={hashlib.md5(mel[i].tobytes()).hexdigest()};spans={edges[i][-1]};segments={len(active)}:{hashlib.md5(times.encode()).hexdigest()}")
                yield pa.RecordBatch.from_arrays([*(table.column(k).combine_chunks() for k in names), pa.array(found, pa.string())], names=[*names, "feature"])

    return stored.select("n_rows", "block").mapInArrow(tidy(run), ", ".join(f"{k} {'string' if 'sha256' in k else 'long'}" for k in names) + ", feature string")


def stored_wav(text: str | None) -> bytes:
    """The stored form of a text: what ``media_sha256`` hashes."""
    return to_wav(padded((text or "").encode("utf-8", "surrogatepass")))


def decode_wav(stored: bytes) -> bytes:
    """The samples of a stored form, by the RIFF header alone (an independent reader for checks)."""
    at = stored.index(b"data") + 4
    return stored[at + 4 : at + 4 + struct.unpack("<I", stored[at : at + 4])[0]]
