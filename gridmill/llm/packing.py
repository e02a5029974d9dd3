"""Lexical retrieval packing: fixed windows of related documents.

1. Every text is tokenized once; the ids go to the shared folder.
2. Document frequencies, lengths and their number are added up over all documents:
   a table of at most the tokenizer's vocabulary, which every task gets.
3. Documents are dealt into shards by what they say: the sort key is four minimum
   hashes of their terms, weighted by BM25, so documents that share telling terms lie
   side by side wherever they came from, and copies next to one another.  The order is
   cut into ranges; ties are split by row, so no group of copies is one task's.
4. A task cuts its range into shards of at most ``BLOCK_TOKENS`` tokens (or one
   document) and builds each shard's inverted index with the corpus-wide weights.  A
   window starts with a seed document; the index returns unused neighbours, best
   first, and they fill the window greedily.  The document at the window's end is cut
   there, and its rest seeds the next window, so windows have no padding.  A shard's
   last tokens, fewer than a window, are dealt into sequences of powers of two.

Neighbours come from the seed's shard, not from all of them: README gives their share
of the true nearest documents.  Null text counts as empty: its only token is the end
token.  Repeated rows are packed as often as they occur, a long text is packed whole
over many windows, and an empty table gives an empty one.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.piececache import SlicedCache, PieceCache
from gridmill.llm.shared import saved
from gridmill.llm.textbytes import blocks, mix64, word_hashes
from gridmill.llm.workers import FORGET, tidy

WINDOW = 2048
END_ID = 1
BLOCK_TOKENS = 3_000_000
MOST_PARTITIONS = 20_000
#: A seed's query is its most telling terms.
QUERY_TERMS = 24
#: Neighbours are ranked so many at a time.
RANKED = 256
HASHES = 4
#: Ranges of shards are cut by the sort keys of about so many documents each.
KEYS_A_RANGE = 100
K1, B = 1.2, 0.75
CACHE_WORDS = 600_000

_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SPACE, _LETTER, _DIGIT, _SYMBOL = range(4)


def _latin_tables() -> tuple[np.ndarray, np.ndarray, dict[int, str]]:
    """For the characters below U+0100: lower case, kind, and the sign that the byte-level vocabulary writes a byte as."""
    chars = [chr(i) for i in range(256)]
    lower = np.array([ord(c.lower()) for c in chars], np.uint8)
    kind = np.full(256, _SYMBOL, np.uint8)
    for i, c in enumerate(chars):
        category = unicodedata.category(c)
        if c in "\t\n\x0b\x0c\r \x85\xa0":
            kind[i] = _SPACE
        elif category[0] in "LN":
            kind[i] = _LETTER if category[0] == "L" else _DIGIT
    shown = [i for i in range(256) if chr(i).isprintable() and not chr(i).isspace() and i != 0xAD]
    hidden = [i for i in range(256) if i not in shown]
    return lower, kind, {i: chr(i) for i in shown} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_LOWER, _KIND, _SIGNS = _latin_tables()


def latin_parts(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the parts that the tokenizer cuts lower-case Latin-1 text into.

    Parts are runs of letters, single digits, and runs of other signs; an apostrophe that
    starts a run of signs takes a following s, t, m, d, re, ve or ll with it.
    """
    kind = np.concatenate((_KIND[data], np.zeros(3, np.uint8)))
    padded = np.concatenate((data, np.zeros(3, np.uint8)))
    before = np.concatenate((np.zeros(1, np.uint8), kind[:-1]))
    edge = (kind != before) | (kind == _DIGIT)
    at = np.flatnonzero(padded[:-3] == ord("'"))
    at = at[(before[at] != _SYMBOL) & (kind[at + 1] == _LETTER)]
    if len(at):
        one, two = padded[at + 1], padded[at + 2]
        single = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        double = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        edge[at[single | double] + 1] = False
        after = np.concatenate((at[single] + 2, at[double] + 3))
        edge[after[kind[after] == _LETTER]] = True
    places = np.flatnonzero(edge)
    inside = np.flatnonzero(kind[places] != _SPACE)
    return places[inside], places[inside + 1]


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ARROW = pa.schema([(k, pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


class Tokens:
    """Ids of whole texts, of which each distinct part is tokenized once.

    Texts of characters below U+0100 are lower-cased and cut here as the tokenizer does
    (composition changes nothing there), and its model is asked for each new part;
    other texts are cut at white space, which no token reaches across.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.latin, self.other = SlicedCache(self._segment_latin, CACHE_WORDS), PieceCache(self._segment, CACHE_WORDS // 8)

    def _segment(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self._end_to_end([e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)])

    def _segment_latin(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        # A part's UTF-8 bytes, each written as its sign, are what the byte-level model takes.
        tokenize = self.model.tokenize
        texts = [p.decode("latin-1") for p in parts]
        # Printable ASCII is written as itself.
        signs = [s if s.isascii() and s.isprintable() else s.encode().decode("latin-1").translate(_SIGNS) for s in texts]
        return self._end_to_end([[t.id for t in tokenize(s)] for s in signs])

    @staticmethod
    def _end_to_end(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        latin: list[int] = []
        raw: list[bytes] = []
        for i, t in enumerate(texts):
            try:
                raw.append(t.encode("latin-1"))
                latin.append(i)
            except UnicodeEncodeError:
                pass
        if latin:
            data = _LOWER[np.frombuffer(b" ".join(raw), np.uint8)]
            begin = np.concatenate(([0], np.cumsum([len(r) + 1 for r in raw])))
            starts, ends = latin_parts(data)
            per_text = np.diff(np.searchsorted(starts, begin))
            ids, offsets = self.latin.encode(data, starts, ends, word_hashes(data, starts, ends), per_text)
            for i, part in zip(latin, np.split(ids, offsets[1:-1]), strict=True):
                out[i] = part
        rest = [i for i, x in enumerate(out) if x is None]
        if rest:
            ids, offsets = self.other.encode([_WORD.findall(texts[i]) for i in rest])
            for i, part in zip(rest, np.split(ids, offsets[1:-1]), strict=True):
                out[i] = part
        return out


_kept: dict[str, Tokens] = {}


def tokens(path: str) -> Tokens:
    """One instance a worker, whose bounded memory of parts serves task after task until the worker turns to other work."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _kept:
        _kept.clear()
        _kept[path] = Tokens(path)
    FORGET["packing"] = _kept.clear
    return _kept[path]


def distinct_terms(docs: list[np.ndarray], vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count) of each distinct term of each document, in that order."""
    kind = np.uint32 if len(docs) * vocabulary < 1 << 32 else np.int64
    size = np.array([len(d) for d in docs], np.int64)
    keys = np.repeat((np.arange(len(docs)) * vocabulary).astype(kind), size)
    np.add(keys, np.concatenate(docs) if len(docs) else 0, out=keys, casting="unsafe")
    keys.sort()
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    doc, term = np.divmod(keys[first], kind(vocabulary))
    return doc.astype(np.int64), term.astype(np.int64), np.diff(np.concatenate((first, [len(keys)])))


@dataclass
class Corpus:
    """What all documents tell about terms: number of documents, their mean length, and the weight of each term."""

    docs: int
    mean: float
    idf: np.ndarray

    @staticmethod
    def of(df: np.ndarray, docs: int, total: int) -> Corpus:
        return Corpus(docs, total / max(1, docs), np.log1p((docs - df + 0.5) / (df + 0.5)))

    def terms(self, docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, term, BM25 weight) of each distinct term of each document, in that order."""
        size = np.array([len(d) for d in docs], np.int64)
        doc, term, count = distinct_terms(docs, len(self.idf))
        return doc, term, self.idf[term] * count * (K1 + 1) / (count + K1 * (1 - B + B * size[doc] / max(1.0, self.mean)))

    def signatures(self, docs: list[np.ndarray]) -> np.ndarray:
        """One sort key a document: HASHES terms of 16 bits, each the least of its terms' exponential times at the rate of their weights."""
        doc, term, weight = self.terms(docs)
        out = np.zeros(len(docs), np.uint64)
        if not len(doc):
            return out.view(np.int64)
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        for k in range(HASHES):
            bits = mix64(np.arange(len(self.idf), dtype=np.uint64) * np.uint64(HASHES) + np.uint64(k + 1))
            time = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)[term] / np.maximum(weight, 1e-9)
            least = np.flatnonzero(time == np.repeat(np.minimum.reduceat(time, starts), np.diff(np.append(starts, len(doc)))))
            at = least[np.flatnonzero(np.diff(doc[least], prepend=-1))]
            out[doc[at]] |= (mix64(term[at].astype(np.uint64)) >> np.uint64(48)) << np.uint64(16 * (HASHES - 1 - k))
        return out.view(np.int64)


class Index:
    """BM25 inverted index of a shard: postings sorted by term."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus) -> None:
        n = len(docs)
        doc, term, weight = corpus.terms(docs)
        df = np.bincount(term, minlength=len(corpus.idf))
        # By document: the terms that a query would use.  By term: the postings.
        self.doc_ends = np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))
        self.doc_terms, self.doc_weights = term, np.where(df[term] > 1, weight, -1.0)
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.ends = np.concatenate(([0], np.cumsum(df)))
        self.n = n

    def neighbours(self, seed: int, used: np.ndarray) -> Iterator[int]:
        """Unused documents that share a term with ``seed``, best first (ties: the first in the shard)."""
        a, b = self.doc_ends[seed], self.doc_ends[seed + 1]
        weights = self.doc_weights[a:b]
        pick = np.argsort(-weights, kind="stable")[:QUERY_TERMS]
        spans = [slice(self.ends[t], self.ends[t + 1]) for t, w in zip(self.doc_terms[a:b][pick], weights[pick], strict=True) if w > 0]
        if not spans:
            return
        scores = np.bincount(np.concatenate([self.docs[s] for s in spans]), weights=np.concatenate([self.weights[s] for s in spans]), minlength=self.n)
        scores[used] = 0
        found = np.flatnonzero(scores)
        value = scores[found]
        if len(found) > RANKED:
            best = value >= np.partition(value, len(value) - RANKED)[len(value) - RANKED]
            first = found[best]
            yield from first[np.argsort(-value[best], kind="stable")].tolist()
            found, value = found[~best], value[~best]
        yield from found[np.argsort(-value, kind="stable")].tolist()


def order(docs: list[np.ndarray], sizes: np.ndarray, corpus: Corpus) -> tuple[list[int], int]:
    """The documents of a shard as they follow one another, and how many of them the index put there; ``sizes`` with the end token."""
    index, used = Index(docs, corpus), np.zeros(len(docs), bool)
    out: list[int] = []
    filled = ahead = retrieved = 0
    while len(out) < len(docs):
        while used[ahead]:
            ahead += 1
        # The document that reaches into this window is its seed, else the next in the shard.
        if filled % WINDOW == 0:
            out.append(ahead)
            used[ahead] = True
            filled += int(sizes[ahead])
        end = -(-filled // WINDOW) * WINDOW
        if filled == end:
            continue
        for d in index.neighbours(out[-1], used):
            out.append(d)
            used[d] = True
            retrieved += 1
            filled += int(sizes[d])
            if filled >= end:
                break
        else:  # nothing related is left
            while ahead < len(docs) and used[ahead]:
                ahead += 1
            if ahead < len(docs):
                out.append(ahead)
                used[ahead] = True
                filled += int(sizes[ahead])
    return out, retrieved


def sequence_ends(total: int) -> np.ndarray:
    """Ends of the sequences of a stream of ``total`` tokens: full windows, then powers of two."""
    ends = list(range(WINDOW, total + 1, WINDOW))
    at = total - total % WINDOW
    for k in range(WINDOW.bit_length() - 1, -1, -1):
        if (total - at) >> k & 1:
            at += 1 << k
            ends.append(at)
    return np.array(ends, np.int64)


def pack(ids: list[int | None], docs: list[np.ndarray], first_sequence: int, corpus: Corpus) -> tuple[list[list], int]:
    """(columns of SCHEMA, number of sequences) of one shard."""
    whole = [np.concatenate((d, [END_ID])).astype("<u4") for d in docs]
    sizes = np.array([len(w) for w in whole], np.int64)
    cols: list[list] = [[] for _ in range(7)]
    ends = sequence_ends(int(sizes.sum()))
    at = k = 0
    for d in order(docs, sizes, corpus)[0]:
        start, n = 0, int(sizes[d])
        while start < n:
            begin = int(ends[k - 1]) if k else 0
            size = min(n - start, int(ends[k]) - at)
            row = (ids[d], start, size, zlib.crc32(whole[d][start : start + size].tobytes()), n, first_sequence + k, at - begin)
            for c, x in zip(cols, row, strict=True):
                c.append(x)
            start, at = start + size, at + size
            k += at == ends[k]
    return cols, len(ends)


def id_type(vocabulary: int) -> str:
    """Ids are stored in two bytes where the vocabulary allows it."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def _ids_of(column: pa.Array, kind: str) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def coded(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of whole texts as bytes of ``id_type``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens(tokenizer_path)
        kind = id_type(coder.tokenizer.get_vocab_size())
        for batch in batches:
            for a, b in blocks(batch.column(1), 2 << 20):
                part = batch.slice(a, b - a)
                found = coder.encode([t or "" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.astype(kind).tobytes() for x in found], pa.binary())], names=["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(tidy(run, "packing"), "doc_id long, ids binary")


def corpus_of(rows: DataFrame, vocabulary: int) -> tuple[Corpus, int]:
    """The corpus-wide figures of (ids) rows, and the number of tokens with the end tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(vocabulary + 2, np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                docs = _ids_of(batch.column(0).slice(a, 1000), id_type(vocabulary))
                df[:vocabulary] += np.bincount(distinct_terms(docs, vocabulary)[1], minlength=vocabulary)
                df[vocabulary:] += (len(docs), sum(map(len, docs)))
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(df[at])], names=["term", "n"])

    found = rows.select("ids").mapInArrow(tidy(run), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(vocabulary + 2, np.int64)
    df[found["term"].to_numpy()] = found["n"].to_numpy()
    n, total = int(df[vocabulary]), int(df[vocabulary + 1])
    return Corpus.of(df[:vocabulary], n, total), total + n


def sort_keys(sig: np.ndarray, same: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One string of bytes a document, in the order of its numbers."""
    numbers = np.stack((sig, same, at), axis=1).view(np.uint64) ^ np.uint64(1 << 63)
    return numbers.astype(">u8").view("S24").ravel()


def range_ends(keys: np.ndarray, sizes: np.ndarray, n: int) -> np.ndarray:
    """The last keys of the first n - 1 of ``n`` ranges of about equal sums of ``sizes``."""
    order = np.argsort(keys, kind="stable")
    upto = np.cumsum(sizes[order])
    places = np.searchsorted(upto, upto[-1] * np.arange(1, n) / n) if len(order) else np.empty(0, np.int64)
    return keys[order[places]]


def sharded(rows: DataFrame, corpus: Corpus, total: int) -> DataFrame:
    """(doc_id, ids), dealt by range of their signatures and sorted.

    The ranges' ends come from the sort keys of some documents, chosen by a hash of their
    place, so that the signatures of all are made once; they decide how even the ranges
    are, and every document goes to one.
    """
    context = rows.sparkSession.sparkContext
    shared, kind = context.broadcast(corpus), id_type(len(corpus.idf))
    numbered = rows.select("doc_id", "ids", F.monotonically_increasing_id().alias("at"))
    n = max(1, min(MOST_PARTITIONS, -(-total // BLOCK_TOKENS)))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray], np.ndarray, np.ndarray]]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                docs = _ids_of(part.column(1), kind)
                yield part, docs, shared.value.signatures(docs), np.array([zlib.crc32(d) for d in docs], np.int64)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, docs, sig, same in keyed(batches):
            size = pa.array([len(d) + 1 for d in docs], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(same), part.column(2), size], names=["sig", "same", "at", "size"])

    step = max(1, corpus.docs // (KEYS_A_RANGE * n))
    some = numbered.filter(F.pmod(F.xxhash64("at"), F.lit(step)) == 0).mapInArrow(tidy(measure), "sig long, same long, at long, size long").toArrow() if n > 1 else None
    ends = range_ends(sort_keys(*[some[k].to_numpy() for k in ("sig", "same", "at")]), some["size"].to_numpy(), n) if some else np.empty(0, "S24")
    cuts = context.broadcast(ends)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, _, sig, same in keyed(batches):
            to = np.searchsorted(cuts.value, sort_keys(sig, same, part.column(2).to_numpy())).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sig), pa.array(same), pa.array(to)], names=["doc_id", "ids", "at", "sig", "same", "to"])

    routed = numbered.mapInArrow(tidy(route), "doc_id long, ids binary, at long, sig long, same long, to int")
    return routed.repartitionById(n, F.col("to")).sortWithinPartitions("sig", "same", "at").select("doc_id", "ids")


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of all documents; sequence ids are unique over all tasks."""
    rows = saved(coded(docs, tokenizer_path, id_col, text_col))
    corpus, total = corpus_of(rows, tokens(tokenizer_path).tokenizer.get_vocab_size())
    shared = docs.sparkSession.sparkContext.broadcast(corpus)
    most, kind = BLOCK_TOKENS, id_type(len(corpus.idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        sequence = (context.partitionId() if context else 0) << 40
        ids: list[int | None] = []
        block: list[np.ndarray] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal ids, block, held, sequence
            if block:
                cols, n = pack(ids, block, sequence, shared.value)
                sequence += n
                ids, block, held = [], [], 0
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], schema=_ARROW)

        for batch in batches:
            for doc_id, found in zip(batch.column(0).to_pylist(), _ids_of(batch.column(1), kind), strict=True):
                if block and held + len(found) > most:
                    yield from flush()
                ids.append(doc_id)
                block.append(found)
                held += len(found) + 1
        yield from flush()

    return sharded(rows, corpus, total).mapInArrow(tidy(run), SCHEMA)
