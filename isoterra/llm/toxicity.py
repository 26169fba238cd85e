"""Toxicity by compression distance: two zstandard dictionaries, trained on toxic and on ordinary text.

A window is a few words of running text. Its distance is its compressed length with the ordinary dictionary less that with
the toxic one, which also holds the ordinary dictionary's content, so that what is ordinary costs the same in both. Most
of a toxic text is ordinary; what the toxic dictionary is trained on are the windows that speak for toxicity. They are
found by dictionaries too: the toxic texts are halved, a dictionary is trained on each half (first on the windows that the
ordinary dictionary compresses worst), and of each half the windows that the other half's dictionary compresses better
than the ordinary one train the next. The last is trained on those of both halves.

A document is judged by how many of its windows pass each of several thresholds, and how far the best goes; the weights of
the thresholds are calibrated on learning rows that the dictionaries were not made of.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from isoterra.llm import shared, training, words

LEVEL = 7
#: Words of a window, words from one to the next, bytes above which a window is several that overlap by an eighth.
WINDOW, HOP, LONG = 3, 2, 256
#: Bytes of the dictionaries' content, of the segments that the toxic one is built of, and of ordinary text after a window,
#: for the compressor finds no matches at the very end.
ORDINARY, TOXIC, SEGMENT, TAIL = 110_000, 8000, 24, 32
#: Rounds of choosing windows by the other half's dictionary, the distance from which one is chosen, and the share of the
#: windows, worst under the ordinary dictionary, that start them.
ROUNDS, CHOSEN, START = 2, 3, 0.2
THRESHOLDS = (1, 2, 3, 4, 5, 6, 7, 8, 10)
#: Windows and pieces of PIECE bytes that a sampled text gives to the dictionaries' training, spread over all of it.
MOST, PIECE, PIECES = 5000, 400, 1000


class Windows:
    """Windows of the documents of a chunk, as bytes that follow each other."""

    def __init__(self, c: words.Chunk):
        n = np.diff(c.at)
        each = np.where(n > 0, np.maximum(0, -(-(n - WINDOW) // HOP)) + 1, 0)
        doc = np.repeat(np.arange(len(n)), each)
        first = c.at[doc] + HOP * (np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each))
        last = np.minimum(first + WINDOW, c.at[doc + 1]) - 1
        start, stop = (c.start[first], c.stop[last]) if len(doc) else (first, first)
        cuts = np.maximum(1, -(-(stop - start - LONG // 8) // (LONG - LONG // 8)))
        place = np.arange(int(cuts.sum())) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        start = np.repeat(start, cuts) + place * (LONG - LONG // 8)
        self.doc, self.start, self.stop = np.repeat(doc, cuts), start, np.minimum(start + LONG, np.repeat(stop, cuts))
        self.data = np.where(words.is_space(c.data), np.uint8(32), c.data)

    def buffer(self, tail: bytes, some: np.ndarray | slice = slice(None)) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The windows between spaces and before the tail, with the place and size of each."""
        start, size = self.start[some], (self.stop - self.start)[some]
        whole = size + 2 + len(tail)
        at = np.cumsum(whole) - whole
        out = np.full(int(whole.sum()), 32, np.uint8)
        inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        out[inner + np.repeat(at + 1, size)] = self.data[inner + np.repeat(start, size)]
        out[(at + size + 2)[:, None] + np.arange(len(tail))] = np.frombuffer(tail, np.uint8)
        return out.tobytes(), at, whole

    def texts(self, some: np.ndarray) -> list[bytes]:
        flat, at, whole = self.buffer(b"", some)
        return [flat[a : a + n] for a, n in zip(at.tolist(), whole.tolist(), strict=True)]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_content_size=False, write_dict_id=False)


def _lengths(c: zstandard.ZstdCompressor, buffer: tuple[bytes, np.ndarray, np.ndarray]) -> np.ndarray:
    flat, at, size = buffer
    if not len(at):
        return np.zeros(0, np.int64)
    parts = zstandard.BufferWithSegments(flat, np.column_stack([at, size]).astype("<u8").tobytes())
    out = c.multi_compress_to_buffer(parts, threads=1)
    return np.fromiter((len(out[i]) for i in range(len(out))), np.int64, len(out))


def _trained(size: int, samples: list[bytes], k: int) -> bytes:
    """Content of a dictionary; of too little text to train on, the text itself."""
    if sum(map(len, samples)) > 4 * size:
        # training stops where it meets much that it has seen: each sample once, and neighbours apart
        samples = sorted(set(samples), key=zlib.crc32)
        try:
            return zstandard.train_dictionary(size, samples, k=k, d=6).as_bytes()[-size:]
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:].rjust(64, b" ")


class Distances:
    """The two dictionaries' contents."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        self.parts = toxic, ordinary
        self.tail = ordinary[-TAIL:]
        self._made: tuple | None = None

    def __getstate__(self):
        return self.parts

    def __setstate__(self, parts):
        self.__init__(*parts)

    def of(self, windows: Windows) -> np.ndarray:
        if self._made is None:
            self._made = _compressor(self.parts[1]), _compressor(self.parts[0] + self.parts[1])
        flat = windows.buffer(self.tail)
        return _lengths(self._made[0], flat) - _lengths(self._made[1], flat)


def _lowered(column: pa.Array) -> Iterator[words.Chunk]:
    return words.chunks(pc.utf8_lower(column.cast(pa.large_string())))


def _spread(n: int, most: int) -> np.ndarray:
    return np.arange(n) if n <= most else np.arange(most) * n // most


def _samples(texts: list[str]) -> list[bytes]:
    """Windows of the texts, at most MOST of each, spread over all of it."""
    out = []
    for c in _lowered(pa.array(texts, pa.string())):
        w = Windows(c)
        for a, z in zip(np.searchsorted(w.doc, np.arange(len(c.at) - 1)).tolist(), np.searchsorted(w.doc, np.arange(1, len(c.at))).tolist(), strict=True):
            out += w.texts(a + _spread(z - a, MOST))
    return out


def _lengths_of(samples: list[bytes], c: zstandard.ZstdCompressor, tail: bytes) -> np.ndarray:
    out = []
    for a in range(0, len(samples), 100_000):
        some = [s + tail for s in samples[a : a + 100_000]]
        size = np.array([len(s) for s in some], np.int64)
        out.append(_lengths(c, (b"".join(some), np.cumsum(size) - size, size)))
    return np.concatenate([*out, np.zeros(0, np.int64)])


def dictionaries(toxic: list[str], ordinary: list[str]) -> Distances:
    pieces = []
    for t in ordinary:
        raw = t.lower().encode()
        pieces += [raw[i * PIECE : (i + 1) * PIECE] for i in _spread(-(-len(raw) // PIECE), PIECES).tolist()]
    plain = _trained(ORDINARY, pieces, 64)
    found = Distances(b"", plain)
    usual, tail = _compressor(plain), found.tail
    halves = [_samples(toxic[h::2]) for h in (0, 1)]
    lengths = [_lengths_of(h, usual, tail) for h in halves]
    chosen = []
    for h, n in zip(halves, lengths, strict=True):
        cost = n / np.maximum(1, [len(x) for x in h]) if h else n
        least = np.quantile(cost, 1 - START) if h else 0
        chosen.append([x for x, c in zip(h, cost.tolist(), strict=True) if c >= least])
    for _ in range(ROUNDS):
        made = [_compressor(_trained(TOXIC, x, SEGMENT) + plain) for x in chosen]
        far = [n - _lengths_of(h, c, tail) for h, n, c in zip(halves, lengths, made[::-1], strict=True)]
        picked = [[x for x, d in zip(h, f.tolist(), strict=True) if d >= CHOSEN] for h, f in zip(halves, far, strict=True)]
        if not all(picked):
            break
        chosen = picked
    return Distances(_trained(TOXIC, chosen[0] + chosen[1], SEGMENT), plain)


def features(counts: np.ndarray, best: np.ndarray, n: np.ndarray) -> np.ndarray:
    """From windows past each threshold [document, threshold], the best distance and the number of windows."""
    rate = counts / np.maximum(n, 1)[:, None]
    return np.column_stack([np.log1p(counts), np.sqrt(rate), best / 8, np.log1p(n) / 4])


def measured(column: pa.Array, distance: Distances) -> Iterator[np.ndarray]:
    """Features [document, feature] of a text column, in pieces of some documents."""
    for c in _lowered(column):
        docs, w = len(c.at) - 1, Windows(c)
        far = distance.of(w)
        counts = np.column_stack([np.bincount(w.doc[far >= t], minlength=docs) for t in THRESHOLDS])
        best = np.zeros(docs, np.int64)
        np.maximum.at(best, w.doc, far)
        yield features(counts, best, np.bincount(w.doc, minlength=docs))


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row, the pickled model, of the sampled rows (doc_id, y, text)."""
    rows = sorted((r["doc_id"], r["text"] or "", r["y"]) for b in batches for r in b.to_pylist())
    # the dictionaries are made of two thirds of the sample, the thresholds' weights of the rest
    made, rest = [r for i, r in enumerate(rows) if i % 3], [r for i, r in enumerate(rows) if not i % 3]
    distance = dictionaries([t for _, t, y in made if y], [t for _, t, y in made if not y])
    y = np.array([r[2] for r in rest], float)
    x = np.concatenate([np.zeros((0, 2 * len(THRESHOLDS) + 2)), *measured(pa.array([r[1] for r in rest], pa.string()), distance)])
    mean, std = (x.mean(0), x.std(0) + 1e-9) if len(x) else (0.0, 1.0)
    w, b0 = training.logistic((x - mean) / std, y) if len(set(y.tolist())) == 2 else (np.zeros(x.shape[1]), 0.0 if not len(y) else 4.0 * (2 * y[0] - 1))
    yield pa.record_batch([pa.array([pickle.dumps((distance, w, b0, mean, std))], pa.binary())], ["model"])


def fit(docs: DataFrame, labels: DataFrame):
    """The model, made in one task of at most training.SAMPLE learning rows of each class; it is the driver's size of it."""
    rows = training.learning_rows(labels, "toxic")
    some = [rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit("toxic")), "doc_id").limit(training.SAMPLE) for y in (0, 1)]
    ids = shared.written(some[0].union(some[1]), "toxic-ids")
    sample = docs.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "y", "text")
    made = sample.coalesce(1).mapInArrow(_train_batches, "model binary").first()
    if made is None:  # nothing to learn from, so no task ran
        return pickle.loads(next(_train_batches(iter(()))).column("model")[0].as_py())
    return pickle.loads(made["model"])


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score documents (doc_id, text) with a model of labels (doc_id, toxic).

    Returns doc_id, held_out, score (0 to 1), predicted (score >= 0.5), a row for every input row. The model is fitted on
    at most training.SAMPLE learning rows of each class (of rows that repeat a doc_id, the one with the smallest text);
    whole texts are scored. A null or wordless text has no windows and the score that no windows have; without labels of
    both classes every score is the same. Rows without doc_id are scored and not held out. Other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    distance, w, b0, mean, std = fit(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.concatenate([np.zeros(0)] + [(x - mean) / std @ w + b0 for x in measured(b.column("text"), distance)])
            yield pa.record_batch([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    scored = docs.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", training.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
