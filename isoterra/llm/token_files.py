"""Token ids of every document in flat unsigned integer files with 64-bit document offsets.

Documents are range-partitioned by doc_id and sorted, so that the parts follow each other in ascending order. Each
part is three flat files, all little-endian: NAME.ids (token ids, two bytes each if the vocabulary allows, else four),
NAME.off (for each document the id at which it begins, and the end) and NAME.doc (its doc_id). A part's place in the
whole is the sum of the parts before it. The manifest, a table, names the files of the task attempt that succeeded, so
what a lost attempt has left is never read.

Texts are cut at white space, which the tokenizer drops: each different word of a batch is encoded once.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from isoterra.llm import shared, words

#: Words whose ids a worker keeps.
KEPT_WORDS = 600_000
#: Documents read back at a time, and ids of a stretch of them.
PIECE, LONG = 4096, 1 << 20
NO_ID = -(1 << 63)
MANIFEST = "part int, files string, docs long, tokens long, width int"

_encoders: dict[str, Encoder] = {}
#: Letters whose lower case, composed form and letter class are the same everywhere.
_SIMPLE = re.compile(r"([a-zß-öø-ÿ]+)([.,;:!?]*)")


class Encoder:
    """Ids of words by the tokenizers library, with a bounded cache."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.model = self.tokenizer.model
        self.byte_letters = self._plain_letters()
        self.clear()

    def _plain_letters(self) -> bool:
        """True if a simple word's ids are those that the model gives for its bytes' letters; tried on samples."""
        self.letter = {}
        try:
            for n in [*range(ord("a"), ord("z") + 1), *range(0xDF, 0xF7), *range(0xF8, 0x100)]:
                text = chr(n)
                normal = self.tokenizer.normalizer.normalize_str(text)
                pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)
                self.letter[n] = "".join(p for p, _ in pieces)
            sample = ["hello", "ninguém", "straße", "aàbcéz", "the"]
            return all(self._model_ids(w) == self._ids(w) for w in sample) and self._ids("The") == self._ids("the")
        except Exception:  # noqa: BLE001 - a tokenizer of another make is used as a whole
            return False

    def _model_ids(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word.translate(self.letter))]

    def _ids(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.pool = np.zeros(1 << 20, np.uint32)
        self.used = 0
        self.ends: dict[str, list[int]] = {}

    def ids_of(self, word: str) -> list[int]:
        if self.byte_letters and (m := _SIMPLE.fullmatch(low := word.lower())):
            letters, end = m.groups()
            if not end:
                return self._model_ids(letters)
            if end not in self.ends:
                self.ends[end] = self._ids(end)
            return self._model_ids(letters) + self.ends[end]
        return self._ids(word)

    def chunk(self, c: words.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in order, number of ids of every word)."""
        if not len(c.word):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        kind, first, back = np.unique(c.word, return_index=True, return_inverse=True)
        if len(self.place) > KEPT_WORDS:
            self.clear()
        at = np.zeros(len(kind), np.int64)
        raw = c.data.tobytes()
        for i, (h, a, z) in enumerate(zip(kind.tolist(), c.start[first].tolist(), c.stop[first].tolist(), strict=True)):
            p = self.place.get(h)
            if p is None:
                ids = self.ids_of(raw[a:z].decode())
                if self.used + len(ids) > len(self.pool):
                    self.pool = np.concatenate([self.pool, np.zeros(max(len(self.pool), len(ids)), np.uint32)])
                self.pool[self.used : self.used + len(ids)] = ids
                p = self.place[h] = self.used << 24 | len(ids)
                self.used += len(ids)
            at[i] = p
        size = (at & 0xFFFFFF)[back]
        start = (at >> 24)[back]
        ends = np.cumsum(size)
        return self.pool[np.repeat(start - ends + size, size) + np.arange(int(ends[-1]))], size


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _write_batches(where: str, tokenizer: str, end_id: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, name = task.partitionId(), f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        files, root = fs.FileSystem.from_uri(where)
        files.create_dir(root, recursive=True)
        enc, sizes, ids = encoder(tokenizer), [], []
        kind = np.dtype("<u2" if enc.width == 2 else "<u4")
        with files.open_output_stream(f"{root}/{name}.ids") as out:
            for b in batches:
                ids.append(b.column("doc_id").fill_null(NO_ID).to_numpy(zero_copy_only=False).astype("<i8"))
                for c in words.chunks(b.column("text"), lower=enc.byte_letters):
                    flat, each = enc.chunk(c)
                    ends = np.concatenate([[0], np.cumsum(each)])[c.at]
                    out.write(np.insert(flat, ends[1:], end_id).astype(kind).tobytes())
                    sizes.append(np.diff(ends) + 1)
        docs = np.concatenate([*ids, np.zeros(0, "<i8")]).astype("<i8")
        offsets = np.concatenate([[0], np.cumsum(np.concatenate([*sizes, np.zeros(0, np.int64)]))]).astype("<i8")
        for kind_of, values in (("off", offsets), ("doc", docs)):
            with files.open_output_stream(f"{root}/{name}.{kind_of}") as out:
                out.write(values.tobytes())
        row = [[part], [f"{where}/{name}"], [len(docs)], [int(offsets[-1])], [enc.width]]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
        yield pa.record_batch([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["part", "files", "docs", "tokens", "width"])

    return run


def mapped(uri: str, kind: str, first: int, last: int) -> np.ndarray:
    """Numbers first to last of a flat file: memory-mapped where it is a local file, else those bytes alone are read."""
    files, path = fs.FileSystem.from_uri(uri)
    size = np.dtype(kind).itemsize
    if last <= first:
        return np.zeros(0, kind)
    if isinstance(files, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r", offset=first * size, shape=(last - first,))
    with files.open_input_file(path) as f:
        return np.frombuffer(f.read_at((last - first) * size, first * size), kind)


def write_tokens(docs: DataFrame, tokenizer: str, end_id: int, where: str) -> DataFrame:
    """Write the ids of documents (doc_id, text) to files under the shared folder `where`, in ascending doc_id order.

    Returns the manifest: part, files (name without ending), docs, tokens, width (bytes of an id), base (ids of all
    parts before). Each document's ids end with end_id; a null or empty text is that id alone. Rows without doc_id come
    first; rows that repeat a doc_id follow each other in the order of their texts. Other columns are ignored. An empty
    table gives an empty manifest or empty parts. A tokenizer must drop ASCII white space, and never look across it.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = docs.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    parts = shared.written(ordered.mapInArrow(_write_batches(where, tokenizer, end_id), MANIFEST), "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return parts.withColumn("base", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for name, docs, width, base in zip(*(b.column(c).to_pylist() for c in ("files", "docs", "width", "base")), strict=True):
            for a in range(0, docs, PIECE):
                z = min(docs, a + PIECE)
                off, own = mapped(f"{name}.off", "<i8", a, z + 1), mapped(f"{name}.doc", "<i8", a, z)
                crc = [
                    zlib.crc32(mapped(f"{name}.ids", f"<u{width}", i, j).astype("<u4").tobytes()) if j - i > LONG else None
                    for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)
                ]
                # short documents follow each other in stretches that are read at once
                at = 0
                while at < len(crc):
                    end = at
                    while end < len(crc) and crc[end] is None and off[end + 1] - off[at] <= LONG:
                        end += 1
                    if end == at:
                        at += 1
                        continue
                    ids = mapped(f"{name}.ids", f"<u{width}", int(off[at]), int(off[end])).astype("<u4")
                    crc[at:end] = [zlib.crc32(ids[i:j].tobytes()) for i, j in zip((off[at:end] - off[at]).tolist(), (off[at + 1 : end + 1] - off[at]).tolist(), strict=True)]
                    at = end
                yield pa.record_batch(
                    [pa.array(np.asarray(own), mask=np.asarray(own == NO_ID)), pa.array(off[:-1] + base), pa.array(np.diff(off)), pa.array(crc, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read_tokens(manifest: DataFrame) -> DataFrame:
    """Of every document in the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    As many partitions as the files have parts, which no re-planning puts together: each reads some files of its own."""
    each = manifest.repartition(max(1, manifest.count()), "part")
    return each.mapInArrow(_read_batches, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_folder(spark: SparkSession) -> str:
    return shared.fresh_path(spark, "tokens")
