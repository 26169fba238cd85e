"""Removal of passages that recur anywhere in the corpus, by repeated-phrase automata.

1. Confirm. Every window of `window` words belongs to the anchor in it: the phrase of ANCHOR words with the smallest
   hash. The same window has the same anchor wherever it stands, so the windows of one anchor meet in one partition, as
   5-byte tags beside the anchor's 8 bytes. A window that starts at two places or more learns of one place other than its
   own. What recurs within a batch learns it there; only one copy of it travels, so a phrase of a third of all documents
   is dealt as a few rows a task. Windows of hot anchors, found by counting, travel each by its own hash.
2. Compile. Windows that follow each other and have learnt of places that do so are one passage. Its words are read at the
   other place and sent to the documents that are said to hold it; the passages sent to a shard of documents are compiled
   into an Aho-Corasick automaton over word numbers.
3. Stream. All documents of the shard pass through its automaton, which finds every occurrence of each passage. Only what
   it finds goes, word for word equal to the words of another place: hashes propose, they decide nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from isoterra.llm import shared, words

ANCHOR = 6
#: Bytes of a window's tag; with the anchor it makes 104 bits.
TAG = 5
#: Bytes of text that share an automaton.
SHARD = 4 << 20
#: Bytes of passages that are sent on together.
PASSAGES = 2 << 20
#: Runs of windows for each document, and at all, from which an anchor is hot. Fewer than (mean anchors) / HOT can be.
HOT, LEAST = 5e-4, 256
#: Rows that propose a passage: windows at, at + 1, ... of row are said to be those at cat, cat + 1, ... of crow.
RUN = "row long, at long, n long, crow long, cat long"


def _sliding_minimum(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the smallest of each w consecutive values, the first of equals."""
    n = len(h) - w + 1
    span = 1
    low = h.copy()
    at = np.arange(len(h))
    while span * 2 <= w:  # minima over doubling spans
        m = len(low) - span
        take = low[span : span + m] < low[:m]
        at = np.where(take, at[span : span + m], at[:m])
        low = np.where(take, low[span : span + m], low[:m])
        span *= 2
    rest = w - span
    if rest:
        take = low[rest : rest + n] < low[:n]
        return np.where(take, at[rest : rest + n], at[:n])
    return at[:n]


def _windows(c: words.Chunk, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, start (word of the chunk), hash and anchor hash of every window; anchors change where starts break."""
    whole = words.sequences(c.word, window)
    if not len(whole):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    phrase = words.sequences(c.word, ANCHOR)
    anchor = _sliding_minimum(phrase, window - ANCHOR + 1)[: len(whole)]
    doc = np.searchsorted(c.at, np.arange(len(whole)), side="right") - 1
    inside = np.arange(len(whole)) + window <= c.at[doc + 1]
    start = np.flatnonzero(inside)
    return doc[start], start, whole[start], anchor[start]


def _others(order: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Members of groups of equals, and for each another member: the group's first, for the first the second.

    order sorts the members by group; same says which of it equals the one before."""
    head = np.flatnonzero(~same)
    size = np.diff(np.concatenate([head, [len(order)]]))
    first = np.repeat(order[head], size)
    other = first.copy()
    many = head[size > 1]
    other[many] = order[many + 1]
    held = np.repeat(size > 1, size)
    return order[held], other[held]


def _runs(row: np.ndarray, at: np.ndarray, n: np.ndarray, crow: np.ndarray, cat: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs put together where they follow each other or overlap on both sides."""
    if not len(row):
        return row, at, n, crow, cat
    order = np.lexsort((at, cat - at, crow, row))
    row, at, n, crow, cat = (x[order] for x in (row, at, n, crow, cat))
    apart = np.concatenate([[True], (row[1:] != row[:-1]) | (crow[1:] != crow[:-1]) | ((cat - at)[1:] != (cat - at)[:-1])])
    base = np.cumsum(apart) * (int((at + n).max()) + 1)
    end = np.maximum.accumulate(at + n + base)
    cut = np.flatnonzero(apart | np.concatenate([[True], (at + base)[1:] > end[:-1]]))
    stop = np.concatenate([cut[1:], [len(row)]]) - 1
    return row[cut], at[cut], end[stop] - base[stop] - at[cut], crow[cut], cat[cut]


def _found(column: pa.Array, window: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Windows of a text column, in pieces of some documents: document, word, hash, anchor's word and phrase."""
    for c in words.chunks(column):
        doc, start, whole, anchor = _windows(c, window)
        if len(doc):
            base = c.at[doc]
            yield doc + c.first, start - base, whole, anchor - base, words.sequences(c.word, ANCHOR)[anchor], len(c.data)


def _anchor_batches(window: int):
    """Rows (phrase, times): anchors that are common in a batch, by runs of windows; and null with its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, times = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for doc, _, _, anchor, phrase, _ in _found(b.column("text"), window):
                new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])])
                kind, n = np.unique(phrase[new], return_counts=True)
                often = n >= max(2, HOT / 2 * b.num_rows)
                kinds.append(kind[often])
                times.append(n[often])
            kind, n = np.concatenate(kinds), np.concatenate(times)
            yield pa.record_batch([pa.array([None, *kind.view(np.int64).tolist()], pa.int64()), pa.array([b.num_rows, *n.tolist()], pa.int64())], ["phrase", "times"])

    return run


def _hot_anchors(docs: DataFrame, window: int) -> np.ndarray:
    """Sorted hot anchors; their number is bounded by the anchors of a document, not by the corpus."""
    counted = docs.mapInArrow(_anchor_batches(window), "phrase long, times long").groupBy("phrase").agg(F.sum("times").alias("times"))
    counted = shared.written(counted, "repeats-anchors")
    n = counted.where("phrase is null").select("times").first()
    rows = counted.where(F.col("phrase").isNotNull() & (F.col("times") >= max(LEAST, HOT / 2 * (n[0] if n else 0)))).select("phrase").collect()
    return np.sort(np.array([r["phrase"] for r in rows], np.int64).view(np.uint64))


def _column(pieces: list[list], k: int) -> np.ndarray:
    """Column k of all pieces as one array; the pieces lose it."""
    out = np.concatenate([x[k] for x in pieces])
    for x in pieces:
        x[k] = None
    return out


def _confirm_batches(window: int, hot: np.ndarray):
    """Rows (route, row, at, n, tags, crow, cat): runs of n windows, with tags if they are to meet others at the route,
    or with the place where the same windows stand in the batch."""

    def one(ids: np.ndarray, found: list) -> Iterator[pa.RecordBatch]:
        # a column at a time, and what has been read goes: windows are many times their text
        doc, start, whole, anchor, phrase = (_column(found, k) for k in range(5))
        order = np.argsort(whole, kind="stable").astype(np.int32)
        same = np.concatenate([[False], whole[order][1:] == whole[order][:-1]])
        travels = np.zeros(len(doc), bool)
        travels[order[~same]] = True
        yield known(ids, doc, start, order, same)
        del order, same
        yield routed(ids, doc, start, whole, anchor, phrase, travels)

    def known(ids: np.ndarray, doc: np.ndarray, start: np.ndarray, order: np.ndarray, same: np.ndarray) -> pa.RecordBatch:
        member, other = _others(order, same)
        row, at, n, crow, cat = _runs(doc[member], start[member], np.ones(len(member), np.int32), doc[other], start[other])
        row, at, n, crow, cat = ids[row], at.astype(np.int64), n.astype(np.int64), ids[crow], cat.astype(np.int64)
        none = pa.nulls(len(row), pa.binary())
        with np.errstate(over="ignore"):
            apart = words.mix(row.view(np.uint64) + at.astype(np.uint64)).view(np.int64)
        return pa.record_batch([pa.array(apart), pa.array(row), pa.array(at), pa.array(n), none, pa.array(crow), pa.array(cat)], _SENT)

    def routed(ids: np.ndarray, doc: np.ndarray, start: np.ndarray, whole: np.ndarray, anchor: np.ndarray, phrase: np.ndarray, travels: np.ndarray) -> pa.RecordBatch:
        common = np.zeros(len(doc), bool)
        if len(hot):
            place = np.searchsorted(hot, phrase)
            place[place == len(hot)] = 0
            common = hot[place] == phrase
        cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)]) | common)
        size = np.diff(np.concatenate([cut, [len(doc)]]))
        ship = np.logical_or.reduceat(travels, cut)
        sent = whole[np.repeat(ship, size)]
        cut, size = cut[ship], size[ship]
        with np.errstate(over="ignore"):
            route = np.where(common[cut], words.mix(phrase[cut] + whole[cut]), phrase[cut])
            tag = words.mix(sent ^ np.uint64(0x7A67)).view(np.uint8).reshape(-1, 8)[:, :TAG]
        flat = np.ascontiguousarray(tag)
        offsets = np.concatenate([[0], np.cumsum(size * TAG)]).astype(np.int32)
        tags = pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
        none = pa.nulls(len(cut), pa.int64())
        return pa.record_batch([pa.array(route.view(np.int64)), pa.array(ids[doc[cut]]), pa.array(start[cut].astype(np.int64)), pa.array(size), tags, none, none], _SENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held: list = []
            ids, size = b.column("row").to_numpy(), 0
            for *x, n in _found(b.column("text"), window):
                held.append([y.astype(np.int32) if y.dtype == np.int64 else y for y in x])
                size += n
                if size > 3 * SHARD:
                    yield from one(ids, held)
                    held, size = [], 0
            if held:
                yield from one(ids, held)

    return run


_SENT = ["route", "row", "at", "n", "tags", "crow", "cat"]


def _meet_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs: those that know their other place, and those of windows that meet the same window here."""
    held = []
    for b in batches:
        known = b.column("tags").is_null()
        done = b.filter(known)
        if done.num_rows:
            yield done.select(["row", "at", "n", "crow", "cat"])
        rest = b.filter(pc.invert(known))
        if rest.num_rows:
            held.append(rest)
    if not held:
        return
    n, route, row, at = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("n", "route", "row", "at"))
    wide = np.zeros((int(n.sum()), 8), np.uint8)
    done = 0
    while held:
        flat = _binary(held.pop(0).column("tags")).reshape(-1, TAG)
        wide[done : done + len(flat), :TAG] = flat
        done += len(flat)
    tag, route = wide.view(np.uint64).ravel(), route.view(np.uint64)
    with np.errstate(over="ignore"):
        key = np.repeat(words.mix(route), n)
        key += tag
        key = words.mix(key)
    order = np.argsort(key, kind="stable")
    key = key[order]
    again = key[1:] == key[:-1]
    order = order[np.concatenate([[False], again]) | np.concatenate([again, [False]])]
    del key, again
    # of those that may be alike, by all bits; the smallest row and place first. Only they get their row and place.
    begin = np.cumsum(n) - n
    piece = np.searchsorted(begin, order, side="right") - 1
    tag, route, row, at = tag[order], route[piece], row[piece], at[piece] + order - begin[piece]
    del wide, piece
    order = np.lexsort((at, row, tag, route))
    same = np.concatenate([[False], (tag[order][1:] == tag[order][:-1]) & (route[order][1:] == route[order][:-1])])[: len(order)]
    if not len(order):
        return
    member, other = _others(order, same)
    out = _runs(row[member], at[member], np.ones(len(member), np.int64), row[other], at[other])
    for a in range(0, len(out[0]), 100_000):
        yield pa.record_batch([pa.array(x[a : a + 100_000]) for x in out], ["row", "at", "n", "crow", "cat"])


def _join_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = _runs(*(b.column(c).to_numpy() for c in ("row", "at", "n", "crow", "cat")))
        yield pa.record_batch([pa.array(x) for x in out], ["row", "at", "n", "crow", "cat"])


def _binary(x: pa.Array) -> np.ndarray:
    x = x.cast(pa.large_binary())
    _, where, data = x.buffers()
    o = np.frombuffer(where, np.int64)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(data, np.uint8)[o[0] : o[-1]]


def _words(column: pa.Array) -> list[list[bytes]]:
    return [x.split() if x else [] for x in column.cast(pa.large_binary()).to_pylist()]


def _passage_batches(window: int):
    """Rows (crow, cat, n, passage): the words of n windows from place cat on."""

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        for b in batches:
            # one text may be read for many documents: what is read goes on in pieces
            texts = b.column("text").cast(pa.large_binary())
            for i in range(b.num_rows):
                ws = (texts[i].as_py() or b"").split()
                row, places = b.column("row")[i].as_py(), b.column("places")[i].values
                for cat, n in zip(places.field("cat").to_numpy().tolist(), places.field("n").to_numpy().tolist(), strict=True):
                    out.append((row, cat, n, b" ".join(ws[cat : cat + n + window - 1])))
                    held += len(out[-1][3])
                    if held > PASSAGES:
                        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["crow", "cat", "n", "passage"])
                        out, held = [], 0
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["crow", "cat", "n", "passage"])

    return run


def _remove_batches(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = pc.binary_length(b.column("text").cast(pa.large_string())).fill_null(0).to_numpy()
            shard = np.cumsum(lengths) // SHARD
            for a in np.unique(shard, return_index=True)[1].tolist():
                z = int(np.searchsorted(shard, shard[a], side="right"))
                yield from removed(b.slice(a, z - a))

    def compiled(passages: list) -> tuple[ahocorasick.Automaton, dict[bytes, int], list]:
        """The automaton, the words' numbers, and for each key its size and the places that it was read at."""
        number: dict[bytes, int] = defaultdict(int)  # other words are 0
        known: dict[tuple, int] = {}
        keys: list[tuple[int, list]] = []
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for p in {(p["passage"], p["crow"], p["cat"], p["sure"]) for ps in passages for p in ps or ()}:
            code = [number[w] or number.__setitem__(w, len(number)) or number[w] for w in p[0].split()]
            for x in range(0, len(code) - window + 1, 4 * window):  # pieces that share a window's length
                piece = tuple(code[x : x + 5 * window])
                if piece not in known:
                    known[piece] = len(keys)
                    keys.append((len(piece), []))
                    automaton.add_word(piece, known[piece])
                places, place = keys[known[piece]][1], (p[1], p[2] + x, p[3])
                if place not in places and (p[3] or len(places) < 3):  # of three places two at least are other ones
                    places.append(place)
        automaton.make_automaton()
        return automaton, number, keys

    def removed(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = _words(b.column("text"))
        automaton, number, keys = compiled(b.column("passages").to_pylist())
        n_words, n_removed, kept = [], [], []
        for row, ws in zip(b.column("row").to_pylist(), texts, strict=True):
            gone: list[tuple[int, int]] = []
            if len(automaton) and len(ws) >= window:
                for end, key in automaton.iter(tuple(map(number.__getitem__, ws))):
                    size, places = keys[key]
                    at = end + 1 - size
                    if any(crow != row or cat != at or sure for crow, cat, sure in places):
                        gone.append((at, end + 1))
            n_words.append(len(ws))
            if gone:
                edges = np.zeros(len(ws) + 1, np.int32)
                np.add.at(edges, [a for a, _ in gone], 1)
                np.add.at(edges, [z for _, z in gone], -1)
                stay = (np.cumsum(edges[:-1]) == 0).tolist()
                n_removed.append(len(ws) - sum(stay))
                ws = [w for w, s in zip(ws, stay, strict=True) if s]
            else:
                n_removed.append(0)
            kept.append(b" ".join(ws).decode())
        yield pa.record_batch(
            [b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )

    return run


def remove_repeats(docs: DataFrame, window: int = 35) -> DataFrame:
    """Take from every text the words covered by a window of `window` words that also starts anywhere else.

    Returns doc_id, n_words, n_removed, kept (the words that stay, joined by one space), a row for every input row.
    Windows are judged on the input, not on what is left; two occurrences in one document count, overlapping ones too.
    A null text has no words. Rows with the same doc_id are different documents, also those with the same text, which lose
    all that is a window long. A null doc_id is an id like any other. Other columns are ignored, whatever their names.
    """
    if not 2 * ANCHOR <= window <= 63:
        raise ValueError("window must have between 12 and 63 words")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a row of its own for each input row, so that repeated ids stay apart
    keyed = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    sent = keyed.select("row", "text").mapInArrow(
        _confirm_batches(window, _hot_anchors(docs.select("text"), window)), "route long, row long, at long, n long, tags binary, crow long, cat long"
    )
    met = sent.repartition("route").mapInArrow(_meet_batches, RUN)
    runs = shared.written(met.repartition("row").sortWithinPartitions("row", "crow", "at").mapInArrow(_join_batches, RUN), "repeats-runs")
    places = runs.select("crow", "cat", "n").distinct().groupBy(F.col("crow").alias("row")).agg(F.collect_list(F.struct("cat", "n")).alias("places"))
    # both joins with the texts read the one exchange of them
    passages = keyed.join(places.hint("shuffle_hash"), "row").select("doc_id", "row", "text", "places").mapInArrow(
        _passage_batches(window), "crow long, cat long, n long, passage binary"
    )
    told = runs.join(passages, ["crow", "cat", "n"]).groupBy("row").agg(
        F.collect_set(F.struct("passage", "crow", "cat", ((F.col("row") == F.col("crow")) & (F.col("at") == F.col("cat"))).alias("sure"))).alias("passages")
    )
    return (
        keyed.join(told.hint("shuffle_hash"), "row", "left").select("doc_id", "row", "text", "passages")
        .mapInArrow(_remove_batches(window), "doc_id long, n_words long, n_removed long, kept string")
    )
