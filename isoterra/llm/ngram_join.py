"""N-gram Jaccard self-join of documents by count-vector R-trees.

Every document is a set of hashed word shingles. Hashing the shingles into GROUPS groups makes its group counts
a point; the overlap of two sets is at most the sum of coordinate minima, for points as for the boxes of an R-tree.
The tree of a shard is joined with itself from the root, pairs of boxes whose bound is too low are dropped with all
below them, and the pairs of points that stay are verified on the shingles themselves.

Points of unrelated texts differ by little more than points of similar ones in any few coordinates, so no cut of the
space alone gives shards that lose nothing. Shards come from the groups' content instead: two linked sets differ by at
most k shingles, so of more than k groups one has the same content in both (exact, whatever the texts are). A document
goes to one shard only: the connected component of documents that share a group's content.

Passages that many documents share would put unrelated documents into one shard. So hot shingles, found by counting all
of them, are left out of the groups; what is left differs by no more than the sets do, so the argument holds wherever
one of two sets has content in more than k groups. Sets without so much (they are hot for the most part) also go by
the groups of all their shingles. The argument says more: of a set's groups with content all but k are its partner's too.
A set that shares fewer of its groups with any others, as by a passage, has no link by them and makes no shard.

Sets with the same shingles are one class, represented by its smallest doc_id, before anything else happens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from isoterra.llm import shared, words

GROUPS = 64
#: Sizes of a class of sets lie within this ratio.
RATIO = 1.6
#: Groups for each one that the pigeonhole needs, so that more than those have content in all but very few sets.
SPARE = 1.3
#: Documents, and shingles of them, of a shard that one task joins; larger shards are joined chunk by chunk.
CHUNK, ELEMENTS = 1500, 1_500_000
#: Groups of the second bound, for sets of so many shingles that GROUPS tell little; cells of a block of pairs.
FINE, CELLS = 2048, 4_000_000
#: Documents of a large shard that every chunk of it also holds.
PIVOTS = 4
#: Rows of keys that a task looks through for blocks of its own before it sends them on.
FLUSH = 1_000_000
LEAF = 16
#: Share of the documents above which a shingle is hot. Fewer than (mean set size) / HOT shingles can be.
HOT = 5e-4
#: Sets that share a group's content up to which each pair of them is put to the bound before it makes a shard.
SMALL = 8
#: Shingles that are counted together.
PART = 4_000_000


def _least_overlap(total: np.ndarray, num: int, den: int) -> np.ndarray:
    """Smallest intersection i of sets with so many elements together for which den * i >= num * (total - i)."""
    return -(-(num * total) // (num + den))


def _digest_batches(k: int, lower: bool):
    """Rows (doc_id, n, d1, d2); the first of each part also lists the shingles that are common in it, with counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, d1, d2, counts, held, first = [], [], [], [], [], 0
            for i, u in enumerate(words.shingle_sets(b.column("text"), k, lower)):
                n.append(len(u))
                with np.errstate(over="ignore"):
                    d1.append(_digest(u))
                    d2.append(int(np.add.reduce(words.mix(u ^ np.uint64(0xA5A5A5A5)))) if len(u) else 0)
                counts.append(_group_counts(u).tobytes())
                held.append(u)
                if sum(n) > PART or i == b.num_rows - 1:
                    kind, count = np.unique(np.concatenate(held), return_counts=True)
                    often = count >= max(3, HOT * len(n) / 2)
                    lists = [pa.array([x] + [None] * (len(n) - 1), pa.list_(pa.int64())) for x in (kind[often].view(np.int64), count[often])]
                    ids = b.column("doc_id").slice(first, len(n))
                    yield pa.record_batch([ids, pa.array(n, pa.int64()), _signed(d1), _signed(d2), pa.array(counts, pa.binary()), *lists], ["doc_id", "n", "d1", "d2", "counts", "hot", "times"])
                    first += len(n)
                    n, d1, d2, counts, held = [], [], [], [], []

    return run


def _group_counts(u: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    return np.bincount((u >> np.uint64(64 - groups.bit_length() + 1)).astype(np.int64), minlength=groups).astype(np.int32)


def _bound_batches(num: int, den: int):
    """Rows (x, y, shared_groups) that a large block has brought together, or whose counts allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.int32).reshape(-1, GROUPS) for k in ("cx", "cy"))
            total = b.column("nx").to_numpy() + b.column("ny").to_numpy()
            keep = np.minimum(a, c).sum(1) >= _least_overlap(total, num, den)
            keep |= b.column("large").to_numpy(zero_copy_only=False).astype(bool)
            yield b.select(["x", "y", "shared_groups"]).filter(pa.array(keep))

    return run


def _digest(u: np.ndarray) -> int:
    return int(words.mix(np.add.reduce(words.mix(u)).reshape(1) + np.uint64(len(u)))[0]) if len(u) else 0


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, dtype=np.uint64).view(np.int64))


def scheme(c: int, num: int, den: int) -> tuple[int, int, int]:
    """Of size class c: its largest size, the shingles by which linked sets may differ, the number of groups."""
    high = int(RATIO ** c)
    k = 2 * high - 2 * int(_least_overlap(np.int64(2 * high), num, den))
    k = max(k, (2 * high * (den - num)) // (den + num))
    return high, k, int(np.ceil(SPARE * (k + 1))) + 1


def group_keys(u: np.ndarray, c: int, k: int, m: int, salt: int, empty_too: bool) -> tuple[np.ndarray, int]:
    """Keys of the groups' contents, and how many groups have content."""
    with np.errstate(over="ignore"):
        group = ((u >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(u)), bool), group[1:] != group[:-1]]))
        held = group[first]
        content = np.add.reduceat(words.mix(u ^ np.uint64(0x5EED)), first) if len(u) else held
        if len(first) <= k and empty_too:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), held)
            held, content = np.concatenate([held, empty]), np.concatenate([content, np.zeros(len(empty), np.uint64)])
        return words.mix(content + words.mix(held + np.uint64((c << 32) + (salt << 48)))), len(first)


def _size_class(n: int) -> int:
    c = max(1, int(np.log(n) / np.log(RATIO)))
    while int(RATIO**c) < n:
        c += 1
    while c > 1 and int(RATIO ** (c - 1)) >= n:
        c -= 1
    return c


def _key_batches(num: int, den: int, k: int, lower: bool, hot):
    def keys_of(u: np.ndarray) -> list[tuple[np.ndarray, int, int]]:
        """Keys of a set's groups, kind after kind, with the kind and how many of them a set linked with it has too."""
        n, out = len(u), []
        c = _size_class(n)
        common = hot
        cold = u
        if len(common):
            at = np.searchsorted(common, u)
            at[at == len(common)] = 0
            cold = u[common[at] != u]
        for at in (c, c + 1):
            high, differ, m = scheme(at, num, den)
            low = int(RATIO ** (at - 1)) + 1
            if differ >= 1 and (at == c or den * n >= num * low):
                keys, filled = group_keys(cold, at, differ, m, 0, False)
                out.append((keys, 2 * at, max(1, filled - differ)))
                if filled <= differ:
                    keys, _ = group_keys(u, at, differ, m, 1, True)
                    out.append((keys, 2 * at + 1, max(1, len(keys) - differ)))
        return out

    def flush(found: list, of: list) -> pa.RecordBatch:
        key = np.concatenate([x[0] for x in found])
        each = [len(x[0]) for x in found]
        d, kind, least = (np.repeat(np.array(x, t), each) for x, t in ((of, np.uint64), ([x[1] for x in found], np.int32), ([x[2] for x in found], np.int32)))
        order = np.lexsort((d, key))
        k, e = key[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        size = np.diff(np.concatenate([first, [len(k)]]))
        # of a block that is large here already, all but one go straight to that one; a set's rows stay together
        centre, once = np.empty_like(d), np.empty(len(d), bool)
        centre[order] = np.repeat(e[first], size)
        once[order] = np.concatenate([[True], (k[1:] != k[:-1]) | (e[1:] != e[:-1])])
        large = np.empty(len(d), bool)
        large[order] = np.repeat(size > SMALL, size)
        near = large & (centre != d)
        key = np.where(near, words.mix(d + key), key)[once]
        return pa.record_batch([_signed(key), _signed(d[once]), pa.array(kind[once]), pa.array(least[once]), pa.array(centre[once].view(np.int64), mask=~near[once])], ["key", "d1", "kind", "least", "near"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        of: list[int] = []
        held = 0
        for b in batches:
            for u in words.shingle_sets(b.column("text"), k, lower):
                if len(u):
                    d = _digest(u)
                    for x in keys_of(u):
                        found.append(x)
                        of.append(d)
                        held += len(x[0])
                if held > FLUSH:
                    with np.errstate(over="ignore"):
                        yield flush(found, of)
                    found, of, held = [], [], 0
        if held:
            with np.errstate(over="ignore"):
                yield flush(found, of)

    return run


def _set_batches(k: int, lower: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = pa.array([x.tobytes() for x in words.shingle_sets(b.column("text"), k, lower)], pa.binary())
            yield pa.record_batch([b.column("doc_id"), b.column("shard"), b.column("slots"), sets], ["doc_id", "shard", "slots", "elements"])

    return run


class CountTree:
    """Packed R-tree over group counts; every level is a pair of arrays, the boxes' lower and upper corners."""

    def __init__(self, sets: list[np.ndarray]):
        self.counts = np.zeros((len(sets), GROUPS), np.int32)
        for i, u in enumerate(sets):
            self.counts[i] = _group_counts(u)
        self.size = self.counts.sum(1)
        # neighbours in the order of size and of coarse coordinates share a leaf
        half = self.counts[:, : GROUPS // 2].sum(1)
        self.order = np.lexsort((half, self.size))
        top, least = self.counts[self.order], self.size[self.order]
        self.levels = [(top, least)]
        while len(top) > 1:
            cut = np.arange(0, len(top), LEAF)
            top, least = np.maximum.reduceat(top, cut), np.minimum.reduceat(least, cut)
            self.levels.append((top, least))

    def pairs(self, other: CountTree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places (i, j) of points whose bound allows a link, i < j where other is this tree."""
        same = self is other
        depth = max(len(self.levels), len(other.levels))
        a_levels = self.levels + [self.levels[-1]] * (depth - len(self.levels))
        b_levels = other.levels + [other.levels[-1]] * (depth - len(other.levels))
        todo = [(depth - 1, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while todo:
            level, i, j = todo.pop()
            (top_a, least_a), (top_b, least_b) = a_levels[level], b_levels[level]
            bound = np.minimum(top_a[i], top_b[j]).sum(1)
            keep = bound >= _least_overlap(least_a[i].astype(np.int64) + least_b[j], num, den)
            i, j = i[keep], j[keep]
            if level == 0:
                if same:
                    i, j = i[i < j], j[i < j]
                if len(i):
                    yield self.order[i], other.order[j]
                continue
            i = self._below(i, a_levels, level)
            j = np.concatenate([j[k:k + 1].repeat(len(x)) for k, x in enumerate(i)]) if i else j[:0]
            i = np.concatenate(i) if i else np.zeros(0, np.int64)
            below = self._below(j, b_levels, level)
            i = np.concatenate([i[k:k + 1].repeat(len(x)) for k, x in enumerate(below)]) if below else i[:0]
            j = np.concatenate(below) if below else j[:0]
            if same:
                i, j = i[i <= j], j[i <= j]
            todo += [(level - 1, i[s : s + 65536], j[s : s + 65536]) for s in range(0, len(i), 65536)]

    @staticmethod
    def _below(nodes: np.ndarray, levels: list, level: int) -> list[np.ndarray]:
        n, m = len(levels[level - 1][0]), len(levels[level][0])
        if n == m:  # a shorter tree waits at its root
            return [nodes[k : k + 1] for k in range(len(nodes))]
        return [np.arange(x * LEAF, min(n, (x + 1) * LEAF)) for x in nodes.tolist()]


def linked(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    need = int(_least_overlap(np.int64(len(a) + len(b)), num, den))
    if min(len(a), len(b)) < need:
        return False
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(long, short)
    at[at == len(long)] = 0
    return int((long[at] == short).sum()) >= need


def join_sets(sets: list[np.ndarray], label: np.ndarray, num: int, den: int, split: int | None = None) -> np.ndarray:
    """Labels with linked sets joined; a pair already under one label is not verified again.

    split: join only the sets before it with those from it on.
    """
    root = np.unique(label, return_inverse=True)[1]
    first = np.full(root.max() + 1, len(sets))
    np.minimum.at(first, root, np.arange(len(sets)))
    parent = first[root]

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def settled() -> None:
        nonlocal parent
        while not np.array_equal(up := parent[parent], parent):
            parent = up

    if split is None:
        tree = CountTree(sets)
        found = tree.pairs(tree, num, den)
    else:
        found = ((i, j + split) for i, j in CountTree(sets[:split]).pairs(CountTree(sets[split:]), num, den))
    fine = _Fine(sets)
    for i, j in found:
        settled()
        apart = parent[i] != parent[j]
        i, j = i[apart], j[apart]
        allowed = fine.allows(i, j, num, den)
        for x, y in zip(i[allowed].tolist(), j[allowed].tolist(), strict=True):
            p, q = find(x), find(y)
            if p != q and linked(sets[x], sets[y], num, den):
                parent[max(p, q)] = min(p, q)
    settled()
    return parent


class _Fine:
    """The count bound in so many groups that each holds a few shingles of the largest set."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.size = np.array([len(u) for u in sets], np.int64)
        most = int(self.size.max(initial=1))
        self.groups = min(FINE, 1 << max(0, (most // 2).bit_length()))
        self.counts: np.ndarray | None = None

    def allows(self, i: np.ndarray, j: np.ndarray, num: int, den: int) -> np.ndarray:
        if self.groups <= GROUPS or not len(i):
            return np.ones(len(i), bool)
        if self.counts is None:
            self.counts = np.stack([np.minimum(_group_counts(u, self.groups), 65535).astype(np.uint16) for u in self.sets])
        need = _least_overlap(self.size[i] + self.size[j], num, den)
        step = max(1, CELLS // self.groups)
        parts = [np.minimum(self.counts[i[a : a + step]], self.counts[j[a : a + step]]).sum(1, dtype=np.int64) for a in range(0, len(i), step)]
        held = np.concatenate(parts)
        full = held >= need
        # a count that was cut off may stand for more
        return full | (np.maximum(self.size[i], self.size[j]) > 65535)


def _join_group(num: int, den: int):
    """Rows of one task: part 0 or 1 (1: only against 0), doc_id, label, elements. Gives edges (a, b) that hold."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["part", "doc_id"], kind="stable")
        sets = [np.frombuffer(x, np.uint64) for x in rows["elements"]]
        ids, part = rows["doc_id"].to_numpy(), rows["part"].to_numpy()
        split = int((part == 0).sum()) if part.any() else None
        parent = join_sets(sets, rows["label"].to_numpy(), num, den, split)
        apart = parent != np.arange(len(ids))
        return pd.DataFrame({"a": ids[apart], "b": ids[parent[apart]]})

    return run


def ngram_jaccard_components(docs: DataFrame, num: int = 80, den: int = 100, k: int = 5, lower: bool = True) -> DataFrame:
    """Link documents (doc_id, text, ...) whose shingle sets have den * |A & B| >= num * |A | B|.

    Returns doc_id, n_shingles (size of the set), component_id (smallest doc_id reachable by links, itself included),
    a row for every input row. A set holds the distinct k-word shingles of the whole text, ASCII letters lower-cased if
    asked; with fewer than k words the whole sequence is one. A null or wordless text has no shingles and links with
    nothing, nor does a row without doc_id (its component is null). Rows with the same doc_id are one vertex. Other
    columns are ignored, whatever their names.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sized = shared.written(
        docs.mapInArrow(_digest_batches(k, lower), "doc_id long, n long, d1 long, d2 long, counts binary, hot array<long>, times array<long>"), "ngram-sizes"
    )
    classes = shared.written(
        sized.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("counts").alias("counts")), "ngram-classes"
    )
    hot = _hot_shingles(sized)
    edges = _class_edges(docs, classes, num, den, k, lower, hot)
    found = shared.components(edges)
    by_class = classes.join(found.withColumnRenamed("v", "rep"), "rep", "left").select(
        "n", "d1", "d2", F.coalesce("component", "rep").alias("component")
    )
    return sized.select("doc_id", "n", "d1", "d2").join(by_class, ["n", "d1", "d2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id")
    )


def keep_one(docs: DataFrame, num: int = 80, den: int = 100, k: int = 5) -> DataFrame:
    """Of each group of linked documents the one with the smallest doc_id; of rows with the same doc_id one.

    All columns stay as they are, whatever their names, and so do rows that link with nothing, those without doc_id and
    null and empty texts among them; an empty table gives an empty one."""
    found = shared.written(ngram_jaccard_components(docs, num, den, k), "ngram-found").where("doc_id is not null")
    rows, name = shared.numbered(docs)
    own = name["doc_id"]
    ids = found.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n"), F.min("component_id").alias("component_id"))
    gone = shared.written(ids.where("component_id <> id").select("id"), "ngram-gone")
    twice = shared.written(ids.where("component_id = id and n > 1").select("id"), "ngram-twice")

    def cut(x: DataFrame, ids: DataFrame, keep: bool) -> DataFrame:
        if ids.count() <= shared.BROADCAST_ROWS and rows.schema[own].dataType == T.LongType():
            return shared.among(x, shared.collected(ids), own, keep)
        return x.join(ids, F.col(own) == F.col("id"), "left_semi" if keep else "left_anti")

    left = cut(rows, gone, False)
    if not twice.isEmpty():
        once = cut(left, twice, True).dropDuplicates([own])
        left = cut(left, twice, False).union(once)
    return left.toDF(*docs.columns)


def _hot_shingles(sized: DataFrame) -> np.ndarray:
    """Sorted hot shingles; their number is bounded by the mean size of a set, not by the corpus."""
    least = max(3.0, HOT * sized.count() / 2)
    rows = (
        sized.where("hot is not null").select(F.explode(F.arrays_zip("hot", "times")).alias("x"))
        .groupBy(F.col("x.hot").alias("hot")).agg(F.sum("x.times").alias("times")).where(F.col("times") >= least)
        .select("hot")
    )
    return np.sort(shared.collected(rows).view(np.uint64))


def _class_edges(docs: DataFrame, classes: DataFrame, num: int, den: int, k: int, lower: bool, hot) -> DataFrame:
    """Links between class representatives that join all that is linked."""
    keys = docs.where("doc_id is not null").mapInArrow(_key_batches(num, den, k, lower, hot), "key long, d1 long, kind int, least int, near long")
    w = Window.partitionBy("key")
    blocks = keys.withColumn("p", F.min("d1").over(w)).withColumn("q", F.max("d1").over(w)).where("p <> q or near is not null")
    blocks = shared.written(blocks.select("key", "d1", "kind", "least", "p", "near").distinct(), "ngram-blocks")
    # of a set's groups of one kind, all that are filled but those that may differ are a linked set's too: a set with
    # fewer groups that it shares with any other has no link by them
    enough = blocks.groupBy("d1", "kind").agg(F.count("*").alias("held"), F.max("least").alias("least")).where("held >= least").select("d1", "kind")
    blocks = blocks.join(enough, ["d1", "kind"], "left_semi")
    near = blocks.where("near is not null").select("d1", F.col("near").alias("p"), F.lit(True).alias("large"))
    blocks = blocks.where("near is null").drop("near")
    sizes = blocks.groupBy("key").agg(F.count("*").alias("c"))
    blocks = blocks.join(sizes, "key")
    # a large block is a star about its smallest; of a small one each pair is put to the bound
    stars = blocks.where(F.col("c") > SMALL).where("d1 <> p").select("d1", "p", F.lit(True).alias("large"))
    small = blocks.where(F.col("c") <= SMALL).select("key", "d1")
    pairs = small.join(small.withColumnRenamed("d1", "p"), "key").where("d1 > p").select("d1", "p", F.lit(False).alias("large"))
    met = near.union(stars).union(pairs).groupBy("d1", "p").agg(F.count("*").alias("shared_groups"), F.max("large").alias("large"))
    x = classes.select("d1", F.col("rep").alias("x"), F.col("n").alias("nx"), F.col("counts").alias("cx"))
    y = classes.select(F.col("d1").alias("p"), F.col("rep").alias("y"), F.col("n").alias("ny"), F.col("counts").alias("cy"))
    both = met.join(x, "d1").join(y, "p").where("x <> y").select("x", "y", "shared_groups", "large", "nx", "ny", "cx", "cy")
    meets = shared.written(both.mapInArrow(_bound_batches(num, den), "x long, y long, shared_groups long"), "ngram-meets")
    shards = shared.components(meets.select(F.col("x").alias("a"), F.col("y").alias("b")))
    sizes = classes.groupBy(F.col("rep").alias("doc_id")).agg(F.max("n").alias("n"))
    shards = shared.written(shards.select(F.col("v").alias("doc_id"), F.col("component").alias("shard")).join(sizes, "doc_id"), "ngram-shards")
    chunks = shards.groupBy("shard").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / ELEMENTS)).cast("int").alias("chunks"))
    chunks = shared.written(chunks.where("chunks > 1"), "ngram-chunks")
    placed = shards.join(chunks, "shard", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    placed = placed.withColumn("chunk", F.pmod(F.xxhash64("doc_id"), F.col("chunks")).cast("int"))

    # a task joins a whole shard, or a chunk of a large one together with the shard's pivots: those that share most
    # groups' contents with others, one of each PIVOTS-th of the shard
    weights = meets.groupBy(F.col("y").alias("doc_id")).agg(F.sum("shared_groups").alias("w")).join(placed.where("chunks > 1"), "doc_id")
    heads = weights.groupBy("shard", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(PIVOTS)).alias("r"))
    pivots = heads.agg(F.max_by("doc_id", F.struct("w", -F.col("doc_id"))).alias("doc_id")).select("doc_id", "r")
    placed = shared.written(placed.join(pivots, "doc_id", "left"), "ngram-placed")
    chunk = F.explode(F.when(F.col("r").isNull(), F.array("chunk")).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    first = placed.select("doc_id", "shard", chunk.alias("chunk")).select(
        "doc_id", "shard", F.lit(0).alias("mine"), "chunk", F.col("doc_id").alias("label"), F.lit(0).alias("part")
    )
    edges = shared.written(_joined(docs, first, num, den, k, lower), "ngram-edges")
    large = placed.where("chunks > 1")
    if large.isEmpty():
        return edges

    # of a large shard, what is not yet in its largest component is joined with every chunk
    label = shared.components(edges).withColumnRenamed("v", "doc_id")
    large = large.join(label, "doc_id", "left").select("doc_id", "shard", "n", "chunk", "chunks", F.coalesce("component", "doc_id").alias("label"))
    large = shared.written(large, "ngram-large")
    main = large.groupBy("shard", "label").count().groupBy("shard").agg(F.max_by("label", F.struct("count", "label")).alias("main"))
    apart = large.join(main, "shard").where("label <> main").drop("main")
    parts = apart.groupBy("shard").agg(F.ceil(F.greatest(F.count("*") / CHUNK, F.sum("n") / ELEMENTS)).cast("int").alias("parts"))
    asks = apart.join(parts, "shard").select(
        "doc_id", "shard", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("mine"),
        F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "label", F.lit(1).alias("part"),
    )
    holds = large.join(parts, "shard").select(
        "doc_id", "shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("mine"), "chunk", "label", F.lit(0).alias("part")
    )
    second = shared.written(_joined(docs, asks.union(holds), num, den, k, lower), "ngram-edges")
    return edges.union(second)


def _joined(docs: DataFrame, slots: DataFrame, num: int, den: int, k: int, lower: bool) -> DataFrame:
    """Edges found by the tasks (shard, mine, chunk) of slots; a document's shingles are made anew from its text."""
    slots = slots.groupBy("doc_id", "shard").agg(F.collect_list(F.struct("mine", "chunk", "label", "part")).alias("slots"))
    slots = shared.written(slots, "ngram-slots")
    if slots.count() <= shared.BROADCAST_ROWS:  # only the texts that have slots are shuffled; the slots never go through the driver
        docs = shared.among(docs, shared.collected(slots.select("doc_id")), "doc_id")
    sets = docs.join(slots.hint("merge"), "doc_id").mapInArrow(
        _set_batches(k, lower), "doc_id long, shard long, slots array<struct<mine:int,chunk:int,label:long,part:int>>, elements binary"
    )
    each = sets.select("doc_id", "shard", F.explode("slots").alias("s"), "elements").select("doc_id", "shard", "s.*", "elements")
    return each.groupBy("shard", "mine", "chunk").applyInPandas(_join_group(num, den), "a long, b long")
