"""Pairs of embeddings with a high cosine, by lattice hashing.

Unit vectors are projected to two random 8-dimensional spaces per table and decoded to the nearest point of the E8
lattice in each; the two points are the cell. Each vector is stored in its own cell of every table and looks into that
cell and those reached by moving one of the two points to its nearest lattice neighbours. Of the pairs that meet, those
whose sign sketches differ too much for the threshold (by six standard deviations) are left out, the rest are verified
by the cosine in double precision.

Equal vectors are one class before hashing: copies are counted, never expanded into pairs.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from isoterra.llm import shared, vectors, words

TABLES = 14
#: Lattice neighbours tried for each of a cell's two points.
PROBES = 10
#: Standard deviation of a unit vector's projection for pairs at the threshold, in lattice units.
SCALE = 0.19
SKETCH = 128


def _roots() -> np.ndarray:
    """The 240 shortest vectors of E8, by its definition."""
    whole = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            whole.append(v)
    half = [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(whole + half)


ROOTS = _roots()


def _nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    out = np.rint(x)
    off = x - out
    odd = np.flatnonzero(out.sum(1) % 2 != 0)
    worst = np.abs(off[odd]).argmax(1)
    out[odd, worst] += np.where(off[odd, worst] >= 0, 1.0, -1.0)
    return out


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the even integer points, or those moved by a half in every coordinate."""
    a, b = _nearest_even(x), _nearest_even(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


def _key(points: np.ndarray, salt: int) -> np.ndarray:
    weights = words.mix(np.arange(1, 9, dtype=np.uint64) + np.uint64(salt * 1000))
    with np.errstate(over="ignore"):
        return words.mix((np.rint(points * 2).astype(np.int64).view(np.uint64) * weights).sum(-1, dtype=np.uint64))


def cells(unit: np.ndarray, threshold: float, table: int) -> np.ndarray:
    """Keys of each vector's own cell (first) and of those it also looks into."""
    distance = math.sqrt(2 - 2 * threshold)
    rng = np.random.default_rng([unit.shape[1], table])
    own, near = [], []
    for side in (0, 1):
        x = unit @ rng.standard_normal((unit.shape[1], 8)) * (SCALE / distance)
        point = decode(x)
        toward = (x - point) @ ROOTS.T
        best = np.argpartition(-toward, PROBES, axis=1)[:, :PROBES]
        own.append(_key(point, 2 * table + side))
        near.append(_key(point[:, None] + ROOTS[best], 2 * table + side))
    with np.errstate(over="ignore"):
        turn = np.uint64(0x9E3779B97F4A7C15)
        dim = np.uint64(unit.shape[1] * 64 + table)
        both = [own[0] * turn + own[1], *(near[0] * turn + own[1][:, None]).T, *(own[0][:, None] * turn + near[1]).T]
        return words.mix(np.stack(both, axis=1) + words.mix(dim.reshape(1)))


def _class_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for place, x in vectors.blocks(b.column("vec_id"), b.column("embedding")):
            x = x + 0.0  # one zero
            yield pa.record_batch([b.column("vec_id").take(pa.array(place)), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "vec"])


def _cell_batches(threshold: float, probe: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = b.column("vec").to_pylist()
            size = np.array([len(r) for r in raw])
            ids = b.column("rep").to_numpy()
            for d in np.unique(size).tolist():
                for part in np.array_split(np.flatnonzero(size == d), max(1, int((size == d).sum()) // 1000)):
                    if not len(part):
                        continue
                    x = np.frombuffer(b"".join(raw[i] for i in part), np.float64).reshape(len(part), -1)
                    unit = x / np.linalg.norm(x / np.abs(x).max(1)[:, None], axis=1)[:, None] / np.abs(x).max(1)[:, None]
                    side = np.random.default_rng([unit.shape[1], 1 << 20]).standard_normal((unit.shape[1], SKETCH))
                    sketch = np.packbits(unit @ side > 0, axis=1).view(np.int64)
                    for t in range(TABLES):
                        key = cells(unit, threshold, t)
                        key = key if probe else key[:, :1]
                        n = key.shape[1]
                        yield pa.record_batch(
                            [pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(ids[part], n)), pa.array(np.repeat(sketch[:, 0], n)), pa.array(np.repeat(sketch[:, 1], n))],
                            ["cell", "rep", "s0", "s1"],
                        )

    return run


def _verify_batches(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right = b.column("va").to_pylist(), b.column("vb").to_pylist()
            sizes = np.array([len(x) if len(x) == len(y) else 0 for x, y in zip(left, right, strict=True)])
            keep = np.zeros(len(sizes), bool)
            for n in np.unique(sizes[sizes > 0]).tolist():
                at = np.flatnonzero(sizes == n)
                p, q = (np.frombuffer(b"".join(side[i] for i in at.tolist()), np.float64).reshape(len(at), -1) for side in (left, right))
                p, q = p / np.abs(p).max(1)[:, None], q / np.abs(q).max(1)[:, None]
                dot = lambda u, v: np.einsum("ij,ij->i", u, v)
                keep[at] = dot(p, q) / np.sqrt(dot(p, p) * dot(q, q)) >= threshold
            yield b.select(["a", "b"]).filter(pa.array(keep))

    return run


def near_duplicates(data: DataFrame, threshold: float = 0.9) -> DataFrame:
    """Link vectors (vec_id, embedding) with a cosine of at least the threshold.

    Returns vec_id, n_links (other vectors linked directly), component_id (smallest vec_id reachable, itself included)
    and kept (vec_id = component_id), a row for every input row. Vectors that are null, empty, zero or hold a null or
    non-finite number link with nothing, nor do vectors of different dimensions or rows without vec_id (component and
    kept null). Rows that repeat a vec_id are vectors of their own that share a vertex. Other columns are ignored.

    The sketches lose a pair at the threshold with a chance below 1e-9 (six standard deviations of SKETCH signs), the tables
    one that meets in none of them: recall is measured, not proven.
    """
    rows = data.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    valid = rows.mapInArrow(_class_batches, "vec_id long, vec binary").withColumn("h", F.sha2("vec", 256))
    classes = shared.written(
        valid.groupBy("h").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("vec").alias("vec")), "lattice-classes"
    )
    member = shared.written(valid.join(classes.select("h", "rep", "copies"), "h").select("vec_id", "rep", "copies"), "lattice-members")
    kind = "cell long, rep long, s0 long, s1 long"
    stored = classes.mapInArrow(_cell_batches(threshold, False), kind)
    looks = classes.mapInArrow(_cell_batches(threshold, True), kind)
    angle = math.acos(threshold) / math.pi
    most = int(SKETCH * angle + 6 * math.sqrt(SKETCH * angle * (1 - angle)))
    meets = (
        looks.alias("l").join(stored.alias("s"), F.col("l.cell") == F.col("s.cell"))
        .where(f"l.rep <> s.rep and bit_count(l.s0 ^ s.s0) + bit_count(l.s1 ^ s.s1) <= {most}")
        .select(F.least("l.rep", "s.rep").alias("a"), F.greatest("l.rep", "s.rep").alias("b")).distinct()
    )
    vec = classes.select("rep", "vec")
    pairs = meets.join(vec.select(F.col("rep").alias("a"), F.col("vec").alias("va")), "a").join(vec.select(F.col("rep").alias("b"), F.col("vec").alias("vb")), "b")
    links = shared.written(pairs.select("a", "b", "va", "vb").mapInArrow(_verify_batches(threshold), "a long, b long"), "lattice-links")
    found = shared.components(links).withColumnRenamed("v", "rep")
    copies = classes.select(F.col("rep").alias("b"), "copies")
    both = links.union(links.select("b", "a"))
    others = both.join(copies, "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("others"))
    linked = (
        member.join(found, "rep", "left").join(others, "rep", "left")
        .groupBy("vec_id").agg((F.max(F.col("copies") - 1 + F.coalesce("others", F.lit(0)))).alias("n_links"), F.min(F.coalesce("component", "rep")).alias("component"))
    )
    return rows.select("vec_id").join(linked, "vec_id", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"),
        (F.col("vec_id") == F.coalesce("component", "vec_id")).alias("kept"),
    )
