"""Nearest neighbours by largest inner product: collision-counting hashing with virtual rehashing.

Vectors are given one more coordinate that makes their norms equal, so that the largest inner product is the smallest
distance. That coordinate must be small, or it hides the others; so each shard's vectors are taken in bands of norms that
differ by RATIO at most, longest first, and made equal to the band's longest. A query leaves the bands that no longer can
hold a better vector than its k-th; a band of at most WHOLE vectors is verified whole. Each other band keeps M random
projections as sorted arrays. A query's window on each
array is centred on its own projection and widened step by step (virtual rehashing: no bucket edges); a vector that
falls into the windows of at least COLLISIONS of the arrays is a candidate. Widening ends when there are as many
candidates as asked for plus a share SPARE of the band, or when the windows hold everything, so that nothing is ever
missed for want of candidates. Candidates are verified: inner products of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from isoterra.llm import vectors

PROJECTIONS = 128
COLLISIONS = 0.63
SPARE = 0.1
#: First half-width of a window in standard deviations of the projections, and its growth.
WIDTH, GROWTH = 0.7, 1.15
#: Largest norm of a band to its smallest; vectors of a band that has no projections.
RATIO, WHOLE = 1.1, 2048
#: Parts of as many vectors each that a sorted array is kept in, at most: windows end at their edges, never short of a vector,
#: and a place is one byte.
CUTS = 256
#: Vectors of a shard; queries of a block for each shard that there is, and at most: what every block needs of a shard is
#: small beside its own work.
SHARD, BLOCK, LARGE = 65536, 512, 8192
#: Partitions of the search; groups beyond them share a task, one after the other.
PARTITIONS = 100_000


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for place, x in vectors.blocks(b.column("vec_id"), b.column("embedding")):
            yield pa.record_batch(
                [b.column("vec_id").take(pa.array(place)), pa.array(np.full(len(x), x.shape[1], np.int32)), pa.array([r.tobytes() for r in x], pa.binary())],
                ["vec_id", "dim", "vec"],
            )


class SortedProjections:
    """Index of one band: where the parts of the sorted projections start, and each vector's part in every one of them."""

    def __init__(self, x: np.ndarray, norm2: float, k: int, seed: int = 7):
        self.x, n = x, len(x)
        lift = np.sqrt(np.maximum(norm2 - (x * x).sum(1), 0))
        self.axes = np.random.default_rng(seed).standard_normal((x.shape[1] + 1, PROJECTIONS))
        p = np.ascontiguousarray((x @ self.axes[:-1] + lift[:, None] * self.axes[-1]).astype(np.float32).T)
        step = -(-n // CUTS)
        self.place = np.zeros(p.shape, np.uint8)
        for row, place in zip(p, self.place, strict=True):
            place[np.argsort(row, kind="stable")] = np.arange(n) // step
        self.starts = np.sort(p, axis=1)[:, ::step].copy()
        self.width = WIDTH * (float(p.std()) or 1.0)
        # narrower windows than those that some of the band's own vectors need are not tried for the queries
        tried = [self.candidates(x[i], norm2, k)[1] for i in range(0, n, max(1, n // 5))]
        self.width = max(self.width, min(tried) / GROWTH)

    def candidates(self, q: np.ndarray, norm2: float, k: int) -> tuple[np.ndarray, float]:
        """Vectors that collide with q often enough, and the half-width of the windows that gave enough of them."""
        n = len(self.x)
        at = q @ self.axes[:-1] * np.sqrt(norm2 / max(float(q @ q), 1e-300))
        need, wanted = int(np.ceil(COLLISIONS * PROJECTIONS)), min(n, k + int(np.ceil(SPARE * n)))
        width, cuts = self.width, self.starts.shape[1]
        moved, inside = np.empty(n, np.uint8), np.empty(n, bool)
        while True:
            count = np.zeros(n, np.uint8)
            lows, highs = ((self.starts < (at + w).astype(np.float32)[:, None]).sum(1) for w in (-width, width))
            lows = np.maximum(lows - 1, 0)  # what begins before the window may reach into it
            for place, low, high in zip(self.place, lows.tolist(), highs.tolist(), strict=True):
                if high - low == cuts:
                    count += 1
                elif high > low:  # places from low to high, those below low wrap round
                    np.subtract(place, np.uint8(low), out=moved)
                    np.less(moved, np.uint8(high - low), out=inside)
                    count += inside.view(np.uint8)
            found = np.flatnonzero(count >= need)
            if len(found) >= wanted:
                return found, width
            width *= GROWTH


class Banded:
    """Index of one shard: bands of like norms, longest first. Inside, vectors are measured by the shard's largest number."""

    def __init__(self, x: np.ndarray, k: int):
        self.x, self.scale = x, np.abs(x).max()
        unit = x / self.scale
        norm = np.sqrt((unit * unit).sum(1))
        order, self.bands = np.argsort(-norm, kind="stable"), []
        falling = -norm[order]
        a = 0
        while a < len(order):
            longest = -falling[a]
            z = max(a + 1, int(np.searchsorted(falling, -longest / RATIO, side="right")))
            place = np.sort(order[a:z])  # as they came: norms that differ by rounding change nothing
            self.bands.append((longest, place, SortedProjections(unit[place], longest**2, k) if z - a > WHOLE else None))
            a = z

    def best(self, q: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best for q, without its own id. A sum that is no number is the least."""
        unit = q / np.abs(q).max()
        length, found, score, measure = float(np.sqrt(unit @ unit)), np.zeros(0, ids.dtype), np.zeros(0), np.zeros(0)
        for longest, place, index in self.bands:
            if len(score) == k and measure[-1] > length * longest * (1 + 1e-9):
                break
            if index is not None:
                some, _ = index.candidates(unit, longest**2, k + 1)
                place = place[some]
            place = place[ids[place] != own]
            with np.errstate(over="ignore", invalid="ignore"):
                exact = np.einsum("ij,j->i", self.x[place], q)
            exact[np.isnan(exact)] = -np.inf
            if len(place) > k:  # all that tie with the k-th stay
                best = exact >= np.partition(exact, len(exact) - k)[len(exact) - k]
                place, exact = place[best], exact[best]
            found = np.concatenate([found, ids[place]])
            score = np.concatenate([score, exact])
            measure = np.concatenate([measure, np.einsum("ij,j->i", self.x[place] / self.scale, unit)])
            first = np.lexsort((found, -score))[:k]
            found, score, measure = found[first], score[first], measure[first]
        return found, score


def _search(k: int):
    def run(key, data: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = {"query_id": [], "vec_id": [], "score": []}
        if len(data) and len(asked):
            data = data.sort_values(["vec_id", "vec"], kind="stable")
            x = np.frombuffer(b"".join(data["vec"]), np.float64).reshape(len(data), -1)
            ids, index = data["vec_id"].to_numpy(), Banded(x, k + 1)
            for q_id, raw in zip(asked["vec_id"].tolist(), asked["vec"], strict=True):
                found, score = index.best(np.frombuffer(raw, np.float64), ids, q_id, k)
                out["query_id"].append(np.full(len(found), q_id))
                out["vec_id"].append(found)
                out["score"].append(score)
        return pd.DataFrame({c: np.concatenate(v) if v else [] for c, v in out.items()}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(data: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """For every row of queries its k nearest rows of data (both vec_id, embedding): query_id, rank, vec_id, score.

    score is the inner product in double precision, rank starts at 1, ties go to the smaller vec_id; a query's own id
    is no candidate, and with fewer candidates all are given. Vectors that are null, empty, zero or hold a null or
    non-finite number, and rows without vec_id, take no part. Vectors meet only those of their own dimension. A
    repeated vec_id in data is one candidate for each row; a repeated query is answered once. Numbers of any magnitude take
    part: a sum beyond double precision is infinite, one that is no number the least. Other columns are ignored.
    """
    kind = "vec_id long, dim int, vec binary"
    rows = data.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_clean, kind)
    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_clean, kind).dropDuplicates(["vec_id", "dim"])
    by_dim = rows.groupBy("dim").agg(F.count("*").alias("n"))
    by_query = asked.groupBy("dim").agg(F.count("*").alias("q"))
    parts = by_dim.join(by_query, "dim").select(
        "dim", F.ceil(F.col("n") / SHARD).alias("shards"),
        F.ceil(F.col("q") / F.least(F.lit(LARGE), BLOCK * F.ceil(F.col("n") / SHARD))).cast("int").alias("blocks"),
    )
    held = rows.join(parts, "dim").select(
        "dim", F.pmod(F.xxhash64("vec_id"), F.col("shards")).alias("shard"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vec_id", "vec",
    )
    sent = asked.join(parts, "dim").select(
        "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)).alias("shard"),
        F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int").alias("block"), "vec_id", "vec",
    )
    key = ["dim", "shard", "block"]
    # each task has a few groups; small tables would else be one task
    tasks = parts.agg(F.coalesce(F.sum(F.col("shards") * F.col("blocks")), F.lit(1))).first()[0]
    held, sent = (x.repartition(min(int(tasks) * 2, PARTITIONS), *key) for x in (held, sent))
    found = held.groupBy(key).cogroup(sent.groupBy(key)).applyInPandas(_search(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
