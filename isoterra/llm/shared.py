"""Tables in the cluster's shared folder, size-checked broadcasts, connected components."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Edges that a partition takes in before it makes a forest of them.
SLAB = 1_000_000
#: Rows of one long that a broadcast may hold; beyond it the join shuffles.
BROADCAST_ROWS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session one of our own."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + os.path.join(tempfile.gettempdir(), "isoterra-shared")
    return where.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/isoterra/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: lineage ends here, and a lost executor loses nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns renamed in0, in1, ..., and the new name of each, so that no other name can clash."""
    names = {c: f"in{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def semi(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of df whose column is in ids (one distinct column of that name). ids must be a written table;
    it is broadcast only after its rows were counted, else both sides shuffle."""
    if ids.count() <= BROADCAST_ROWS:
        ids = F.broadcast(ids)
    return df.join(ids, column, "left_semi")


def collected(ids: DataFrame) -> np.ndarray:
    """The distinct longs of a one-column table, sorted: 8 bytes each on the driver and in a task, where a broadcast's hash
    table takes about ten times as much."""
    column = ids.toArrow().column(0).combine_chunks()
    return np.unique(column.drop_null().to_numpy(zero_copy_only=False).astype(np.int64))


def among(df: DataFrame, ids: np.ndarray, column: str, keep: bool = True) -> DataFrame:
    """Rows of df whose column (a long) is in the sorted ids, or those that are not (null is in none). df is not shuffled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            value = b.column(b.schema.get_field_index(column))
            held = value.is_valid().to_numpy(zero_copy_only=False)
            x = value.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids):
                held &= ids[np.minimum(np.searchsorted(ids, x), len(ids) - 1)] == x
            else:
                held[:] = False
            yield b.filter(pa.array(held == keep))

    return df.mapInArrow(run, df.schema)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every vertex of the edges that is not the smallest of its component, and that smallest vertex."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    root = np.arange(len(ids))
    while len(x):
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
    below = np.flatnonzero(root != np.arange(len(ids)))
    return ids[below], ids[root[below]]


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forest of a partition's edges, put together slab by slab: it never holds more than one edge a vertex."""
    a, b, more, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0
    for batch in batches:
        more.append((batch.column("a").to_numpy(), batch.column("b").to_numpy()))
        n += batch.num_rows
        if n > SLAB + len(a):
            a, b = forest(*(np.concatenate(x) for x in zip((a, b), *more, strict=True)))
            more, n = [], 0
    a, b = forest(*(np.concatenate(x) for x in zip((a, b), *more, strict=True)))
    for i in range(0, len(a), SLAB):
        yield pa.record_batch([pa.array(a[i : i + SLAB]), pa.array(b[i : i + SLAB])], ["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(v, component) for every vertex of edges (a, b longs) that has another; component is the smallest reachable.

    Each partition first replaces its edges by its forest, so that a vertex has one edge a partition. Then rounds: every
    vertex's larger neighbours are sent to its smallest one (a minimum and a join), and the partitions, dealt by the larger
    end, make forests of what came. It ends when each vertex has one smaller neighbour and no other, or larger ones only.
    Each round is a written table.
    """
    pair = "a long, b long"
    now = written(edges.where("a <> b").select("a", "b").mapInArrow(_forests, pair), "cc")
    while True:
        both = now.union(now.select("b", "a")).toDF("u", "v")
        low = written(both.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("x")), "cc-low")
        if low.where("m < u and m <> x").isEmpty():
            return now.select(F.col("a").alias("v"), F.col("b").alias("component")).union(
                low.where("m > u").select(F.col("u").alias("v"), F.col("u").alias("component"))
            ).distinct()
        large = both.join(low.select("u", "m"), "u").where("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b"))
        now = written(large.repartition("a").mapInArrow(_forests, pair), "cc")
