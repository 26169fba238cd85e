"""Best-fit packing of documents into sequences of several permitted lengths.

Documents are dealt to shards of a bounded number of documents. In each, pieces go from long to short into the open bin
that they leave least room in. Where none has room, a bin of the capacity with the least cost per word expected is
opened: the words expected are the piece and what is still to come that fits beside it. At the end each bin is cut to
the smallest permitted length that holds its contents.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from isoterra.llm.mixing import n_words

CAPACITIES = (256, 512, 1024, 2048, 4096)
#: Documents of a shard.
SHARD = 8192
OUT = "piece int, piece_start long, piece_size long, bin_id long, capacity int, bin_offset long"


def cost(capacity: int) -> float:
    """Of a sequence: its words, attention that grows with the square, and a fixed part."""
    return capacity + capacity * capacity / 65536 + 8


def best_fit(sizes: np.ndarray, capacities: tuple[int, ...] = CAPACITIES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin, offset in the bin and final capacity of the bin for each piece (1 to the largest capacity)."""
    order = np.argsort(-sizes, kind="stable")
    left = sizes[order].astype(np.int64)
    rising = left[::-1]
    total = np.concatenate([[0], np.cumsum(rising)])  # of the k smallest
    bin_of, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    fill: list[int] = []
    room: list[tuple[int, int]] = []  # (words free, bin), rising
    for k, (i, n) in enumerate(zip(order.tolist(), left.tolist(), strict=True)):
        at = bisect.bisect_left(room, (n, -1))
        if at < len(room):
            free, b = room.pop(at)
        else:
            coming = len(left) - k - 1

            def rate(c: int, n: int = n, coming: int = coming) -> float:
                fits = min(coming, int(np.searchsorted(rising, c - n, side="right")))
                return cost(c) / (n + min(c - n, int(total[fits])))

            free, b = min((c for c in capacities if c >= n), key=rate), len(fill)
            fill.append(0)
        bin_of[i], offset[i] = b, fill[b]
        fill[b] += n
        if free > n:
            bisect.insort(room, (free - n, b))
    held = np.array(fill, np.int64)
    fits = np.array(capacities)[np.searchsorted(capacities, held)] if len(held) else np.zeros(0, np.int64)
    return bin_of, offset, fits[bin_of] if len(held) else fits


def _pack(capacities: tuple[int, ...]):
    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "tie"], kind="stable", na_position="first")
        size, most = rows["size"].to_numpy().astype(np.int64), capacities[-1]
        pieces = np.maximum(1, -(-size // most))
        doc = np.repeat(np.arange(len(rows)), pieces)
        number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start = number * most
        length = np.minimum(most, size[doc] - start)
        full = length > 0
        bins, offset, cap = np.full(len(doc), -1), np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        if full.any():
            bins[full], offset[full], cap[full] = best_fit(length[full], capacities)
        out = pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[doc], "size": size[doc], "piece": number, "piece_start": start, "piece_size": length})
        out["bin_id"] = pd.array(np.where(full, key[0] * (1 << 32) + bins, 0), "Int64")
        out["capacity"], out["bin_offset"] = pd.array(cap, "Int32"), pd.array(offset, "Int64")
        out.loc[~full, ["bin_id", "capacity", "bin_offset"]] = pd.NA
        return out.assign(doc_id=out["doc_id"].astype("Int64"))

    return run


def pack(docs: DataFrame, capacities: tuple[int, ...] = CAPACITIES) -> DataFrame:
    """Pack documents (doc_id, text) by their words into sequences of the permitted lengths.

    Returns a row for each piece: doc_id, size (words of the document), piece, piece_start, piece_size, bin_id, capacity
    (of the bin, after downsizing), bin_offset. A document longer than the largest capacity is cut into pieces of it. A
    null or wordless text is one piece of no words, without a bin. Rows without doc_id and rows that repeat one are
    packed each. Equal sizes are taken in the order of doc_id and text. Other columns are ignored.
    """
    capacities = tuple(sorted(capacities))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), n_words(F.col("text").cast("string")).alias("size"), F.xxhash64("text").alias("tie"))
    shards = sized.select(F.greatest(F.ceil(F.count("*") / SHARD), F.lit(1)).alias("_n"))
    dealt = sized.crossJoin(F.broadcast(shards)).withColumn("_shard", F.pmod(F.xxhash64("doc_id", "tie"), F.col("_n"))).drop("_n")
    return dealt.groupBy("_shard").applyInPandas(_pack(capacities), f"doc_id long, size long, {OUT}")
