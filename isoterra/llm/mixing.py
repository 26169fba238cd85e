"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's texts, in an order of their own, are one stream of words cut into blocks. Its target is an exact number of
words: whole passes over the stream and a rest, which is a quota of blocks (the last one in part). A tree over the
output shards splits the quotas of all sources: at each node the left half's share of every source is a multivariate
hypergeometric draw, so that the shards add up exactly. A seeded permutation of a source's blocks says at which place
each is drawn; the places are dealt to the shards in the tree's amounts. Blocks drawn by a shard are disjoint from
those of others, and are shuffled within it by a hash.

Nothing but one row per source and the tree's quotas is on the driver.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from isoterra.llm import shared

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
#: Words of a block; more where a corpus would have over 2**29 blocks, for the draws are of 32-bit populations.
BLOCK = 128
#: Parts of a source within which offsets are running sums, so that no source is one task.
BUCKETS = 1 << 16
#: Buckets of a larger part, so that the sums over a source are over few rows.
PART = 256
SHARDS = 64


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float, most: float) -> list[float]:
    """Words of each source: weights share `share` of all words, none gets over `most` times its own; the excess is shared anew."""
    left, out = share * sum(sizes), [0.0] * len(sizes)
    free = [i for i, n in enumerate(sizes) if n > 0]
    while free and left > 0:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in free if unit * weights[i] > most * sizes[i]]
        for i in over or free:
            out[i] = most * sizes[i] if over else unit * weights[i]
            left -= out[i]
        free = [i for i in free if i not in set(over)] if over else []
    return out


def split_quotas(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Exact quotas [source, shard]; at each node of the tree the left half is a multivariate hypergeometric draw."""
    out = np.zeros((len(quotas), shards), np.int64)

    def node(lo: int, hi: int, held: np.ndarray) -> None:
        if hi - lo == 1:
            out[:, lo] = held
            return
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        rest, draw = int(held.sum()), int(held.sum()) * (mid - lo) // (hi - lo)
        left = np.zeros_like(held)
        for i, n in enumerate(held.tolist()):
            rest -= n
            left[i] = rng.hypergeometric(n, rest, draw) if n and draw else 0
            draw -= int(left[i])
        node(lo, mid, left)
        node(mid, hi, held - left)

    if quotas:
        node(0, shards, np.array(quotas, np.int64))
    return out


def _coprime(n: int, rng: np.random.Generator) -> int:
    a = int(rng.integers(1, n)) if n > 1 else 1
    while math.gcd(a, n) != 1:
        a = a % n + 1
    return a


ADDED = ("size", "source_size", "target", "taken", "pieces")


def mix_sources(docs: DataFrame, share: float = 1.5, most: float = 2.0, shards: int = SHARDS, seed: int = 17) -> DataFrame:
    """Mix documents (doc_id, source, text) to `share` of all their words, sources weighted 5, 2, 1 in code point order.

    Returns every input column and size, source_size, target (of its source), taken (words the mix takes of it, repeats
    counted) and pieces: array of (turn, shard, place, start, words), the runs of words that each shard takes and its order
    in the shard, with turn, the pass over the source. A null source is a source, the last; a null text has no words and
    is never taken. No document is taken over `most` (a whole number) times. Repeated rows are documents of their own; of
    the input's columns those named like the added ones are replaced, any other name is kept. An empty table gives none.
    """
    rows, name = shared.numbered(docs)
    mixed = _mixed(rows, name, share, most, shards, seed)
    return mixed.select(*(F.col(name[c]).alias(c) for c in docs.columns if c not in ADDED), *ADDED)


def _mixed(docs: DataFrame, name: dict[str, str], share: float, most: float, shards: int, seed: int) -> DataFrame:
    """The rows of numbered docs with the added columns."""
    spark = docs.sparkSession
    doc_id, text = F.col(name["doc_id"]), F.col(name["text"]).cast("string")
    docs = docs.withColumn("size", n_words(text)).withColumn("_source", F.col(name["source"]).cast("string"))
    bucket = F.pmod(F.xxhash64(doc_id), F.lit(BUCKETS))
    held = shared.written(docs.groupBy("_source", bucket.alias("_bucket")).agg(F.sum("size").alias("_held")), "mix-buckets")
    stats = held.groupBy("_source").agg(F.sum("_held").alias("words")).collect()  # a row for each source
    rows = sorted(((r["_source"], int(r["words"])) for r in stats), key=lambda r: (r[0] is None, (r[0] or "").encode("utf-8", "surrogatepass")))
    sizes = [n for _, n in rows]
    wanted = targets(sizes, [WEIGHTS[i % len(WEIGHTS)] for i in range(len(rows))], share, most)
    block = max(BLOCK, -(-sum(sizes) // (1 << 28)))
    rng = np.random.default_rng(seed)
    plan = []
    for i, ((source, n), target) in enumerate(zip(rows, wanted, strict=True)):
        blocks, passes = -(-n // block), int(target // n) if n else 0
        rest = round(target) - passes * n if n else 0
        steps = [_coprime(blocks, rng) if blocks else 1 for _ in range(int(most) + 1)]
        moves = [int(rng.integers(0, blocks)) if blocks else 0 for _ in range(int(most) + 1)]
        if blocks and (steps[passes] * (blocks - 1) + moves[passes]) % blocks < rest // block:
            rest += blocks * block - n  # the stream's last block is drawn, and is shorter
        plan.append([i, source, n, float(target), blocks, passes, rest // block, rest % block, steps, moves])
    quotas = split_quotas([p[5] * p[4] + p[6] + (p[7] > 0) for p in plan], shards, seed)
    plan = [[*p, np.cumsum(q).tolist()] for p, q in zip(plan, quotas, strict=True)]
    kind = "_no int, _name string, source_size long, target double, _blocks long, _passes int, _whole long, _part long, _steps array<long>, _moves array<long>, _bounds array<long>"
    sources = spark.createDataFrame(plan, kind)
    if len(plan) <= 1000:
        sources = F.broadcast(sources)

    placed = docs.join(sources, F.col("_source").eqNullSafe(F.col("_name"))).withColumn("_bucket", bucket)
    placed = placed.withColumn("_tie", F.xxhash64(text))
    heads = held.join(sources.select("_no", "_name"), F.col("_source").eqNullSafe(F.col("_name"))).select("_no", "_bucket", "_held")
    # words before a bucket: those of the larger parts before its own, and in that part
    part = F.floor(F.col("_bucket") / PART)
    before = Window.partitionBy("_no").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = heads.groupBy("_no", part.alias("_part")).agg(F.sum("_held").alias("_sum"))
    parts = parts.select("_no", "_part", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_first"))
    inner = Window.partitionBy("_no", "_part").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.withColumn("_part", part).join(parts, ["_no", "_part"])
    heads = heads.select("_no", "_bucket", (F.col("_first") + F.coalesce(F.sum("_held").over(inner), F.lit(0))).alias("_head"))
    within = Window.partitionBy("_no", "_bucket").orderBy(doc_id, "_tie", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.join(heads, ["_no", "_bucket"]).withColumn("_at", F.col("_head") + F.coalesce(F.sum("size").over(within), F.lit(0)))

    def drawn(k: Column) -> Column:
        lo, hi = F.greatest(F.col("_at"), k * block), F.least(F.col("_at") + F.col("size"), (k + 1) * block)

        def of_pass(r: Column) -> Column:
            place = F.pmod(F.element_at("_steps", r + 1) * k + F.element_at("_moves", r + 1), F.col("_blocks"))
            last = F.least(hi, k * block + F.col("_part"))
            end = F.when((r < F.col("_passes")) | (place < F.col("_whole")), hi).when(place == F.col("_whole"), last).otherwise(lo)
            at = r * F.col("_blocks") + place
            shard = F.size(F.filter("_bounds", lambda b: b <= at))
            return F.struct(r.alias("turn"), shard.alias("shard"), F.xxhash64(F.lit(seed), "_no", at).alias("place"), (lo - F.col("_at")).alias("start"), (end - lo).alias("words"))

        return F.filter(F.transform(F.sequence(F.lit(0), F.col("_passes")), of_pass), lambda p: p["words"] > 0)

    blocks = F.sequence(F.floor(F.col("_at") / block), F.floor((F.col("_at") + F.col("size") - 1) / block))
    pieces = F.when(F.col("size") > 0, F.flatten(F.transform(blocks, drawn))).otherwise(F.expr("cast(array() as array<struct<turn:int,shard:int,place:bigint,start:bigint,words:bigint>>)"))
    placed = placed.withColumn("pieces", pieces)
    placed = placed.withColumn("taken", F.aggregate("pieces", F.lit(0).cast("long"), lambda s, p: s + p["words"]))
    return placed.select(*name.values(), *ADDED)


def mixed_rows(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each document and pass that takes words of it, with docs' columns as they were.

    Where a pass takes the whole document its text is as it was, else the words taken, joined by one space. n_chars, if
    there is such a column, is the length of the new text. A document without words (null and empty texts) is in no pass
    and has no row; repeated rows are documents each; an empty table gives none; no column's name matters."""
    rows, name = shared.numbered(docs)
    mixed = _mixed(rows, name, 1.5, 2.0, SHARDS, 17)
    turns = F.explode(F.array_distinct(F.transform("pieces", lambda p: p["turn"]))).alias("turn")
    each = mixed.select("*", turns).withColumn("own", F.expr("filter(pieces, p -> p.turn = turn)"))
    whole = F.aggregate("own", F.lit(0).cast("long"), lambda s, p: s + p["words"]) == F.col("size")
    text = F.col(name["text"])
    words = F.regexp_extract_all(text.cast("string"), F.lit(WORD), F.lit(0))
    runs = F.array_sort(F.transform("own", lambda p: F.struct(p["start"], p["words"])))
    some = F.array_join(F.flatten(F.transform(runs, lambda p: F.slice(words, (p["start"] + 1).cast("int"), p["words"].cast("int")))), " ")
    each = each.withColumn(name["text"], F.when(whole, text).otherwise(some))
    if "n_chars" in name:
        each = each.withColumn(name["n_chars"], F.length(text).cast(docs.schema["n_chars"].dataType))
    return each.select(*(F.col(name[c]).alias(c) for c in docs.columns))
