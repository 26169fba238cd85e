"""Quality by positive-unlabelled learning: a model that minimises the non-negative unbiased risk.

Trusted positives are learning rows labelled good; unlabelled text is every document, whatever it is. The risk is
prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)]): what the positives among the unlabelled cost as
negatives is taken off, and never below nothing. No label but the positives' is read: half of them make the model; the
others give the class prior, the least share of the unlabelled above a score to the positives above it, and the scale and
shift that make the model's sum a probability under that prior.

The model is a sum of one step function for each measure of the text, its steps at quantiles of all documents, and of
hashed words and word pairs. Every document is measured once, into a small record; each round of the fit adds up the
gradient and curvature over all records, so that only sums of the model's size reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from isoterra.llm import shared, training, words

#: Steps of a measure, buckets of hashed words and pairs, whole numbers that a measure is kept in.
STEPS, BUCKETS, FINE = 12, 64, 4096
#: Newton steps, halvings of the price of a negative part, ridge of steps and of buckets.
ROUNDS, PRICES, RIDGE, LOOSE = 12, 4, 1e-2, 1.0
#: Sums are put into FINE bins from -SPAN to SPAN, and those into LEVELS groups to calibrate.
SPAN, LEVELS = 30.0, 40
#: Share of the positives that must lie above a score for it to bound the prior; least and largest prior.
ABOVE, PRIORS = 0.5, (0.03, 0.97)
_LETTER = {name: np.isin(np.arange(256), list(which)) for name, which in dict(upper=range(65, 91), lower=range(97, 123), mark=b"!?", sign=b"#$%&*@^~<>={}[]\\/_+", bar=b"|", digit=range(48, 58), stop=b".,;:", line=b"\n").items()}
#: What each measure is at most, for keeping it in whole numbers; finest near nothing.
TOP = np.array([1, 2, 4, 2, 1, 4, 2, 1, 1, 1, 64, 16, 1], float)
RECORD = len(TOP) * 2 + BUCKETS


def measures(c: words.Chunk) -> np.ndarray:
    """Measures [document, measure] of a chunk's documents."""
    docs = len(c.at) - 1
    n = np.diff(c.at).astype(float)
    of = np.repeat(np.arange(docs), np.diff(c.at))
    # bytes between two words count for the document of the earlier
    edge = np.concatenate([c.start[c.at[:-1][n > 0]], [len(c.data)]]) if len(c.start) else np.array([0])

    def per_doc(flag: np.ndarray) -> np.ndarray:
        out = np.zeros(docs)
        if len(edge) > 1:
            out[n > 0] = np.add.reduceat(flag[c.data], edge[:-1], dtype=np.int64)
        return out

    count = {k: per_doc(v) for k, v in _LETTER.items()}
    size = per_doc(np.ones(256, bool))
    letters = count["upper"] + count["lower"]
    at_least = np.maximum(n, 1)
    with np.errstate(over="ignore"):
        own = words.mix(c.word + (of.astype(np.uint64) << np.uint64(40)))
    distinct = np.zeros(docs)
    if len(own):
        distinct = np.bincount(of[np.unique(own, return_index=True)[1]], minlength=docs).astype(float)
    same = np.zeros(docs)
    if len(own) > 1:
        same = np.bincount(of[1:][(own[1:] == own[:-1])], minlength=docs).astype(float)
    four = words.sequences(own, 4)
    four_of = of[: len(four)]
    inside = four_of == of[3:] if len(four) else np.zeros(0, bool)
    kinds = np.bincount(four_of[inside][np.unique(four[inside], return_index=True)[1]], minlength=docs) if inside.any() else np.zeros(docs)
    mean = np.bincount(of, (c.stop - c.start).astype(float), minlength=docs) / at_least
    return np.column_stack([
        count["upper"] / np.maximum(letters, 1), count["mark"] / at_least, count["sign"] / at_least, count["bar"] / at_least,
        count["digit"] / np.maximum(size, 1), count["stop"] / at_least, count["line"] / at_least, same / at_least,
        np.log1p(distinct) / np.log1p(at_least), 1 - kinds / np.maximum(n - 3, 1) * (n > 3), mean, np.log1p(n), letters / np.maximum(size, 1),
    ])


def hashed(c: words.Chunk) -> np.ndarray:
    """Root of the share of each bucket among a document's words and pairs of words, in 255ths."""
    docs = len(c.at) - 1
    n = np.diff(c.at)
    of = np.repeat(np.arange(docs), n)
    two = words.sequences(c.word, 2)
    inside = of[: len(two)] == of[1:] if len(two) else np.zeros(0, bool)
    half = BUCKETS // 2
    where = np.concatenate([of * BUCKETS + (c.word % np.uint64(half)).astype(np.int64), (of[: len(two)] * BUCKETS + half + (two % np.uint64(half)).astype(np.int64))[inside]])
    share = np.bincount(where, minlength=docs * BUCKETS).reshape(docs, BUCKETS) / np.maximum(n, 1)[:, None]
    return np.rint(255 * np.sqrt(np.minimum(share, 1))).astype(np.uint8)


def records(column: pa.Array) -> Iterator[np.ndarray]:
    """The record [document, byte] of every document of a text column, in pieces of some documents."""
    for c in words.chunks(column):
        fine = np.floor((FINE - 1) * np.sqrt(np.clip(measures(c) / TOP, 0, 1))).astype("<u2")
        yield np.column_stack([np.ascontiguousarray(fine).view(np.uint8).reshape(len(fine), -1), hashed(c)])


def _stacked(column) -> np.ndarray:
    raw = b"".join(column if isinstance(column, list) else column.to_pylist())
    return np.frombuffer(raw, np.uint8).reshape(-1, RECORD)


def inputs(record: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """The model's inputs [document, input]: a column for each step of each measure, the buckets, and one."""
    fine = np.ascontiguousarray(record[:, : 2 * len(TOP)]).view("<u2")
    wide = sum(len(c) + 1 for c in cuts)
    out, at = np.zeros((len(record), wide + BUCKETS + 1), np.float32), 0
    for j, c in enumerate(cuts):
        out[np.arange(len(record)), at + np.searchsorted(c, fine[:, j], side="right")] = 1
        at += len(c) + 1
    out[:, wide:-1] = record[:, 2 * len(TOP) :] / np.float32(255)
    out[:, -1] = 1
    return out


def _chance(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _record_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        at = 0
        for r in records(b.column("text")):
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(RECORD), len(r), [None, pa.py_buffer(np.ascontiguousarray(r).tobytes())])
            yield pa.record_batch([b.column("doc_id").slice(at, len(r)), flat.cast(pa.binary())], ["doc_id", "record"])
            at += len(r)


def _histogram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, times): how often each measure has each value."""
    total = np.zeros(len(TOP) * FINE, np.int64)
    for b in batches:
        fine = np.ascontiguousarray(_stacked(b.column("record"))[:, : 2 * len(TOP)]).view("<u2").astype(np.int64)
        total += np.bincount((fine + np.arange(len(TOP)) * FINE).ravel(), minlength=len(total))
    some = np.flatnonzero(total)
    yield pa.record_batch([pa.array(some), pa.array(total[some])], ["place", "times"])


def _bin(z: np.ndarray) -> np.ndarray:
    return np.clip((z + SPAN) * (FINE / (2 * SPAN)), 0, FINE - 1).astype(np.int64)


def _sum_histogram(cuts, w):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(FINE, np.int64)
        for b in batches:
            for x in _parts(b, cuts):
                total += np.bincount(_bin(x @ w), minlength=FINE)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], ["place", "times"])

    return run


def _parts(b: pa.RecordBatch, cuts: list[np.ndarray]) -> Iterator[np.ndarray]:
    r = _stacked(b.column("record"))
    for a in range(0, len(r), 4096):
        yield inputs(r[a : a + 4096], cuts)


def _sum_batches(cuts, w):
    """Rows (line, total): sums over the records of a row of the curvature, of the gradient, and of (loss(-), records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(w)
        total = np.zeros((n + 2, n))
        for b in batches:
            for x in _parts(b, cuts):
                z = np.clip(x @ w, -30, 30)
                s = 1 / (1 + np.exp(-z))
                total[:n] += (x * (s * (1 - s)).astype(np.float32)[:, None]).T @ x
                total[n] += s @ x
                total[n + 1, 0] += np.logaddexp(0, z).sum()
                total[n + 1, 1] += len(x)
        yield pa.record_batch([pa.array(np.arange(n + 2)), pa.array([r.tobytes() for r in total], pa.binary())], ["line", "total"])

    return run


def _add_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list] = {}
    for b in batches:
        for line, raw in zip(b.column("line").to_pylist(), b.column("total").to_pylist(), strict=True):
            x = np.frombuffer(raw)
            held[line] = held[line] + x if line in held else x
    yield pa.record_batch([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["line", "total"])


def _sums(table: DataFrame, cuts, w) -> tuple[np.ndarray, np.ndarray, float, float]:
    """Curvature, gradient, loss(-) and number of records, each a sum over the table."""
    each = table.mapInArrow(_sum_batches(cuts, w), "line long, total binary")
    rows = each.repartition("line").mapInArrow(_add_lines, "line long, total binary").collect()
    total = np.zeros((len(w) + 2, len(w)))
    for r in rows:
        total[r["line"]] = np.frombuffer(r["total"])
    return total[:-2], total[-2], float(total[-1, 0]), float(total[-1, 1])


def fit_nnpu(p: np.ndarray, sums, prior: float, w: np.ndarray) -> np.ndarray:
    """Weights with the least non-negative risk under the logistic loss, from w.

    p are the positives' inputs, the fewer the stronger the ridge; sums(w) gives curvature, gradient, loss(-) and number
    over the unlabelled. Where the negatives' part, E_u[loss(-)] - prior * E_p[loss(-)], would fall below nothing, the
    least risk lies where it is nothing: there it has a price below one, which is found by halving.
    """
    mean = p.mean(0)
    keep = np.diag(np.concatenate([np.full(len(w) - BUCKETS - 1, RIDGE + 1 / len(p)), np.full(BUCKETS, LOOSE), [1e-9]]))

    def at(w: np.ndarray, price: float):
        h, g, loss, n = sums(w)
        z = np.clip(p @ w, -30, 30)
        s, own = 1 / (1 + np.exp(-z)), float(np.logaddexp(0, z).mean())
        # loss(+) = loss(-) - z, so the sum of the parts is convex at every price up to one
        value = prior * (1 - price) * own - prior * float(mean @ w) + price * loss / n + float(w @ keep @ w) / 2
        slope = prior * (1 - price) * (p.T @ s) / len(p) - prior * mean + price * g / n + keep @ w
        curve = prior * (1 - price) * ((p * (s * (1 - s))[:, None]).T @ p) / len(p) + price * h / n + keep
        return curve, slope, value, loss / n - prior * own

    def least(w: np.ndarray, price: float) -> tuple[np.ndarray, float]:
        curve, slope, value, below = at(w, price)
        for _ in range(ROUNDS):
            step = np.linalg.solve(curve, slope)
            if float(step @ slope) < 1e-5:
                break
            for _ in range(5):
                found = at(w - step, price)
                if found[2] <= value + 1e-12:
                    break
                step = step / 2
            else:
                break
            w, (curve, slope, value, below) = w - step, found
        return w, below

    w, below = least(w, 1.0)
    low, high = 0.0, 1.0
    for _ in range(PRICES):
        if below >= 0 and high == 1 and low == 0:
            break
        price = (low + high) / 2
        w, below = least(w, price)
        low, high = (price, high) if below >= 0 else (low, price)
    return w


def class_prior(p: np.ndarray, times: np.ndarray) -> float:
    """The least, over sums with at least ABOVE of the positives above, of the unlabelled's share above to theirs.

    p: sums of positives that the model was not fitted to, whose share is taken a standard error lower; times: a
    histogram of the unlabelled's sums."""
    above = np.cumsum(times[::-1])[::-1] / max(1, times.sum())
    own = np.cumsum(np.bincount(_bin(p), minlength=FINE)[::-1])[::-1] / len(p)
    some = own >= ABOVE
    own = own - np.sqrt(own * (1 - own) / len(p))
    return float(min(PRIORS[1], max(PRIORS[0], (above[some] / own[some]).min())))


def calibration(p: np.ndarray, times: np.ndarray, prior: float) -> tuple[float, float]:
    """Scale and shift that make a sum the logit of prior * (density of the positives) / (density of the unlabelled).

    That ratio is taken in groups of like numbers of the unlabelled, made to rise with the sum by pooling neighbours, and
    fitted by a logistic curve."""
    group = np.minimum((np.cumsum(times) - times) * LEVELS // max(1, times.sum()), LEVELS - 1).astype(np.int64)
    n = np.bincount(group, times, LEVELS)
    own = np.bincount(group[_bin(p)], minlength=LEVELS)
    centre = np.bincount(group, times * ((np.arange(FINE) + 0.5) * (2 * SPAN / FINE) - SPAN), LEVELS)
    pools: list[list[float]] = []  # positives' share, unlabelled's share, groups
    some = np.flatnonzero(n)
    for g in some.tolist():
        pools.append([prior * own[g] / len(p), n[g] / n.sum(), 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [x + y for x, y in zip(pools[-1], last, strict=True)]
    chance = np.clip(np.concatenate([np.full(int(k), a / b) for a, b, k in pools]), 0.005, 0.995)
    x = np.column_stack([centre[some] / n[some], np.ones(len(some))])
    w = training.soft_logistic(x, chance, n[some] / n.sum())
    return (float(w[0]), float(w[1])) if w[0] > 0 else (1.0, 0.0)


def measured(docs: DataFrame) -> DataFrame:
    """A record (doc_id, record) of every document, as a written table."""
    return shared.written(docs.mapInArrow(_record_batches, "doc_id long, record binary"), "quality-records")


def fit(table: DataFrame, labels: DataFrame) -> tuple[list[np.ndarray], np.ndarray]:
    """Cuts of the measures and weights, fitted to the records of all documents and to good learning rows."""
    ids = training.learning_rows(labels, "quality").where("y = 1").select("doc_id")
    ids = shared.written(ids.orderBy(F.xxhash64("doc_id", F.lit("quality")), "doc_id").limit(training.SAMPLE), "quality-ids")
    rows = table.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "record").limit(training.SAMPLE).select("record").collect()
    times = np.zeros((len(TOP), FINE), np.int64)
    for r in table.mapInArrow(_histogram_batches, "place long, times long").groupBy("place").agg(F.sum("times").alias("times")).collect():
        times[r["place"] // FINE, r["place"] % FINE] = r["times"]
    if not rows or not times.any():
        return [np.zeros(0)] * len(TOP), np.zeros(len(TOP) + BUCKETS + 1)
    cuts = []
    for t in times:
        share = np.cumsum(t) / t.sum()
        cuts.append(np.unique(np.searchsorted(share, np.linspace(0, 1, STEPS + 1)[1:-1]) + 1))
    p = inputs(_stacked([bytes(r["record"]) for r in rows]), cuts).astype(np.float64)

    def sums(w: np.ndarray):
        return _sums(table, cuts, w)

    def seen(w: np.ndarray) -> np.ndarray:
        out = np.zeros(FINE, np.int64)
        for r in table.mapInArrow(_sum_histogram(cuts, w), "place long, times long").groupBy("place").agg(F.sum("times").alias("times")).collect():
            out[r["place"]] = r["times"]
        return out

    # the prior is estimated with a model that takes half of the unlabelled for good, which orders them as well
    makes, tells = p[: (len(p) + 1) // 2], p[len(p) // 2 :]
    first = fit_nnpu(makes, sums, 0.5, np.zeros(p.shape[1]))
    prior = class_prior(tells @ first, seen(first))
    w = fit_nnpu(makes, sums, prior, first)
    scale, shift = calibration(tells @ w, seen(w), prior)
    w = w * scale
    w[-1] += shift
    return cuts, w


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Score documents (doc_id, text) with a model of labels (doc_id, quality).

    Returns doc_id, held_out, score (0 to 1), predicted (score >= 0.3), a row for every input row. The model is fitted on
    at most training.SAMPLE good learning rows and on all documents; whole texts are measured. A null or wordless text
    has the measures of no words; without positives every score is 0.5. Rows without doc_id are scored and not held out;
    rows that repeat a doc_id are documents each. Other columns are ignored.
    """
    table = measured(_plain(docs))
    cuts, w = fit(table, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = np.concatenate([np.zeros(0)] + [_chance(x @ w) for x in _parts(b, cuts)])
            yield pa.record_batch([b.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    scored = table.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", training.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs whose score is at least `least`, all columns as they are, by the model and rules of score_quality.

    Without positives all rows stay (their score is 0.5); a null or empty text is judged by the measures of no words;
    repeated rows are judged each, alike; an empty table gives an empty one. Clashing columns do not matter.
    """
    cuts, w = fit(measured(_plain(docs)), labels)
    bar = np.log(least / (1 - least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = np.concatenate([np.zeros(0)] + [inputs(r, cuts) @ w for r in records(b.column("text"))])
            yield b.filter(pa.array(z >= bar))

    return docs.mapInArrow(run, docs.schema)
