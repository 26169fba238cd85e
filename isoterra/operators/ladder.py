"""Ladders: the regular levels of a square's contours, inferred from those drawn."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F


def levels(line: DataFrame, key: str) -> DataFrame:
    return line.groupBy(key, "ele").agg(F.countDistinct("way_id").alias("ways"))


#: Notches that a ladder has above the highest level drawn; the ladder where nothing tells one.
ABOVE, DEFAULT_INTERVAL, DEFAULT_TOP = 4, 10.0, 200.0


def infer(found: DataFrame, key: str) -> DataFrame:
    """key, interval, phase of levels (key, ele, ways): the gap most often between neighbouring levels, of equals the one
    whose ends carry more ways, then the wider; then the remainder that carries most ways, of equals the lower. A key
    without two levels has no row."""
    w = Window.partitionBy(key).orderBy("ele")
    gaps = found.withColumn("gap", F.bround(F.lead("ele").over(w) - F.col("ele"), 6)).withColumn("weight", F.lead("ways").over(w) + F.col("ways")).where("gap > 0")
    by_gap = gaps.groupBy(key, "gap").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))
    interval = by_gap.groupBy(key).agg(F.max_by("gap", F.struct("n", "weight", "gap")).alias("interval"))
    phases = found.join(interval, key).groupBy(key, "interval", F.bround(F.pmod("ele", F.col("interval")), 6).alias("phase")).agg(F.sum("ways").alias("n"))
    return phases.groupBy(key, "interval").agg(F.max_by("phase", F.struct("n", -F.col("phase"))).alias("phase"))


def on_phase(v: Column, interval: Column, phase: Column) -> Column:
    r = F.pmod(v - phase, interval)
    return F.least(r, interval - r) < 1e-6


def inferred(found: DataFrame, key: str) -> DataFrame:
    """key, interval, phase, notches, present: infer's ladder with the levels drawn, the holes of the regular ones filled,
    ABOVE notches more above them, those down to sea level, and 0."""
    held = found.join(infer(found, key), key)
    regular = F.when(on_phase(F.col("ele"), F.col("interval"), F.col("phase")), F.col("ele"))
    g = held.groupBy(key, "interval", "phase").agg(F.array_sort(F.collect_set("ele")).alias("present"), F.min(regular).alias("_low"), F.max(regular).alias("_high"))
    down, up = F.floor((F.col("_low") + 1e-9) / F.col("interval")), F.rint((F.col("_high") - F.col("_low")) / F.col("interval")) + ABOVE
    run = F.transform(F.sequence(-F.greatest(down, F.lit(0)), up.cast("long")), lambda i: F.bround(F.col("_low") + i * F.col("interval"), 6))
    notches = F.array_sort(F.array_distinct(F.concat("present", F.coalesce(run, F.array().cast("array<double>")), F.array(F.lit(0.0)))))
    return g.select(key, "interval", "phase", notches.alias("notches"), "present")


def regular(interval: Column, base: Column, top: Column) -> Column:
    """Notches on base's phase, from the one at or below sea level up to top; none where top lies below."""
    phase = F.pmod(base, interval)
    first = F.when(phase > 0, phase - interval).otherwise(phase * 0)
    n = F.floor((top - first + 1e-9) / interval)
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n.cast("int")), lambda i: first + i * interval)).otherwise(F.array().cast("array<double>"))


def ladder_for(keys: DataFrame, overrides: DataFrame, found: DataFrame, zone: DataFrame, key: str) -> DataFrame:
    """key, interval, phase, notches, source of every key (keys: key, zone): the override of the square (key, interval,
    phase, notches), else what its levels say, else the zone's default (zone, interval, base, top), else every
    DEFAULT_INTERVAL to DEFAULT_TOP."""
    o = overrides.select(key, F.struct("interval", "phase", "notches").alias("_o"))
    i = inferred(found, key).select(key, F.struct("interval", "phase", "notches").alias("_i"))
    top = F.coalesce(F.col("top"), F.col("base") + 20 * F.col("interval"))
    z = zone.select("zone", F.struct("interval", F.pmod("base", F.col("interval")).alias("phase"), regular(F.col("interval"), F.col("base"), top).alias("notches")).alias("_z"))
    least = F.struct(F.lit(DEFAULT_INTERVAL).alias("interval"), F.lit(0.0).alias("phase"), regular(F.lit(DEFAULT_INTERVAL), F.lit(0.0), F.lit(DEFAULT_TOP)).alias("notches"))
    j = keys.join(o, key, "left").join(i, key, "left").join(z, "zone", "left")
    source = F.when(F.col("_o").isNotNull(), "square").when(F.col("_i").isNotNull(), "inferred").when(F.col("_z").isNotNull(), "zone").otherwise("default")
    return j.withColumn("_l", F.coalesce("_o", "_i", "_z", least)).select(key, "_l.interval", "_l.phase", "_l.notches", source.alias("source"))


def off_ladder(found: DataFrame, ladder: DataFrame, key: str, most: int = 2) -> DataFrame:
    """Levels used by at most `most` ways that are off the ladder's phase, with the levels drawn below and above."""
    w = Window.partitionBy(key).orderBy("ele")
    held = found.withColumn("below", F.lag("ele").over(w)).withColumn("above", F.lead("ele").over(w)).join(ladder, key)
    return held.where((F.col("ways") <= most) & ~on_phase(F.col("ele"), F.col("interval"), F.col("phase"))).select(key, "ele", "ways", "below", "above")


def covering(v: Column, notches: Column, interval: Column) -> Column:
    """The notches with v among them: rungs are laid at the interval from the end that it lies beyond, not past it."""
    low, high = F.array_min(notches), F.array_max(notches)
    up = F.when(v > high, F.floor((v - high - 1e-9) / interval)).otherwise(F.floor((low - v - 1e-9) / interval)).cast("int")
    start, step = F.when(v > high, high).otherwise(low), F.when(v > high, interval).otherwise(-interval)
    rungs = F.when((up >= 1) & interval.isNotNull(), F.transform(F.sequence(F.lit(1), F.greatest(up, F.lit(1))), lambda i: start + i * step)).otherwise(F.array().cast("array<double>"))
    has = F.exists(notches, lambda n: F.abs(n - v) < 1e-9)
    return F.when(has, notches).otherwise(F.array_sort(F.array_distinct(F.concat(notches, rungs, F.array(v.cast("double"))))))


#: Of a level band: a step, and, except in the last band, the level it goes to.
BAND = r"^\s*(\d+(\.\d+)?)(:(\d+(\.\d+)?))?\s*$"


def level_bands(spec: str) -> list[tuple[float, float | None]]:
    """(step, top) of each band of a text such as 10:50,25:200,50; the last has no top and all others have rising ones."""
    bands = []
    for part in spec.split(","):
        m = re.match(BAND, part)
        if m is None or float(m[1]) <= 0:
            raise ValueError(f"{part!r}: no band with a positive step")
        bands.append((float(m[1]), float(m[4]) if m[4] else None))
    tops = [t for _, t in bands]
    if tops[-1] is not None or None in tops[:-1] or any(a >= b for a, b in zip(tops, tops[1:-1], strict=False)):
        raise ValueError(f"{spec!r}: rising tops in all bands but the last, which has none")
    return bands


def band_levels(bands: list[tuple[float, float | None]], high: Column) -> Column:
    """0 and the levels of the bands up to `high`; a band begins above the one before."""
    def run(first: Column, last: Column, step: float) -> Column:
        return F.when(last >= first, F.transform(F.sequence(first, F.greatest(first, last)), lambda k: k * step)).otherwise(F.array().cast("array<double>"))

    parts, at = [F.array(F.lit(0.0))], F.lit(0.0)
    for step, top in bands:
        end = high if top is None else F.least(F.lit(top), high)
        parts.append(run(F.floor(at / step) + 1, F.floor((end + 1e-9) / step), step))
        at = F.greatest(at, end)
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def around(v: Column, notches: Column) -> Column:
    """struct of the notch below, above and nearest to v (the lower of equals)."""
    return F.struct(
        F.array_max(F.filter(notches, lambda x: x < v - 1e-9)).alias("below"), F.array_min(F.filter(notches, lambda x: x > v + 1e-9)).alias("above"),
        F.element_at(F.array_sort(F.transform(notches, lambda x: F.struct(F.abs(x - v).alias("d"), x.alias("x")))), 1)["x"].alias("nearest"),
    )
