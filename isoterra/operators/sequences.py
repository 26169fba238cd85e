"""Operators along a line: segments, distances, islands, grading, cutting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from isoterra.operators import graph


def segments(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, ax, ay, bx, by of consecutive points (keys, seq, x, y) of a way."""
    w = Window.partitionBy(keys[0]).orderBy("seq")
    out = points.withColumn("bx", F.lead("x").over(w)).withColumn("by", F.lead("y").over(w)).where("bx IS NOT NULL")
    return out.select(*keys, "seq", F.col("x").alias("ax"), F.col("y").alias("ay"), "bx", "by")


def distance_along(points: DataFrame, key: str) -> DataFrame:
    """points with step (from the point before) and d (from the start)."""
    w = Window.partitionBy(key).orderBy("seq")
    step = F.coalesce(F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)), F.lit(0.0))
    return points.withColumn("step", step).withColumn("d", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def islands(rows: DataFrame, key: list[str], order: str, flag: Column) -> DataFrame:
    """key, first, last, n of each run of consecutive rows for which flag holds."""
    w = Window.partitionBy(*key).orderBy(order)
    held = rows.withColumn("_at", F.row_number().over(w)).where(flag)
    held = held.withColumn("_run", F.col("_at") - F.row_number().over(w))
    return held.groupBy(*key, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def climbing_intervals(profile: DataFrame, key: str) -> DataFrame:
    """Runs of a downstream profile (key, seq, z) that lie above the lowest point before; NaN is passed over."""
    w = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    z = F.when(~F.isnan("z"), F.col("z"))
    low = profile.withColumn("_low", F.min(z).over(w))
    return islands(low, [key], "seq", (~F.isnan("z")) & (F.col("z") > F.col("_low")))


def grade_between(known: DataFrame, vertices: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Levels of vertices (key, seq, d) between known points (key, d, ele) of a river, and the spans rejected.

    The higher end of the known points is upstream; a span that climbs downstream is rejected and gives no level. Each
    vertex takes the level of the last span that holds it, linear between the span's ends."""
    w = Window.partitionBy(key).orderBy("d")
    ends = known.groupBy(key).agg(F.min_by("ele", "d").alias("_a"), F.max_by("ele", "d").alias("_b"))
    spans = known.join(ends, key).withColumn("d1", F.lead("d").over(w)).withColumn("e1", F.lead("ele").over(w)).where("d1 IS NOT NULL")
    spans = spans.withColumn("climbs", F.when(F.col("_a") < F.col("_b"), F.col("ele") > F.col("e1")).otherwise(F.col("e1") > F.col("ele")))
    spans = spans.select(key, F.col("d").alias("d0"), F.col("ele").alias("e0"), "d1", "e1", "climbs")
    good = spans.where("NOT climbs")
    held = vertices.join(good, key).where("d >= d0 AND d <= d1")
    level = F.when(F.col("d1") == F.col("d0"), F.col("e1")).otherwise(F.col("e0") + (F.col("e1") - F.col("e0")) * (F.col("d") - F.col("d0")) / (F.col("d1") - F.col("d0")))
    graded = held.groupBy(key, "seq").agg(F.max_by(level, "d0").alias("level"))
    return vertices.join(graded, [key, "seq"], "left"), spans.where("climbs").drop("climbs")


def densify(segs: DataFrame, step: float, up: bool = False) -> DataFrame:
    """Points of lines cut into steps: i of k on every segment, where k is the whole part of length / step (or the next
    whole number, `up`), and at least 1; and the first point of each way, i = 0 of its first segment."""
    n = F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")) / step
    k = F.greatest(F.lit(1), (F.ceil(n) if up else F.floor(n)).cast("int"))
    start = F.when(F.col("seq") == F.min("seq").over(Window.partitionBy("way_id")), 0).otherwise(1)
    each = segs.withColumn("k", k).withColumn("_from", start).withColumn("i", F.explode(F.sequence("_from", F.col("k")))).drop("_from")
    t = F.col("i") / F.col("k")
    return each.withColumn("x", F.col("ax") + (F.col("bx") - F.col("ax")) * t).withColumn("y", F.col("ay") + (F.col("by") - F.col("ay")) * t)


def even_cuts(n: Column, limit: int) -> Column:
    """Places at which a way of n nodes is cut into the fewest pieces of at most `limit` nodes that share their ends."""
    pieces = F.ceil((n - 1) / F.lit(limit - 1)).cast("int")
    inner = F.expr("cast(array() as array<int>)")
    return F.when(pieces <= 1, inner).otherwise(F.transform(F.sequence(F.lit(1), pieces - 1), lambda i: F.floor(i * (n - 1) / pieces).cast("int")))


def split_ways(way_node: DataFrame, limit: int) -> DataFrame:
    """way_id, seq, node_id, piece: pieces of at most `limit` nodes; the node at a cut is in both."""
    sizes = way_node.groupBy("way_id").agg(F.count("*").cast("int").alias("_n"))
    cuts = sizes.withColumn("_cuts", even_cuts(F.col("_n"), limit))
    at = F.size(F.filter("_cuts", lambda c: c < F.col("seq")))
    double = F.array_contains("_cuts", F.col("seq").cast("int"))
    both = F.explode(F.when(double, F.array(at, at + 1)).otherwise(F.array(at)))
    return way_node.join(cuts, "way_id").select("way_id", "seq", "node_id", both.alias("piece"))


def contour_pieces(points: DataFrame, limit: int = 2000, first_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """Ways of at most `limit` nodes of contours (line_id, seq from 0, ele, lon, lat), and their nodes, with ids from first_id
    on: node (node_id, lon, lat) and way (way_id, ele to the metre, refs). The place at a cut is the last node of a piece and
    the first of the next, each with an id of its own; ids rise with the line and its places. Lines of one point are none.

    Ids need the numbers of all before: they are counted by line, so that the running sum is over lines, by ranges."""
    step = limit - 1
    last = points.groupBy("line_id").agg(F.max("seq").alias("_last")).where("_last > 0")
    n = last.withColumn("pieces", F.ceil(F.col("_last") / step).cast("long")).withColumn("places", F.col("_last") + F.col("pieces"))
    part = graph._ready(n.repartitionByRange("line_id").withColumn("_p", F.spark_partition_id()))
    sums = part.groupBy("_p").agg(F.sum("pieces").alias("_a"), F.sum("places").alias("_b"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_p", F.coalesce(F.sum("_a").over(before), F.lit(0)).alias("_a"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b"))
    inner = Window.partitionBy("_p").orderBy("line_id").rowsBetween(Window.unboundedPreceding, -1)
    base = part.join(F.broadcast(sums), "_p").select(
        "line_id", "_last", (F.col("_a") + F.coalesce(F.sum("pieces").over(inner), F.lit(0))).alias("_way"), (F.col("_b") + F.coalesce(F.sum("places").over(inner), F.lit(0))).alias("_node")
    )
    at = F.floor(F.col("seq") / step)
    both = (F.col("seq") % step == 0) & (F.col("seq") > 0) & (F.col("seq") < F.col("_last"))
    at = F.when((F.col("seq") == F.col("_last")) & (F.col("seq") % step == 0), at - 1).otherwise(at)
    each = points.join(base, "line_id").withColumn("piece", F.explode(F.when(both, F.array(at - 1, at)).otherwise(F.array(at))))
    each = each.withColumn("node_id", first_id + F.col("_node") + F.col("seq") + F.col("piece"))
    node = each.select("node_id", "lon", "lat")
    way = each.groupBy((first_id + F.col("_way") + F.col("piece")).alias("way_id")).agg(F.first(F.rint("ele")).cast("long").alias("ele"), F.array_sort(F.collect_list("node_id")).alias("refs"))
    return node, way


def length_and_area(points: DataFrame, key: str) -> DataFrame:
    """key, length, signed area of the ring that closes the line."""
    w = Window.partitionBy(key).orderBy("seq")
    first = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = points.withColumn("_x", F.lead("x").over(w)).withColumn("_y", F.lead("y").over(w))
    p = p.withColumn("_cx", F.coalesce("_x", F.first("x").over(first))).withColumn("_cy", F.coalesce("_y", F.first("y").over(first)))
    return p.groupBy(key).agg(
        F.sum(F.coalesce(F.hypot(F.col("_x") - F.col("x"), F.col("_y") - F.col("y")), F.lit(0.0))).alias("length"),
        (F.sum(F.col("x") * F.col("_cy") - F.col("_cx") * F.col("y")) / 2).alias("area"),
    )


def as_of_levels(points: DataFrame, key: str) -> DataFrame:
    """Level at every point (key, seq, d, ele or null) between the nearest known points before and after, by distance."""
    w = Window.partitionBy(key).orderBy("seq")
    known = F.when(F.col("ele").isNotNull(), F.col("d"))
    back, on = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    p = (
        points.withColumn("e0", F.last("ele", True).over(back)).withColumn("d0", F.last(known, True).over(back))
        .withColumn("e1", F.first("ele", True).over(on)).withColumn("d1", F.first(known, True).over(on))
    )
    between = F.col("e0") + (F.col("e1") - F.col("e0")) * (F.col("d") - F.col("d0")) / (F.col("d1") - F.col("d0"))
    return p.withColumn("level", F.when(F.col("d0") == F.col("d1"), F.col("e0")).otherwise(between)).drop("e0", "d0", "e1", "d1")


def river_totals(profile: DataFrame, key: str) -> DataFrame:
    """key, up, down, irreducible (the lesser): metres that a profile (key, seq, z) climbs and falls."""
    w = Window.partitionBy(key).orderBy("seq")
    rise = F.col("z") - F.lag("z").over(w)
    p = profile.withColumn("_rise", rise)
    out = p.groupBy(key).agg(
        F.sum(F.when(F.col("_rise") > 0, F.col("_rise")).otherwise(0.0)).alias("up"), F.sum(F.when(F.col("_rise") < 0, -F.col("_rise")).otherwise(0.0)).alias("down")
    )
    return out.withColumn("irreducible", F.least("up", "down"))
