"""Territories under boxes, by their exact share, and who may edit there."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Fixed value: the share of a box from which a territory is under it.
LEAST = 1e-5


def clipped(x: np.ndarray, y: np.ndarray, box: tuple[float, float, float, float]) -> float:
    """Signed area of a ring inside a box (west, south, east, north): each side of the box cuts off what lies beyond it."""
    for axis, bound, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        if not len(x):
            return 0.0
        here = (x, y)[axis]
        inside = sign * (here - bound) >= 0
        nx, ny, after = np.roll(x, -1), np.roll(y, -1), np.roll(inside, -1)
        there = (nx, ny)[axis]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.where(inside != after, (bound - here) / (there - here), 0.0)
        cut = np.stack([x + (nx - x) * t, y + (ny - y) * t], 1)
        cut[:, axis] = bound
        # each side of the ring gives its inner end and, where it leaves or enters, the cut
        points = np.stack([np.stack([x, y], 1), cut], 1)
        points = points[np.stack([inside, inside != after], 1)]
        x, y = points[:, 0], points[:, 1]
    return float(x @ np.roll(y, -1) - y @ np.roll(x, -1)) / 2 if len(x) else 0.0


def shares(box: DataFrame, ring: DataFrame) -> DataFrame:
    """box_id, rel, share of boxes (box_id, west, south, east, north) that lie in territories (ring: rel, ring, lons, lats),
    if over LEAST of the box. A hole takes off what it covers; which rings are holes is told by nesting, as their
    areas' sign is not: the largest ring of a territory counts, and each ring inside an odd number of others is taken off."""
    r = ring.select("rel", "ring", "lons", "lats", F.array_min("lons").alias("x0"), F.array_max("lons").alias("x1"), F.array_min("lats").alias("y0"), F.array_max("lats").alias("y1"))
    degrees = lambda a, b: F.explode(F.sequence(F.floor(F.col(a)), F.floor(F.col(b))))
    # boxes and rings meet by the degree rows that they touch, then by their own boxes
    b = box.withColumn("_d", degrees("south", "north"))
    met = b.join(r.withColumn("_d", degrees("y0", "y1")), "_d").where("x0 < east AND x1 > west AND y0 < north AND y1 > south").dropDuplicates(["box_id", "rel", "ring"])
    met = met.select("box_id", "west", "south", "east", "north", "rel", "ring", "lons", "lats")
    own = ring.select("rel", F.col("ring").alias("_o"), F.col("lons").alias("_x"), F.col("lats").alias("_y"))
    first = met.select("rel", "ring", F.col("lons")[0].alias("px"), F.col("lats")[0].alias("py")).distinct()
    depth = first.join(own, "rel").where("ring <> _o")

    def hold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            inside = []
            for px, py, xs, ys in zip(t["px"], t["py"], t["_x"], t["_y"], strict=True):
                ax, ay = np.asarray(xs, float), np.asarray(ys, float)
                bx, by = np.roll(ax, -1), np.roll(ay, -1)
                with np.errstate(divide="ignore", invalid="ignore"):
                    inside.append(int((((ay > py) != (by > py)) & (px < ax + (py - ay) * (bx - ax) / (by - ay))).sum() % 2))
            yield pd.DataFrame({"rel": t["rel"], "ring": t["ring"], "inside": inside})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for t in batches:
            area = [abs(clipped(np.asarray(xs, float), np.asarray(ys, float), (w, s, e, n))) / ((e - w) * (n - s)) for xs, ys, w, s, e, n in zip(t["lons"], t["lats"], t["west"], t["south"], t["east"], t["north"], strict=True)]
            yield pd.DataFrame({"box_id": t["box_id"], "rel": t["rel"], "ring": t["ring"], "area": area})

    hole = depth.select("rel", "ring", "px", "py", "_x", "_y").mapInPandas(hold, "rel long, ring int, inside int").groupBy("rel", "ring").agg((F.sum("inside") % 2).alias("hole"))
    part = met.mapInPandas(cut, f"box_id {dict(box.dtypes)['box_id']}, rel long, ring int, area double").join(hole, ["rel", "ring"], "left")
    total = part.groupBy("box_id", "rel").agg(F.sum(F.col("area") * F.when(F.col("hole") == 1, -1).otherwise(1)).alias("share"))
    return total.where(F.col("share") > LEAST)


def under(box: DataFrame, ring: DataFrame, attribute: DataFrame) -> DataFrame:
    """shares with status, owner, editors of the territories (attribute: rel, status, owner, editors), unknown ones kept, those
    that only outline others left out, and place: the one under the box's centre first, then by share, then by rel."""
    from pyspark.sql import Window

    from isoterra.operators import joins

    edge = ring.select("rel", "ring", F.posexplode("lons").alias("i", "ax"), "lons", "lats")
    nxt = (F.col("i") + 1) % F.size("lons")
    edge = edge.select(F.col("rel").alias("ring_id"), "ax", F.col("lats")[F.col("i")].alias("ay"), F.col("lons")[nxt].alias("bx"), F.col("lats")[nxt].alias("by"))
    centre = box.select(F.col("box_id").alias("point_id"), ((F.col("west") + F.col("east")) / 2).alias("x"), ((F.col("south") + F.col("north")) / 2).alias("y"))
    held = joins.inside_rings(centre, edge, 1.0).select(F.col("point_id").alias("box_id"), F.col("ring_id").alias("rel"), F.lit(True).alias("centre"))
    s = shares(box, ring).join(attribute, "rel", "left").where("status IS NULL OR status <> 'outline'").join(held, ["box_id", "rel"], "left").na.fill(False, ["centre"])
    order = Window.partitionBy("box_id").orderBy(F.desc("centre"), F.desc("share"), "rel")
    return s.withColumn("place", F.row_number().over(order))


def permission(box: DataFrame, found: DataFrame, user: str) -> DataFrame:
    """box_id, level of boxes for a user: yes where all territories under one (found: of under) are theirs to edit, partial
    where some are, no where none is or there is none."""
    mine = F.coalesce(F.array_contains("editors", user), F.lit(False)) & F.lit(bool(user))
    g = found.groupBy("box_id").agg(F.count_if(mine).alias("m"), F.count("*").alias("n"))
    level = F.when(F.coalesce("m", F.lit(0)) == 0, "no").when(F.col("m") < F.col("n"), "partial").otherwise("yes")
    return box.select("box_id").join(g, "box_id", "left").select("box_id", level.alias("level"))
