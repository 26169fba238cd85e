"""Steps of a raster build beside the fill: drawn area, lakes, Mercator warps, previews, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from isoterra.operators import joins
from isoterra.operators.raster import SPHERE

#: Colours of what the first pass did not reach, by its class.
UNREACHED = {1: (200, 30, 30, 150), 2: (230, 120, 20, 140), 3: (235, 200, 40, 130)}


def drawn_area(cell: DataFrame, envelope: DataFrame, size: int = 256) -> DataFrame:
    """row, col, drawn: whether a cell lies in any envelope (r0, r1, c0, c1, ends exclusive). Cells and envelopes meet by
    blocks of cells, so that no envelope is tested against all."""
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor((F.col(b) - 1) / size)))
    e = envelope.where("r0 < r1 AND c0 < c1").select("r0", "r1", "c0", "c1").withColumn("_y", span("r0", "r1")).withColumn("_x", span("c0", "c1"))
    c = cell.select("row", "col", F.floor(F.col("row") / size).alias("_y"), F.floor(F.col("col") / size).alias("_x"))
    hit = c.join(e, ["_y", "_x"]).where("row >= r0 AND row < r1 AND col >= c0 AND col < c1").select("row", "col").distinct()
    return cell.select("row", "col").join(hit.withColumn("drawn", F.lit(True)), ["row", "col"], "left").na.fill(False, ["drawn"])


def lake_cells(cell: DataFrame, edges: DataFrame, levels: DataFrame, frame: tuple[float, float, float]) -> DataFrame:
    """row, col, ele, ring_id of cells whose centre lies in a lake (edges: ring_id, ax, ay, bx, by; levels: ring_id, ele) by
    the even-odd rule. frame: west and north end of the raster, size of a cell."""
    west, north, size = frame
    centre = cell.select(F.struct("row", "col").alias("point_id"), (west + (F.col("col") + 0.5) * size).alias("x"), (north - (F.col("row") + 0.5) * size).alias("y"))
    inside = joins.inside_rings(centre, edges, size * 64)
    return inside.join(levels.where("ele IS NOT NULL"), "ring_id").select("point_id.row", "point_id.col", "ele", "ring_id")


def clamp_patch(patch: DataFrame, burned: DataFrame, kept: DataFrame) -> DataFrame:
    """row, col, v of a patch (row, col, v) of a new surface: at least 1 m, 0 where the surface kept (row, col, v) is 0, and
    what was burned (row, col, v) as it is."""
    p = patch.join(kept.select("row", "col", F.col("v").alias("_k")), ["row", "col"], "left").join(burned.select("row", "col", F.col("v").alias("_b")), ["row", "col"], "left")
    v = F.coalesce(F.col("_b").cast("double"), F.when(F.col("_k") == 0, 0.0), F.greatest(F.col("v"), F.lit(1.0)))
    return p.select("row", "col", v.alias("v"))


def preview_radii(radius: int, removing: bool = False, cover: int | None = None, slack: int | None = None) -> tuple[int, int]:
    """Cells round an edit that are solved anew, and cells of clearance round those: a radius each, twice for the first if a
    contour was removed."""
    return (radius * (2 if removing else 1) if cover is None else cover), (radius if slack is None else slack)


def unreached_colour(cell: DataFrame, one_level: bool = False) -> DataFrame:
    """row, col, r, g, b, a of first-pass classes; what sees one level only is clear unless asked for."""
    c = F.col("class")
    shown = {k: v for k, v in UNREACHED.items() if k != 3 or one_level}
    out = []
    for i, name in enumerate("rgba"):
        value = F.lit(0)
        for k, colour in shown.items():
            value = F.when(c == k, colour[i]).otherwise(value)
        out.append(value.alias(name))
    return cell.select("row", "col", *out)


def mercator_lon(x: Column) -> Column:
    return F.degrees(x / SPHERE)


def mercator_lat(y: Column) -> Column:
    return F.degrees(F.atan(F.sinh(y / SPHERE)))


def warp(cell: DataFrame, frame: tuple[float, float, float], target: DataFrame, to: tuple[float, float, float], nearest: bool = False) -> DataFrame:
    """row, col, v of the cells of target (row, col) of a Mercator raster, from a raster in degrees. frame and to: west, north
    and size of a cell.

    Bilinear between the four cells around a centre, by the weights of those that have a value; or the cell that holds it.
    Null where there is none."""
    (x0, y0, size), (u0, v0, step) = frame, to
    lon, lat = mercator_lon(F.lit(u0) + (F.col("col") + 0.5) * step), mercator_lat(F.lit(v0) - (F.col("row") + 0.5) * step)
    at = target.select("row", "col", ((lon - x0) / size).alias("_x"), ((F.lit(y0) - lat) / size).alias("_y"))
    source = cell.select(F.col("row").cast("long").alias("_r"), F.col("col").cast("long").alias("_c"), "v").where("v IS NOT NULL")
    if nearest:
        return at.withColumn("_r", F.floor("_y")).withColumn("_c", F.floor("_x")).join(source, ["_r", "_c"], "left").select("row", "col", "v")
    fx, fy = F.col("_x") - 0.5, F.col("_y") - 0.5
    corner = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1))))
    each = at.withColumn("_k", corner).withColumn("_r", F.floor(fy) + F.col("_k.i")).withColumn("_c", F.floor(fx) + F.col("_k.j"))
    weight = (1 - F.abs(fy - F.col("_r"))) * (1 - F.abs(fx - F.col("_c")))
    got = each.withColumn("_w", weight).join(source, ["_r", "_c"]).where("_w > 0").groupBy("row", "col").agg((F.sum(F.col("_w") * F.col("v")) / F.sum("_w")).alias("v"))
    return target.select("row", "col").join(got, ["row", "col"], "left")
