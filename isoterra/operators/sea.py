"""The sea mask: seeds off both sides of a coastline, and which of them a cell is nearer to. All in raster space: x is a
column, y a row, rows grow to the south."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from isoterra.operators import joins, raster

#: Cells from a coastline to its seeds, cells from a seed that it speaks for, cells between lake seeds.
STEP, REACH, LAKE_STEP = 2.5, 120, 2


def coast_seeds(coast: DataFrame) -> DataFrame:
    """row, col, kind (land or water) of seeds beside the middle of every segment (segment_id, ax, ay, bx, by; land on the
    left). A seed that a step across any other coastline reaches, an odd number of times, is none; nor has a segment
    without length any."""
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    length = F.hypot(dx, dy)
    mid = coast.where("ax <> bx OR ay <> by").select("segment_id", ((F.col("ax") + F.col("bx")) / 2).alias("mx"), ((F.col("ay") + F.col("by")) / 2).alias("my"), (dy / length).alias("nx"), (-dx / length).alias("ny"))
    side = F.explode(F.array(F.struct(F.lit("land").alias("kind"), F.lit(1.0).alias("s")), F.struct(F.lit("water").alias("kind"), F.lit(-1.0).alias("s"))))
    step = mid.withColumn("_s", side).select(
        F.struct("segment_id", F.col("_s.kind").alias("kind")).alias("step_id"), F.col("mx").alias("ax"), F.col("my").alias("ay"),
        (F.col("mx") + F.col("nx") * F.col("_s.s") * STEP).alias("bx"), (F.col("my") + F.col("ny") * F.col("_s.s") * STEP).alias("by"),
    )
    # the step begins on its own segment, which the half-open test meets or not: it is left out
    own = coast.select(F.col("segment_id").alias("way_id"), "ax", "ay", "bx", "by")
    across = joins.odd_crossings(step, own, 16.0, own=F.col("step_id.segment_id"))
    good = step.join(across, "step_id", "left_anti")
    cut = lambda c: F.when(F.col(c) >= 0, F.floor(c)).otherwise(F.ceil(c)).cast("int")
    return good.select(cut("by").alias("row"), cut("bx").alias("col"), F.col("step_id.kind").alias("kind"))


def lake_seeds(inside: DataFrame) -> DataFrame:
    """row, col of every LAKE_STEP-th cell of a body's cells, along rows and columns."""
    return inside.where(F.pmod("row", F.lit(LAKE_STEP)).eqNullSafe(0) & F.pmod("col", F.lit(LAKE_STEP)).eqNullSafe(0)).select("row", "col")


def water_mask(cell: DataFrame, water: DataFrame, land: DataFrame, dry: DataFrame | None = None, shore: DataFrame | None = None, reach: int = REACH) -> DataFrame:
    """row, col, water, dry of the cells: water where a water seed is within reach and nearer than any land seed; dry where
    a dry seed is within reach and nearer than water (a water seed or, if given, a shore seed). A dry cell's dry seed counts
    as land; one that lost to the water keeps no cell out of it."""
    def far(seeds: DataFrame | None, name: str) -> DataFrame:
        none = cell.select("row", "col").withColumn(name, F.lit(None).cast("long"))
        return none if seeds is None else raster.nearest_seed(cell, seeds, reach + 1).select("row", "col", F.col("d2").cast("long").alias(name))

    c = cell.select("row", "col")
    for name, seeds in (("w", water), ("l", land), ("d", dry), ("s", shore)):
        c = c.join(far(seeds, name), ["row", "col"]) if seeds is not None else c.withColumn(name, F.lit(None).cast("long"))
    none, most = F.lit(1 << 62), reach * reach
    w, land_, d = (F.coalesce(n, none) for n in ("w", "l", "d"))
    is_dry = (d < F.least(w, F.coalesce("s", none))) & (d <= most)
    near_land = F.when(is_dry, F.least(land_, d)).otherwise(land_)
    return c.select("row", "col", ((w < near_land) & (w <= most)).alias("water"), is_dry.alias("dry"))
