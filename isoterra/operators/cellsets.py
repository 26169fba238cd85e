"""Sets of cells: covers by rectangles, strips, outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def rectangles(cell: DataFrame) -> DataFrame:
    """r0, r1, c0, c1 (all included): runs along rows, and equal runs of rows that follow each other."""
    along = Window.partitionBy("row").orderBy("col")
    runs = cell.select("row", "col").distinct().withColumn("_k", F.col("col") - F.row_number().over(along)).groupBy("row", "_k").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
    down = Window.partitionBy("c0", "c1").orderBy("row")
    return runs.withColumn("_g", F.col("row") - F.row_number().over(down)).groupBy("c0", "c1", "_g").agg(F.min("row").alias("r0"), F.max("row").alias("r1")).select("r0", "r1", "c0", "c1")


def outline(cell: DataFrame) -> DataFrame:
    """row, col, side of the sides of cells that have no neighbour."""
    own = cell.select("row", "col").distinct()
    side = F.explode(F.array(*(F.struct(F.lit(n).alias("side"), F.lit(r).alias("r"), F.lit(c).alias("c")) for n, r, c in (("n", -1, 0), ("s", 1, 0), ("w", 0, -1), ("e", 0, 1)))))
    s = own.withColumn("_s", side).select("row", "col", F.col("_s.side").alias("side"), (F.col("row") + F.col("_s.r")).alias("_r"), (F.col("col") + F.col("_s.c")).alias("_c"))
    return s.join(own.toDF("_r", "_c"), ["_r", "_c"], "left_anti").select("row", "col", "side")


def strips(rows: int, row_bytes: int, most: int = 64 << 20) -> list[tuple[int, int]]:
    """Row ranges of a raster within so many bytes, at least a row each."""
    step = max(1, most // max(1, row_bytes))
    return [(a, min(rows, a + step)) for a in range(0, rows, step)]


def close_edges(mask: DataFrame, shape: tuple[int, int], frame: tuple[float, float, float], bounds: tuple[int, int, int, int], beyond: DataFrame) -> DataFrame:
    """mask (row, col, v of 0 and 1) with its edge cells closed (0) or open, as the degree square across them is not, or is,
    one of beyond (lon, lat). An open edge cell is drawn if it or the cell inside it is; a corner is closed by either side.

    frame is the west and north end of the raster and a cell's size in degrees, bounds its degrees (west, south, east,
    north); edge cells lie on the degree lines, and count for the degrees inside them."""
    (rows, cols), (x0, y0, size), (west, south, east, north) = shape, frame, bounds
    lat = F.least(F.greatest(F.floor(F.lit(y0) - (F.col("row") + 0.5) * size), F.lit(south)), F.lit(north - 1)).cast("int")
    lon = F.least(F.greatest(F.floor(F.lit(x0) + (F.col("col") + 0.5) * size), F.lit(west)), F.lit(east - 1)).cast("int")

    def side(on, lon_across, lat_across, row, col):
        return F.when(on, F.struct(lon_across.cast("int").alias("lon"), lat_across.cast("int").alias("lat"), row.cast("int").alias("row"), col.cast("int").alias("col")))

    row, col = F.col("row"), F.col("col")
    sides = F.array_compact(F.array(
        side(col == 0, F.lit(west - 1), lat, row, F.lit(min(1, cols - 1))), side(col == cols - 1, F.lit(east), lat, row, F.lit(max(cols - 2, 0))),
        side(row == 0, lon, F.lit(north), F.lit(min(1, rows - 1)), col), side(row == rows - 1, lon, F.lit(south - 1), F.lit(max(rows - 2, 0)), col),
    ))
    edge = (row == 0) | (col == 0) | (row == rows - 1) | (col == cols - 1)
    each = mask.where(edge).select("row", "col", "v", F.explode(sides).alias("s"))
    drawn = mask.select(F.col("row").alias("_r"), F.col("col").alias("_c"), F.col("v").alias("_v"))
    each = each.join(drawn, (F.col("s.row") == F.col("_r")) & (F.col("s.col") == F.col("_c")), "left")
    held = beyond.select(F.col("lon").alias("_x"), F.col("lat").alias("_y")).distinct().withColumn("_in", F.lit(True))
    each = each.join(held, (F.col("s.lon") == F.col("_x")) & (F.col("s.lat") == F.col("_y")), "left")
    opened = F.max(F.when(F.col("_in"), F.col("_v")))
    new = each.groupBy("row", "col", "v").agg(F.bool_or(F.col("_in").isNull()).alias("_closed"), opened.alias("_open"))
    new = new.select("row", "col", F.when(F.col("_closed"), 0).otherwise(F.greatest("v", F.coalesce("_open", F.lit(0)))).cast(mask.schema["v"].dataType).alias("v"))
    return mask.where(~edge).select("row", "col", "v").union(new)
