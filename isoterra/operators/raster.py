"""Operators over raster cells (row, col, value) in long form; neighbours by windows, distances and regions by joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from isoterra.functions import expressions as X


def _at(value: str, dr: int, dc: int) -> Column:
    """A cell's neighbour in a full raster, by one window along a row or a column; diagonals are composed."""
    if dr:
        return F.lag(value, -dr).over(Window.partitionBy("col").orderBy("row"))
    return F.lag(value, -dc).over(Window.partitionBy("row").orderBy("col"))


def neighbourhood(cell: DataFrame, value: str = "v") -> DataFrame:
    """cell with the eight values around: n, s, w, e, nw, ne, sw, se; null past the edge. The raster must be full."""
    c = cell.withColumn("n", _at(value, -1, 0)).withColumn("s", _at(value, 1, 0))
    for name, of, dc in (("w", value, -1), ("e", value, 1), ("nw", "n", -1), ("ne", "n", 1), ("sw", "s", -1), ("se", "s", 1)):
        c = c.withColumn(name, _at(of, 0, dc))
    return c


#: Fixed value: radius of the sphere of the Mercator projection, in metres.
SPHERE = 6378137.0


def ground_size(size: float, north: float, row: Column) -> Column:
    """Metres on the ground of a Mercator cell `size` wide, in a row of a raster whose top lies at `north`: a cell narrows
    by the cosine of its latitude."""
    y = F.lit(north) - (row + 0.5) * size
    return F.cos(F.atan(F.sinh(y / SPHERE))) * abs(size)


def slope(cell: DataFrame, size: float, north: float | None = None) -> DataFrame:
    """slope in degrees: central differences, one-sided at the edges. With `north`, cells are a Mercator raster's."""
    c = neighbourhood(cell)
    v = F.col("v")
    size = size if north is None else ground_size(size, north, F.col("row"))
    dx = F.when(F.col("w").isNull(), F.col("e") - v).when(F.col("e").isNull(), v - F.col("w")).otherwise((F.col("e") - F.col("w")) / 2) / size
    dy = F.when(F.col("n").isNull(), F.col("s") - v).when(F.col("s").isNull(), v - F.col("n")).otherwise((F.col("s") - F.col("n")) / 2) / size
    return c.select("row", "col", F.degrees(F.atan(F.hypot(dx, dy))).alias("slope"))


def hillshade(cell: DataFrame, size: float, z: float, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """shade 1 to 255 by a 3 by 3 kernel that weighs the straight neighbours twice; 0 where a neighbour is missing."""
    c = neighbourhood(cell)
    dx = ((F.col("ne") + 2 * F.col("e") + F.col("se")) - (F.col("nw") + 2 * F.col("w") + F.col("sw"))) * (z / (8 * size))
    dy = ((F.col("sw") + 2 * F.col("s") + F.col("se")) - (F.col("nw") + 2 * F.col("n") + F.col("ne"))) * (z / (8 * size))
    alt, az = F.radians(F.lit(altitude)), F.radians(F.lit(azimuth))
    # light comes from the azimuth, rows grow to the south
    dot = F.sin(alt) + F.cos(alt) * (-dx * F.sin(az) + dy * F.cos(az))
    lit = dot / F.sqrt(1 + dx * dx + dy * dy)
    return c.select("row", "col", F.when(lit.isNull(), 0).otherwise(1 + F.rint(254 * F.greatest(lit, F.lit(0.0)))).cast("int").alias("shade"))


def box_smooth(cell: DataFrame, radius: int = 2) -> DataFrame:
    """Mean over the box of cells there are within radius, by running sums along rows and then columns."""
    along = Window.partitionBy("row").orderBy("col").rangeBetween(-radius, radius)
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-radius, radius)
    c = cell.withColumn("_s", F.sum("v").over(along)).withColumn("_n", F.count("v").over(along))
    return c.select("row", "col", (F.sum("_s").over(down) / F.sum("_n").over(down)).alias("v"))


def block_average(cell: DataFrame, k: int) -> DataFrame:
    return cell.groupBy(F.floor(F.col("row") / k).alias("row"), F.floor(F.col("col") / k).alias("col")).agg(F.avg("v").alias("v"))


def envelopes(cell: DataFrame, square: Column, origin: tuple[Column, Column], side: int, snap: int = 3) -> DataFrame:
    """square, r0, r1, c0, c1 (ends exclusive): the box of a square's cells, moved to the square's side where it is within snap."""
    c = cell.select(square.alias("square"), origin[0].alias("_r"), origin[1].alias("_c"), "row", "col")
    b = c.groupBy("square", "_r", "_c").agg(F.min("row").alias("r0"), (F.max("row") + 1).alias("r1"), F.min("col").alias("c0"), (F.max("col") + 1).alias("c1"))

    def low(x: str, o: str) -> Column:
        return F.when(F.col(x) - F.col(o) <= snap, F.col(o)).otherwise(F.col(x)).alias(x)

    def high(x: str, o: str) -> Column:
        return F.when(F.col(o) + side - F.col(x) <= snap, F.col(o) + side).otherwise(F.col(x)).alias(x)

    return b.select("square", low("r0", "_r"), high("r1", "_r"), low("c0", "_c"), high("c1", "_c"))


def ramp_colour(cell: DataFrame, stops: list[tuple[float, int, int, int, int]]) -> DataFrame:
    """r, g, b, a of v: linear between stops, clamped at the ends, rounded half to even. The stops are a fixed table."""
    v, out = F.col("v"), []
    for i, name in enumerate("rgba", start=1):
        c = F.lit(float(stops[0][i]))
        for lo, hi in zip(stops, stops[1:], strict=False):
            t = (v - lo[0]) / (hi[0] - lo[0])
            c = F.when(v >= lo[0], F.lit(float(lo[i])) + t * float(hi[i] - lo[i])).otherwise(c)
        c = F.when(v >= stops[-1][0], F.lit(float(stops[-1][i]))).otherwise(c)
        out.append(F.greatest(F.lit(0), F.least(F.lit(255), F.rint(c).cast("int"))).alias(name))
    return cell.select("row", "col", *out)


def difference(dem: DataFrame, published: DataFrame) -> DataFrame:
    """row, col, d: dem less published; nothing where both are at or below sea level; NaN where either is NaN."""
    p = published.select("row", "col", F.col("v").alias("_p"))
    low = ~F.isnan("v") & ~F.isnan("_p") & (F.col("v") <= 0) & (F.col("_p") <= 0)
    return dem.join(p, ["row", "col"]).select("row", "col", F.when(low, 0.0).otherwise(F.col("v") - F.col("_p")).alias("d"))


def span(diff: DataFrame) -> DataFrame:
    """The 98th percentile of changes of at least half a metre, rounded up to a nice figure, at least 5."""
    changed = diff.where("NOT isnan(d) AND abs(d) >= 0.5")
    return changed.agg(F.coalesce(X.nice_span(F.expr("percentile(abs(d), 0.98)")), F.lit(5.0)).alias("span"))


def first_pass_class(v: Column) -> Column:
    """Fixed sentinels of the first pass: declined, void, beyond, else solved; 255 where there is no cell."""
    return F.when(v.isNull(), 255).when(v == -32767, 1).when(v == -32766, 2).when(v == -32768, 3).otherwise(0)


def class_areas(cell: DataFrame, lat: Column, step_m: float) -> DataFrame:
    """class, cells, km2 with cells narrowing by the cosine of their latitude."""
    area = F.cos(F.radians(lat)) * (step_m * step_m / 1e6)
    return cell.groupBy("class").agg(F.count("*").alias("cells"), F.sum(area).alias("km2"))


def dilate(mask: DataFrame) -> DataFrame:
    """row, col of a mask grown by its four neighbours."""
    step = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)))))
    return mask.select("row", "col", step.alias("s")).select((F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col")).distinct()


def erode(mask: DataFrame, radius: int = 1) -> DataFrame:
    """row, col of cells whose whole square window is in the mask."""
    along = Window.partitionBy("row").orderBy("col").rangeBetween(-radius, radius)
    down = Window.partitionBy("col").orderBy("row").rangeBetween(-radius, radius)
    n = 2 * radius + 1
    rows = mask.select("row", "col").distinct().withColumn("_n", F.count("*").over(along))
    return rows.withColumn("_m", F.sum(F.when(F.col("_n") == n, 1).otherwise(0)).over(down)).where(f"_m = {n}").select("row", "col")


def regions(mask: DataFrame, components) -> DataFrame:
    """row, col, region of 4-connected regions of a mask: runs along rows first, then the runs that touch are joined.

    Only the graph of runs goes through the connected components, not every cell."""
    w = Window.partitionBy("row").orderBy("col")
    run = mask.select("row", "col").withColumn("_k", F.col("col") - F.row_number().over(w))
    first = F.min("col").over(Window.partitionBy("row", "_k"))
    run = run.withColumn("run", F.col("row").cast("long") * (1 << 31) + first).drop("_k")
    below = run.select((F.col("row") - 1).alias("row"), "col", F.col("run").alias("b"))
    edges = run.join(below, ["row", "col"]).select(F.col("run").alias("a"), "b").distinct()
    labels = components(edges)
    return run.join(labels, run["run"] == labels["v"], "left").select("row", "col", F.coalesce("component", "run").alias("region"))


def land_clamp(cell: DataFrame, burned: DataFrame, water: DataFrame, dry: DataFrame, shape: tuple[int, int], components) -> DataFrame:
    """row, col, v of the surface (row, col, d, null for nodata) after the sea is told from the land.

    Candidates are cells within half a metre of 0, or without a value, that were not burned. Their 4-connected regions
    that do not reach the raster's edge are enclosed, not sea. The water mask adds sea, the dry mask takes it away. Land
    is at least 1 m, sea 0; burned cells keep what was burned."""
    b = burned.select("row", "col", F.col("v").alias("burn"))
    c = cell.join(b, ["row", "col"], "left")
    for name, m in (("wet", water), ("land", dry)):
        c = c.join(m.select("row", "col").distinct().withColumn(name, F.lit(True)), ["row", "col"], "left")
    sea = c.where((F.col("d").isNull() | (F.abs("d") < 0.5)) & F.col("burn").isNull()).select("row", "col")
    r = regions(sea, components)
    edge = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == shape[0] - 1) | (F.col("col") == shape[1] - 1)
    open_sea = r.join(r.where(edge).select("region").distinct(), "region", "left_semi").select("row", "col").withColumn("open", F.lit(True))
    c = c.join(open_sea, ["row", "col"], "left")
    is_sea = (F.coalesce("open", F.lit(False)) | F.coalesce("wet", F.lit(False))) & ~F.coalesce("land", F.lit(False))
    v = F.when(F.col("burn").isNotNull(), F.col("burn")).when(is_sea, 0.0).otherwise(F.greatest(F.coalesce("d", F.lit(1.0)), F.lit(1.0)))
    return c.select("row", "col", v.alias("v"))


def zone_stats(cell: DataFrame) -> DataFrame:
    """Percentages of all cells that are sea (0), low land (under 10 m), land (above 0) and below 0; cut-off least and
    most; mean. An empty raster has nulls."""
    n = F.count("*")

    def share(c: Column) -> Column:
        return F.sum(F.when(c, 1).otherwise(0)) * 100.0 / n

    v = F.col("v")
    return cell.agg(
        share(v == 0).alias("sea"), share((v > 0) & (v < 10)).alias("low"), share(v > 0).alias("land"),
        F.min(v).cast("int").alias("least"), F.max(v).cast("int").alias("most"), F.avg(v).alias("mean"), share(v < 0).alias("below"),
    )


def nearest_seed(cell: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """row, col, d2: squared distance in cells to the nearest seed not farther than most; null beyond. Exact.

    The distance along each column first (a window), then the best of the columns within reach (a bounded join)."""
    c = cell.select("row", "col").join(seeds.select("row", "col").distinct().withColumn("_s", F.col("row")), ["row", "col"], "left")
    w = Window.partitionBy("col").orderBy("row")
    up = F.last("_s", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    on = F.first("_s", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    c = c.withColumn("g", F.least(F.col("row") - up, on - F.col("row"))).where(f"g <= {most}")
    spread = c.select("row", F.explode(F.sequence(F.col("col") - most, F.col("col") + most)).alias("to"), "col", "g")
    best = spread.groupBy("row", F.col("to").alias("col")).agg(F.min((F.col("to") - F.col("col")) * (F.col("to") - F.col("col")) + F.col("g") * F.col("g")).alias("d2"))
    return cell.select("row", "col").join(best.where(F.col("d2") <= most * most), ["row", "col"], "left")
