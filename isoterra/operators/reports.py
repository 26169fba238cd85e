"""Finding, filtering and reporting: elements by name, tags kept, builds compared, digests, what to prune, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from isoterra.functions import expressions as X

#: Points that a share may move by between builds; days that a copy is kept.
TOLERANCE = {"sea": 5.0, "low": 2.0, "land": 5.0}
KEEP_DAYS = 90
#: Fixed pattern: an element as people write it.
ELEMENT = r"(?i)^\s*(n|w|r|node|way|relation)\s*[/:]?\s*(-?\d+)\s*$"


def element_of(text: Column) -> Column:
    """struct (kind, id) of text such as w-12 or node 7; null for any other."""
    word = F.lower(F.substring(F.regexp_extract(text, ELEMENT, 1), 1, 1))
    kind = F.when(word == "n", "node").when(word == "w", "way").when(word == "r", "relation")
    return F.when(text.rlike(ELEMENT), F.struct(kind.alias("kind"), F.regexp_extract(text, ELEMENT, 2).try_cast("long").alias("id")))


def kept_tags(tags: Column, keep: list[str]) -> Column:
    """The tags that are kept, in the order in which `keep` names them."""
    entries = [F.when(F.map_contains_key(tags, k), F.struct(F.lit(k).alias("key"), F.element_at(tags, F.lit(k)).alias("value"))) for k in keep]
    return F.map_from_entries(F.array_compact(F.array(*entries)))


def within_boxes(spot: DataFrame, box: DataFrame, held: DataFrame) -> DataFrame:
    """spot (node_id, lon, lat, ...) with `kept`: inside its square's box (square, west, south, east, north), or held already
    (node_id). Longitudes wrap."""
    lon = F.pmod(F.floor("lon") + 180, F.lit(360)) - 180
    s = spot.withColumn("_sq", X.square_name(lon, F.col("lat")))
    j = s.join(box.withColumnRenamed("square", "_sq"), "_sq", "left").join(held.select("node_id").distinct().withColumn("_h", F.lit(True)), "node_id", "left")
    inside = F.coalesce((F.col("lon") >= F.col("west")) & (F.col("lon") <= F.col("east")) & (F.col("lat") >= F.col("south")) & (F.col("lat") <= F.col("north")), F.lit(False))
    return j.withColumn("kept", inside | F.col("_h").isNotNull()).select(*spot.columns, "kept")


def nearest_squares(square: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """square (square, ...) with d2, the nearest to the middle of bounds first, then by name."""
    west, south, east, north = bounds
    x, y = X.square_lon(F.col("square")) + 0.5 - (west + east) / 2, X.square_lat(F.col("square")) + 0.5 - (south + north) / 2
    return square.withColumn("d2", x * x + y * y).orderBy("d2", "square")


def compare_builds(now: DataFrame, was: DataFrame) -> DataFrame:
    """zone, warning of builds (zone, sea, low, land, below, rows, cols): ground below sea level, shares that moved more than
    they may, a grid that changed. A zone without a build before is compared with nothing."""
    b = was.select("zone", F.struct(*TOLERANCE, "rows", "cols").alias("_b"))
    j = now.join(b, "zone", "left")
    moved = [
        F.when(F.abs(F.col(k) - F.col(f"_b.{k}")) > limit, F.format_string(f"{k} moved %+.2f points, over the {limit:.0f} point tolerance", F.col(k) - F.col(f"_b.{k}")))
        for k, limit in TOLERANCE.items()
    ]
    size = F.when((F.col("rows") != F.col("_b.rows")) | (F.col("cols") != F.col("_b.cols")), F.format_string("grid changed from %dx%d to %dx%d", "_b.cols", "_b.rows", "cols", "rows"))
    low = F.when(F.col("below") > 0, F.format_string("%.2f%% of the zone is below sea level", F.col("below")))
    return j.select("zone", F.explode(F.array_compact(F.array(low, *moved, size))).alias("warning"))


def zone_digest(file: DataFrame) -> DataFrame:
    """zone, digest of files (zone, name, size, mtime): of the sorted list, so that any change to a file shows."""
    line = F.concat_ws(" ", "name", F.col("size").cast("string"), F.col("mtime").cast("string"))
    return file.groupBy("zone").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))


def stale_zones(digest: DataFrame, stamp: DataFrame) -> DataFrame:
    """zone, digest of zones whose digest is not the one of their last build that succeeded (zone, digest)."""
    return digest.join(stamp.select("zone", "digest"), ["zone", "digest"], "left_anti")


def prune(copy: DataFrame, now: Column, days: int = KEEP_DAYS) -> DataFrame:
    """Copies (square, kept_at, ...) older than `days`, but each square's newest; of equally new ones all stay."""
    newest = F.max("kept_at").over(Window.partitionBy("square"))
    return copy.withColumn("_new", newest).where((F.col("kept_at") < now - F.expr(f"INTERVAL {days} DAYS")) & (F.col("kept_at") < F.col("_new"))).drop("_new")


def line_features(line: DataFrame, properties: list[str]) -> DataFrame:
    """feature: a GeoJSON LineString for each line_id of points (line_id, seq, lon, lat and the properties, equal on a line)."""
    g = line.groupBy("line_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lon", "lat"))).alias("p"), *(F.first(c).alias(c) for c in properties))
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("p", lambda x: F.array(x["lon"], x["lat"])).alias("coordinates"))
    return g.select("line_id", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("feature"))


def box_features(box: DataFrame, properties: list[str]) -> DataFrame:
    """feature: a GeoJSON Polygon for each box (west, south, east, north and the properties), counter-clockwise."""
    corner = lambda x, y: F.array(F.col(x).cast("double"), F.col(y).cast("double"))
    ring = F.array(corner("west", "south"), corner("east", "south"), corner("east", "north"), corner("west", "north"), corner("west", "south"))
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    return box.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(*properties).alias("properties"), geometry.alias("geometry"))).alias("feature"))


def mark_coastline(way: DataFrame, ids: DataFrame, on: bool = True) -> DataFrame:
    """way (way_id, tags, ...) of which those of ids become coastlines, if they are at sea level and not water or anything
    natural already; or, not `on`, coastlines of ids become plain contours again."""
    tag = lambda k: F.element_at("tags", F.lit(k))
    coast = F.coalesce(tag("natural") == "coastline", F.lit(False))
    free = (X.parse_ele(tag("ele")) == 0) & tag("natural").isNull() & tag("waterway").isNull() & tag("water").isNull()
    hit = F.col("_hit") & (F.coalesce(free, F.lit(False)) if on else coast)
    new = F.map_concat("tags", F.create_map(F.lit("natural"), F.lit("coastline"))) if on else F.map_filter("tags", lambda k, v: k != "natural")
    j = way.join(ids.select("way_id").distinct().withColumn("_hit", F.lit(True)), "way_id", "left").na.fill(False, ["_hit"])
    return j.withColumn("tags", F.when(hit, new).otherwise(F.col("tags"))).select(way.columns)
