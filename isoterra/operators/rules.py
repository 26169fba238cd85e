"""What ways are: contours, water, layers, kinds of squares."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Tags of flowing water.
FLOWING = ["river", "stream", "canal", "ditch", "drain", "riverbank"]


def water_bodies(way: DataFrame) -> DataFrame:
    return way.where("closed AND body = 'water'")


def contours(way: DataFrame) -> DataFrame:
    """Ways with a level that are neither a water body's outline nor a fill line; waterways with a level are contours."""
    return way.where("ele IS NOT NULL AND NOT fill").join(water_bodies(way).select("way_id"), "way_id", "left_anti")


def flowing(way: DataFrame) -> DataFrame:
    return way.where(F.col("waterway").isin(FLOWING))


def classify_squares(way: DataFrame) -> DataFrame:
    """square, kind: contour if a level other than 0 is drawn, coastline if only the shore is, else blank."""
    g = way.groupBy("square").agg(F.bool_or(F.coalesce(F.col("ele") != 0, F.lit(False))).alias("c"), F.bool_or(F.coalesce((F.col("body") == "coastline") | (F.col("ele") == 0), F.lit(False))).alias("s"))
    return g.select("square", F.when(F.col("c"), "contour").when(F.col("s"), "coastline").otherwise("blank").alias("kind"))


def with_constraints(way: DataFrame) -> DataFrame:
    """Ways of the squares that have anything to build from."""
    some = way.where("ele IS NOT NULL OR waterway IS NOT NULL OR body IN ('water', 'coastline')").select("square").distinct()
    return way.join(some, "square", "left_semi")


def way_counts(way_node: DataFrame, way: DataFrame, long: int, very_long: int) -> DataFrame:
    n = way_node.groupBy("way_id").agg(F.count("*").alias("n")).join(way, "way_id")
    return n.groupBy("square").agg(
        F.count_if(F.col("n") > long).alias("long_ways"), F.count_if(F.col("n") > very_long).alias("very_long"), F.max("n").alias("longest"), F.count_if(F.col("ele_text").isNotNull()).alias("with_ele")
    )


def collect_layers(way: DataFrame, spot: DataFrame) -> DataFrame:
    """layer, id, ele of all that is burned: contours, then lakes with a level, then spot heights."""
    c = contours(way).select(F.lit("contour").alias("layer"), F.col("way_id").alias("id"), "ele")
    lakes = water_bodies(way).where("ele IS NOT NULL").select(F.lit("lake").alias("layer"), F.col("way_id").alias("id"), "ele")
    return c.unionByName(lakes).unionByName(spot.select(F.lit("spot").alias("layer"), F.col("node_id").alias("id"), "ele"))
