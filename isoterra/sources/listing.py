"""Listings of square files, zones, mirrors' index pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


#: Fixed pattern: a square's file name.
FILE = r"^([NS]\d{2}[EW]\d{3})\.osm(\.xz)?$"


def squares_of(names: DataFrame) -> DataFrame:
    """name, square, compressed of the file names that are squares'."""
    return names.where(F.col("name").rlike(FILE)).select("name", F.regexp_extract("name", FILE, 1).alias("square"), F.col("name").endswith(".xz").alias("compressed"))


def duplicates(listing: DataFrame) -> DataFrame:
    return listing.groupBy("square").agg(F.count("*").alias("files"), F.count_if("compressed").alias("compressed")).where("files > 1")


def loose(listing: DataFrame) -> DataFrame:
    return listing.where("NOT compressed")


def working_set(table: DataFrame, lon: int, lat: int, size: int = 3) -> DataFrame:
    """Rows of the size by size squares about one; longitudes wrap, squares past a pole are none."""
    half = size // 2
    names = [
        ("N" if y >= 0 else "S") + f"{abs(y):02d}" + ("E" if x >= 0 else "W") + f"{abs(x):03d}"
        for y in range(lat - half, lat + half + 1) if -90 <= y <= 89
        for x in ((lon + i + 180) % 360 - 180 for i in range(-half, half + 1))
    ]
    return table.where(F.col("square").isin(names))


def zone_cells(text: DataFrame) -> DataFrame:
    """zone, lon of lines 'name from..to'."""
    p = F.split("value", " ")
    ends = F.split(p[1], r"\.\.")
    return text.select(p[0].alias("zone"), F.explode(F.sequence(ends[0].cast("int"), ends[1].cast("int"))).alias("lon"))


def links(pages: DataFrame, column: str) -> DataFrame:
    return pages.withColumn("link", F.explode(F.regexp_extract_all(F.col(column), F.lit('href="([^"]*)"'), F.lit(1))))


