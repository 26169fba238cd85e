"""Nodes, ways, segments, spots and cells from the star-schema test tables; the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from isoterra.functions import expressions as X

ELE_TEXT = """CASE o_orderkey % 97 WHEN 0 THEN 'TBD' WHEN 1 THEN '169s' WHEN 2 THEN '1,853 Ft' WHEN 3 THEN '1e3' WHEN 4 THEN '1.2.3'
 WHEN 5 THEN '5-3' WHEN 6 THEN ' 75 ' ELSE CAST((o_custkey % 40) * 25 AS STRING) END"""
LON0 = "CAST(86.0 AS DOUBLE) + (o_orderkey % 120) * CAST(0.025 AS DOUBLE)"
LAT0 = "CAST(19.0 AS DOUBLE) + (CAST(floor(o_orderkey / CAST(120.0 AS DOUBLE)) AS BIGINT) % 120) * CAST(0.025 AS DOUBLE)"


class Fixture:
    """Tables of one folder; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def way(self) -> DataFrame:
        """square, way_id, ele_text, ele, waterway, body, fill, closed, lon0, lat0, owner."""
        o = self.table("orders").selectExpr(
            "o_orderkey AS way_id", f"{ELE_TEXT} AS ele_text", f"{LON0} AS lon0", f"{LAT0} AS lat0", "o_custkey AS owner",
            "CASE o_orderpriority WHEN '1-URGENT' THEN 'river' WHEN '2-HIGH' THEN 'stream' END AS waterway",
            "CASE WHEN o_orderpriority = '5-LOW' THEN 'coastline' WHEN o_orderpriority = '3-MEDIUM' AND o_orderkey % 5 = 0 THEN 'water' END AS body",
            "o_orderkey % 89 = 0 AS fill", "o_orderkey % 5 = 0 AS closed",
        )
        return o.withColumn("ele", X.parse_ele(F.col("ele_text"))).withColumn("square", X.square_name(F.col("lon0"), F.col("lat0")))

    def way_node(self) -> DataFrame:
        """way_id, seq, node_id, lon, lat, n (nodes of the way)."""
        order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
        n = self.table("lineitem").withColumn("seq", F.row_number().over(order) - 1)
        n = n.withColumn("o_orderkey", F.col("l_orderkey"))
        return n.selectExpr(
            "l_orderkey AS way_id", "seq", "l_partkey AS node_id", f"{LON0} + (l_partkey % 97) * CAST(0.0004 AS DOUBLE) AS lon",
            f"{LAT0} + (l_suppkey % 89) * CAST(0.0004 AS DOUBLE) AS lat",
        )

    def line(self) -> DataFrame:
        """way_node with the way's elevation, contours only."""
        return self.way_node().join(self.way().where("ele IS NOT NULL AND NOT fill").select("way_id", "ele", "square"), "way_id")

    def segment(self) -> DataFrame:
        """way_id, seq, ele, ax, ay, bx, by in metres on a fixed scale."""
        from isoterra.operators.sequences import segments

        return segments(self.line().selectExpr("way_id", "ele", "seq", "lon * 104000D AS x", "lat * 110540D AS y"), ["way_id", "ele"])

    def spot(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey AS node_id", "CAST(p_size * 20 AS DOUBLE) AS ele",
            "CAST(86.0 AS DOUBLE) + (p_partkey % 120) * CAST(0.025 AS DOUBLE) + (p_partkey % 97) * CAST(0.0004 AS DOUBLE) AS lon",
            "CAST(19.0 AS DOUBLE) + (CAST(floor(p_partkey / CAST(120.0 AS DOUBLE)) AS BIGINT) % 120) * CAST(0.025 AS DOUBLE) + (p_partkey % 89) * CAST(0.0004 AS DOUBLE) AS lat",
        )

    def cell(self) -> DataFrame:
        """row, col, v: a 64 by 64 raster with holes."""
        c = self.table("lineitem").groupBy((F.col("l_partkey") % 64).cast("int").alias("row"), (F.col("l_suppkey") % 64).cast("int").alias("col"))
        return c.agg(F.min("l_quantity").alias("v")).where("(row * 7 + col * 3) % 11 <> 0")

    def full_cell(self) -> DataFrame:
        """row, col, v without holes: 0 where the raster has none."""
        r = self.spark.range(4096).selectExpr("CAST(id DIV 64 AS INT) AS row", "CAST(id % 64 AS INT) AS col")
        return r.join(self.cell(), ["row", "col"], "left").na.fill(0.0, ["v"])


_NUM = X.NUMBER.replace("'", "''")
SQL_WITH = f"""WITH RECURSIVE way AS (
 SELECT *, CASE WHEN regexp_matches(trim(ele_text), '{_NUM}') THEN try_cast(replace(trim(ele_text), '_', '') AS DOUBLE) END AS ele,
  'N' || CAST(floor(lat0) AS BIGINT) || 'E0' || CAST(floor(lon0) AS BIGINT) AS square
 FROM (SELECT o_orderkey AS way_id, {ELE_TEXT} AS ele_text, {LON0} AS lon0, {LAT0} AS lat0, o_custkey AS owner,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'river' WHEN '2-HIGH' THEN 'stream' END AS waterway,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'coastline' WHEN o_orderpriority = '3-MEDIUM' AND o_orderkey % 5 = 0 THEN 'water' END AS body,
  o_orderkey % 89 = 0 AS fill, o_orderkey % 5 = 0 AS closed FROM orders)),
wn AS (
 SELECT way_id, seq, node_id, lon0 + (node_id % 97) * CAST(0.0004 AS DOUBLE) AS lon, lat0 + (l_suppkey % 89) * CAST(0.0004 AS DOUBLE) AS lat
 FROM (SELECT l_orderkey AS way_id, l_partkey AS node_id, l_suppkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS seq,
   {LON0.replace('o_orderkey', 'l_orderkey')} AS lon0, {LAT0.replace('o_orderkey', 'l_orderkey')} AS lat0 FROM lineitem)),
line AS (SELECT wn.*, way.ele, way.square FROM wn JOIN way USING (way_id) WHERE way.ele IS NOT NULL AND NOT fill),
seg AS (
 SELECT way_id, ele, seq, x AS ax, y AS ay, bx, ey FROM (
  SELECT way_id, ele, seq, x, y, lead(x) OVER w AS bx, lead(y) OVER w AS ey
  FROM (SELECT way_id, ele, seq, lon * 104000.0::DOUBLE AS x, lat * 110540.0::DOUBLE AS y FROM line) WINDOW w AS (PARTITION BY way_id ORDER BY seq)) WHERE bx IS NOT NULL),
spot AS (
 SELECT p_partkey AS node_id, (p_size * 20)::DOUBLE AS ele, CAST(86.0 AS DOUBLE) + (p_partkey % 120) * CAST(0.025 AS DOUBLE) + (p_partkey % 97) * CAST(0.0004 AS DOUBLE) AS lon,
  CAST(19.0 AS DOUBLE) + (CAST(floor(p_partkey / CAST(120.0 AS DOUBLE)) AS BIGINT) % 120) * CAST(0.025 AS DOUBLE) + (p_partkey % 89) * CAST(0.0004 AS DOUBLE) AS lat FROM part),
cell AS (SELECT * FROM (SELECT (l_partkey % 64)::INT AS row, (l_suppkey % 64)::INT AS col, min(l_quantity) AS v FROM lineitem GROUP BY 1, 2) WHERE (row * 7 + col * 3) % 11 <> 0),
fc AS (SELECT r AS row, c AS col, coalesce(v, 0) AS v FROM (SELECT unnest(range(64))::INT AS r) CROSS JOIN (SELECT unnest(range(64))::INT AS c) LEFT JOIN cell ON row = r AND col = c)
"""
