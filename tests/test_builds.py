"""Hand cases for the sea mask, raster steps, territories, reports and written files."""

import math

import numpy as np

from isoterra.operators import reports, sea, terrain, territory
from isoterra.sources import osm, writer
from pyspark.sql import functions as F

from tests.test_operators import full, grid, rows


def test_seeds_lie_on_their_sides(spark):
    # eastward in columns, so that north (smaller rows) is on the left; an islet's shore is too near to hold a seed
    coast = spark.createDataFrame([(1, 0.0, 20.0, 10.0, 20.0), (2, 10.0, 20.0, 30.0, 20.0), (3, 4.0, 21.0, 6.0, 21.0), (4, 5.0, 5.0, 5.0, 5.0)], "segment_id long, ax double, ay double, bx double, by double")
    assert rows(sea.coast_seeds(coast)) == [(17, 5, "land"), (17, 20, "land"), (22, 20, "water"), (23, 5, "water")]
    cells = full(spark, np.zeros((9, 9)))
    one = lambda *p: spark.createDataFrame(list(p), "row int, col int")
    m = sea.water_mask(cells, one((0, 0)), one((0, 8)), one((8, 0)), reach=6)
    water, dry = grid(m, (9, 9), "water"), grid(m, (9, 9), "dry")
    for i in range(9):
        for j in range(9):
            dw, dl, dd = math.hypot(i, j), math.hypot(i, 8 - j), math.hypot(8 - i, j)
            is_dry = dd < (dw if dw <= 7 else 99) and dd <= 6
            land = min(dl, dd) if is_dry else dl
            assert dry[i, j] == is_dry and water[i, j] == (dw <= 6 and dw < (land if land <= 7 else 99))
    assert sea.water_mask(cells, one((0, 0)).where("false"), one((1, 1))).where("water OR dry").count() == 0
    assert rows(sea.lake_seeds(cells.where("row < 3 AND col < 3"))) == [(0, 0), (0, 2), (2, 0), (2, 2)]


def test_drawn_area_and_lakes(spark):
    cells = full(spark, np.zeros((10, 10)))
    e = spark.createDataFrame([(1, 4, 2, 6), (3, 5, 5, 9), (7, 7, 0, 9)], "r0 int, r1 int, c0 int, c1 int")
    got = grid(terrain.drawn_area(cells, e, 4), (10, 10), "drawn")
    want = np.zeros((10, 10))
    want[1:4, 2:6] = want[3:5, 5:9] = 1
    assert np.array_equal(got, want) and terrain.drawn_area(cells, e.where("false")).where("drawn").count() == 0
    ring = [(1.0, 1.0), (7.0, 1.0), (7.0, 7.0), (1.0, 7.0)]
    edges = spark.createDataFrame([(1, *a, *b) for a, b in zip(ring, ring[1:] + ring[:1])], "ring_id long, ax double, ay double, bx double, by double")
    lake = terrain.lake_cells(cells, edges, spark.createDataFrame([(1, 50.0)], "ring_id long, ele double"), (0.0, 10.0, 1.0))
    assert {(r.row, r.col) for r in lake.collect()} == {(r, c) for r in range(3, 9) for c in range(1, 7)}


def test_patches_radii_and_colours(spark):
    got = terrain.clamp_patch(full(spark, [[5.0, -3.0, 9.0, 0.2]]), full(spark, [[np.nan, np.nan, 0.0, np.nan]]).where("v IS NOT NULL"), full(spark, [[4.0, 0.0, 2.0, 3.0]]))
    assert grid(got, (1, 4), "v").tolist() == [[5, 0, 0, 1]]
    assert terrain.preview_radii(60) == (60, 60) and terrain.preview_radii(60, True) == (120, 60) and terrain.preview_radii(60, True, 7, 3) == (7, 3)
    c = spark.createDataFrame([(0, i, k) for i, k in enumerate((0, 1, 2, 3, 255))], "row int, col int, class int")
    assert [tuple(r)[2:] for r in terrain.unreached_colour(c).orderBy("col").collect()] == [(0, 0, 0, 0), (200, 30, 30, 150), (230, 120, 20, 140), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert tuple(terrain.unreached_colour(c, True).where("col = 3").first())[2:] == (235, 200, 40, 130)


def test_warp_is_bilinear(spark):
    size, step = 0.01, 900.0
    a = np.add.outer(np.arange(30) * 2.0, np.arange(40) * 3.0)
    west, north = 10.0, 45.0
    u0, v0 = 6378137 * math.radians(10.1), 6378137 * math.log(math.tan(math.pi / 4 + math.radians(44.95) / 2))
    target = spark.createDataFrame([(i, j) for i in range(5) for j in range(6)], "row int, col int")
    got = grid(terrain.warp(full(spark, a), (west, north, size), target, (u0, v0, step)), (5, 6), "v")
    near = grid(terrain.warp(full(spark, a), (west, north, size), target, (u0, v0, step), True), (5, 6), "v")
    for (i, j), v in np.ndenumerate(got):
        lon = math.degrees((u0 + (j + 0.5) * step) / 6378137)
        lat = math.degrees(math.atan(math.sinh((v0 - (i + 0.5) * step) / 6378137)))
        x, y = (lon - west) / size, (north - lat) / size
        assert math.isclose(v, (y - 0.5) * 2 + (x - 0.5) * 3, rel_tol=1e-9) and near[i, j] == a[int(y), int(x)]
    assert terrain.warp(full(spark, a), (0.0, 1.0, size), target, (u0, v0, step)).where("v IS NOT NULL").count() == 0


def test_territory_shares_and_permission(spark):
    box = lambda w, s, e, n: ([float(v) for v in (w, e, e, w)], [float(v) for v in (s, s, n, n)])
    ring = spark.createDataFrame([(1, 0, *box(0, 0, 10, 10)), (2, 0, *box(10, 0, 20, 10)), (3, 0, *box(20, 20, 30, 30)), (3, 1, *box(22, 22, 28, 28)), (4, 0, *box(0, 0, 40, 40))], "rel long, ring int, lons array<double>, lats array<double>")
    asked = {"a": (2.0, 2.0, 3.0, 3.0), "b": (9.5, 2.0, 10.5, 3.0), "c": (21.0, 21.0, 29.0, 29.0), "d": (23.0, 23.0, 27.0, 27.0), "e": (50.0, 50.0, 51.0, 51.0)}
    boxes = spark.createDataFrame([(k, *v) for k, v in asked.items()], "box_id string, west double, south double, east double, north double")
    own = ring.where("rel < 4")
    got = {(r.box_id, r.rel): round(r.share, 9) for r in territory.shares(boxes, own).collect()}
    assert got == {("a", 1): 1.0, ("b", 1): 0.5, ("b", 2): 0.5, ("c", 3): 28 / 64}
    known = spark.createDataFrame([(1, "owned", "x", ["u"]), (2, "owned", "y", ["w"]), (4, "outline", "z", ["u"])], "rel long, status string, owner string, editors array<string>")
    found = territory.under(boxes, ring, known)
    assert {(r.box_id, r.rel): r.place for r in found.collect()} == {("a", 1): 1, ("b", 2): 1, ("b", 1): 2, ("c", 3): 1}
    assert dict(rows(territory.permission(boxes, found, "u"))) == {"a": "yes", "b": "partial", "c": "no", "d": "no", "e": "no"}
    assert set(dict(rows(territory.permission(boxes, found, ""))).values()) == {"no"}


def test_finding_keeping_comparing(spark):
    texts = {"n123": ("node", 123), "way -12": ("way", -12), "R/7": ("relation", 7), " relation : 8 ": ("relation", 8), "x1": None, "": None, None: None}
    d = spark.createDataFrame([(k,) for k in texts], "t string").select(reports.element_of(F.col("t")).alias("e"))
    assert [None if r.e is None else tuple(r.e) for r in d.collect()] == list(texts.values())
    tags = F.expr("map('b', '1', 'x', '2', 'a', '3')")
    assert list(spark.range(1).select(F.map_keys(reports.kept_tags(tags, ["a", "b", "c"])).alias("m")).first().m) == ["a", "b"]
    spot = spark.createDataFrame([(1, 10.5, 20.5), (2, 10.9, 20.5), (3, 50.0, 0.0), (4, 370.5, 20.4)], "node_id long, lon double, lat double")
    box = spark.createDataFrame([("N20E010", 10.4, 20.3, 10.6, 20.6)], "square string, west double, south double, east double, north double")
    assert {r.node_id: r.kept for r in reports.within_boxes(spot, box, spark.createDataFrame([(3,)], "node_id long")).collect()} == {1: True, 2: False, 3: True, 4: False}
    sq = spark.createDataFrame([("N05E005",), ("N00E000",), ("S01W001",)], "square string")
    assert [r.square for r in reports.nearest_squares(sq, (0.0, 0.0, 1.0, 1.0)).collect()] == ["N00E000", "S01W001", "N05E005"]
    kind = "zone string, sea double, low double, land double, below double, rows long, cols long"
    now = spark.createDataFrame([("z", 20.0, 5.0, 80.0, 0.5, 10, 10), ("new", 1.0, 1.0, 1.0, 0.0, 1, 1)], kind)
    was = spark.createDataFrame([("z", 14.9, 3.5, 80.0, 0.0, 10, 11)], kind)
    assert [r.warning for r in reports.compare_builds(now, was).collect()] == ["0.50% of the zone is below sea level", "sea moved +5.10 points, over the 5 point tolerance", "grid changed from 11x10 to 10x10"]
    file = spark.createDataFrame([("z", "a", 1, 5), ("z", "b", 2, 5), ("y", "c", 1, 1)], "zone string, name string, size long, mtime long")
    first = reports.zone_digest(file)
    assert rows(reports.zone_digest(file.orderBy(F.desc("name")))) == rows(first)
    again = reports.zone_digest(file.withColumn("mtime", F.col("mtime") + (F.col("name") == "b").cast("int")))
    assert [r.zone for r in reports.stale_zones(again, first).collect()] == ["z"]
    copies = spark.createDataFrame([("s", "2024-01-01"), ("s", "2024-02-01"), ("t", "2020-01-01"), ("s", "2024-12-01")], "square string, kept_at string").withColumn("kept_at", F.col("kept_at").cast("timestamp"))
    assert rows(reports.prune(copies, F.lit("2025-01-01").cast("timestamp")).select("square", F.col("kept_at").cast("date").cast("string"))) == [("s", "2024-01-01"), ("s", "2024-02-01")]
    line = spark.createDataFrame([(1, 1, 2.0, 3.0, "r"), (1, 0, 1.0, 3.0, "r")], "line_id long, seq int, lon double, lat double, name string")
    assert reports.line_features(line, ["name"]).first().feature == '{"type":"Feature","properties":{"name":"r"},"geometry":{"type":"LineString","coordinates":[[1.0,3.0],[2.0,3.0]]}}'
    assert '"coordinates":[[[10.4,20.3],[10.6,20.3],[10.6,20.6],[10.4,20.6],[10.4,20.3]]]' in reports.box_features(box, ["square"]).first().feature
    way = spark.createDataFrame([(1, {"ele": "0"}), (2, {"ele": "5"}), (3, {"ele": "0", "natural": "water"}), (4, {"ele": "0", "natural": "coastline"}), (5, {"ele": "0"})], "way_id long, tags map<string,string>")
    on = {r.way_id: r.tags.get("natural") for r in reports.mark_coastline(way, way.where("way_id < 5")).collect()}
    off = {r.way_id: r.tags.get("natural") for r in reports.mark_coastline(way, way, False).collect()}
    assert on == {1: "coastline", 2: None, 3: "water", 4: "coastline", 5: None} and off == {1: None, 2: None, 3: "water", 4: None, 5: None}


def test_squares_are_written_whole(spark, tmp_path):
    body = '<osm version="0.6"><node id="1" lat="42.25" lon="17.5" version="2"><tag k="ele" v="5"/></node><way id="7"><nd ref="1"/></way></osm>'
    (tmp_path / "in").mkdir()
    for name in ("N42E017", "N43E017"):
        (tmp_path / "in" / f"{name}.osm").write_text(body)
    e = osm.read_elements(spark, str(tmp_path / "in"))
    out = str(tmp_path / "out")
    first = rows(writer.write_squares(e, out))
    assert [r[0] for r in first] == ["N42E017", "N43E017"] and sorted(p.name for p in (tmp_path / "out").iterdir()) == ["N42E017.osm.xz", "N43E017.osm.xz"]
    held = (tmp_path / "out" / "N42E017.osm.xz").read_bytes()
    assert rows(writer.write_squares(osm.read_elements(spark, out), f"file://{out}")) == first and (tmp_path / "out" / "N42E017.osm.xz").read_bytes() == held
    writer.write_changes(e.withColumn("op", F.lit("modify")), out).collect()
    assert rows(osm.read_elements(spark, f"{out}/*.osc").groupBy("op").count()) == [("modify", 4)]
    writer.blank_squares(spark.createDataFrame([("S01W001",)], "square string"), out).collect()
    assert osm.read_elements(spark, f"{out}/S01W001.osm.xz").count() == 0
