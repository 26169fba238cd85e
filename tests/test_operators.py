"""Hand cases with answers, invariants and brute force for the operators over ways and rasters."""

import lzma
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from isoterra.functions import expressions as X
from isoterra.operators import cellsets, edits, graph, joins, kernels, ladder, raster, reconcile, sequences, tiles
from isoterra.plans import catalogue
from isoterra.plans.fixture import Fixture
from isoterra.sources import listing, osm, params
from isoterra.streaming import edits as stream
from pyspark.sql import functions as F


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def seg_table(spark, lines):
    p = [(w, float(e), i, float(x), float(y)) for w, e, pts in lines for i, (x, y) in enumerate(pts)]
    return sequences.segments(spark.createDataFrame(p, "way_id long, ele double, seq int, x double, y double"), ["way_id", "ele"])


def test_numbers_as_text(spark):
    cases = {"125": 125.0, " 12 ": 12.0, "1e3": 1000.0, "+5": 5.0, ".5": 0.5, "1_000": 1000.0, "1.2.3": None, "5-3": None, "12d": None, "inf": None, "nan": None, "": None, "1e999": None}
    d = spark.createDataFrame([(k,) for k in cases], "t string").select("t", X.parse_ele(F.col("t")).alias("v"), X.loosely_numeric(F.col("t")).alias("l"))
    got = {r.t: (r.v, r.l) for r in d.collect()}
    assert {k: v[0] for k, v in got.items()} == cases and got["1.2.3"][1] and got["5-3"][1] and not got["1e3"][1]
    f = spark.createDataFrame([(125.0,), (12.5,), (0.1 + 0.2,), (1e-5,)], "v double").select(X.format_ele(F.col("v")).alias("t"))
    assert [r.t for r in f.collect()] == ["125", "12.5", "0.3", "0"]
    big = spark.createDataFrame([(10000000.5,), (1e12,), (-0.25,), (100.0,), (None,)], "v double").select(X.format_ele(F.col("v")).alias("t"))
    assert [r.t for r in big.collect()] == ["10000000.5", "1000000000000", "-0.25", "100", None]
    for bad in ("NaN", "Infinity"):
        with pytest.raises(Exception, match="not an elevation"):
            spark.createDataFrame([(float(bad),)], "v double").select(X.format_ele(F.col("v"))).collect()
    heights = {"1,853 Ft": 565.0, "120": 120.0, "12 m": 12.0, "TBD": None, "1,8": None, "-12 m": -12.0, "120 metres": 120.0, "35'": 11.0, " 1,234,567.5 ": 1234567.5, "12 ft m": None, "": None, None: None}
    h = spark.createDataFrame([(k,) for k in heights], "t string").select(X.height_text(F.col("t")).alias("v"))
    assert [r.v for r in h.collect()] == list(heights.values())


def test_square_names(spark):
    d = spark.createDataFrame([(17.5, 42.0), (-0.5, -23.1), (125.0, -24.0)], "x double, y double")
    names = [r.n for r in d.select(X.square_name(F.col("x"), F.col("y")).alias("n")).collect()]
    assert names == ["N42E017", "S24W001", "S24E125"]
    back = spark.createDataFrame([(n,) for n in names], "n string").select(X.square_lat(F.col("n")), X.square_lon(F.col("n")))
    assert [tuple(r) for r in back.collect()] == [(42, 17), (-24, -1), (-24, 125)]


def test_crossing_hand_cases(spark):
    got = joins.segment_crossings(seg_table(spark, [(1, 100, [(0, 0), (2, 0)]), (2, 125, [(1, -1), (1, 1)]), (3, 150, [(0, 5), (2, 5)]), (4, 175, [(2, 0), (3, 3)])]), 1.0)
    assert [(r.way_a, r.way_b, r.x, r.y) for r in got.collect()] == [(1, 2, 1.0, 0.0)]


def test_crossings_deal_segments_once(spark):
    segs = seg_table(spark, [(1, 100, [(0, 0), (2, 0)]), (2, 125, [(1, -1), (1, 1)])])
    assert "Join" not in joins.segment_crossings(segs, 1.0)._jdf.queryExecution().executedPlan().toString()


def test_crossings_are_told_by_sides(spark):
    segs = seg_table(spark, [(1, 100, [(0, 0), (2, 0)]), (2, 125, [(1, -1), (1, 1)])]).drop("ele")
    assert rows(joins.segment_crossings(segs, 1.0)) == [(1, 2, 0, 0, 1.0, 0.0)]  # what is not asked for is not dealt
    ends = np.random.default_rng(3).uniform(0, 3000, (4, 300))
    i, j = np.triu_indices(300, 1)
    hit, x, y = tiles.cross(ends, i, j)
    got = [np.stack(b) for b in tiles.crossing_blocks(np.arange(300), ends, np.zeros((2, 300), np.int64), (0, 0))]
    assert sorted(np.concatenate(got, axis=1).T.tolist()) == sorted(np.stack([i, j, x, y])[:, hit].T.tolist())


def test_crossings_are_rounded_as_in_sql(spark, monkeypatch):
    found = spark.createDataFrame([(1, 2, 0, 0, 1.0005, -2.0015), (1, 2, 0, 1, 9234665.204499999, 0.0)], "way_a long, way_b long, seq_a int, seq_b int, x double, y double")
    monkeypatch.setattr(joins, "segment_crossings", lambda segs: found)
    monkeypatch.setattr(Fixture, "segment", lambda t: spark.range(1).withColumn("ele", F.lit(0.0)))
    got = [(r.x, r.y) for r in catalogue.QUERIES["d2_segment_crossings"](spark, "").collect()]
    con = pytest.importorskip("duckdb").connect()
    assert got == [tuple(con.execute("SELECT round(?::DOUBLE, 3), round(?::DOUBLE, 3)", [r.x, r.y]).fetchone()) for r in found.collect()]


def test_offenders_are_counted_in_tiles(spark):
    rng = random.Random(11)
    lines = [(w, 100, [(rng.randrange(-40, 40), rng.randrange(-40, 40)) for _ in range(rng.randrange(2, 9))]) for w in range(60)]
    lines.append((90, 100, [(-500, 3), (500, 4)]))  # over many tiles
    segs = seg_table(spark, lines)
    got = joins.crossing_offenders(segs, 4.0)
    assert rows(got) == rows(joins.offenders(joins.crossing_points(joins.segment_crossings(segs, 7.0))))
    assert "way_a" not in got._jdf.queryExecution().executedPlan().toString()  # no pair goes through an exchange


def test_offenders_are_counted_as_bits(monkeypatch):
    rng = np.random.default_rng(5)
    for trial, (scale, at) in enumerate([(3000, 9e6), (3000, 0), (30, 0), (3, 9e6), (1, 0)]):
        lines = [rng.uniform(0, scale, (300 if (trial, w) == (1, 3) else rng.integers(2, 9), 2)) + at for w in range(40)]
        lines = [np.rint(p * 20) / 20 if trial == 2 else p for p in lines]
        way = np.repeat(np.arange(40) * 7 + 1, [len(p) - 1 for p in lines])
        ends = np.concatenate([np.concatenate([p[:-1], p[1:]], axis=1) for p in lines]).T
        i, j = np.triu_indices(len(way), 1)
        hit, x, y = tiles.cross(ends, i, j)
        hit &= way[i] != way[j]
        points = {(min(a, b), max(a, b), u, v) for a, b, u, v in zip(way[i[hit]].tolist(), way[j[hit]].tolist(), np.rint(x[hit] * 10).tolist(), np.rint(y[hit] * 10).tolist())}
        both = [(w, p) for a, b, *_ in points for w, p in ((a, b), (b, a))]
        count, apart = Counter(w for w, _ in both), Counter(w for w, _ in set(both))
        want = {w: (apart[w], count[w]) for w in count}
        exact, real = [], tiles.cross
        monkeypatch.setattr(tiles, "cross", lambda e, i, j: (exact.append(len(i)), real(e, i, j))[1])
        ids, partners, crossings = tiles.tile_offenders(way, ends, np.zeros((2, len(way)), np.int64), (0, 0))
        monkeypatch.undo()
        assert {w: (p, c) for w, p, c in zip(ids.tolist(), partners.tolist(), crossings.tolist()) if p} == want
        assert trial or sum(exact) < hit.sum() / 4  # no list of crossings is made


def test_crossings_are_brute_force(spark):
    rng = random.Random(1)
    lines = [(w, w * 5, [(rng.uniform(0, 50), rng.uniform(0, 50)) for _ in range(4)]) for w in range(30)]
    got = {(r.way_a, r.way_b, r.seq_a, r.seq_b) for r in joins.segment_crossings(seg_table(spark, lines), 7.0).collect()}
    side = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
    want = set()
    for i, _, p in lines:
        for j, _, q in lines:
            for s in range(3):
                for t in range(3):
                    a, b, c, d = p[s], p[s + 1], q[t], q[t + 1]
                    if i < j and side(c, d, a) * side(c, d, b) < 0 and side(a, b, c) * side(a, b, d) < 0:
                        want.add((i, j, s, t))
    assert got == want and want


def test_self_crossing_and_pinch(spark):
    s = seg_table(spark, [(1, 1, [(0, 0), (4, 0), (4, 4), (2, 4), (2, -2)]), (2, 1, [(0, 0), (9, 0), (9, 9), (0, 9), (0, 0)])])
    assert rows(joins.self_crossings(s, 3.0)) == [(1, 0, 3)]
    n = spark.createDataFrame([(1, i, x) for i, x in enumerate("abcdbe")] + [(2, i, x) for i, x in enumerate("abca")], "way_id long, seq int, node_id string")
    assert rows(joins.pinches(n)) == [(1, "b", 1, 4)]


def test_nearest_point_widens_until_sure(spark):
    rng = random.Random(2)
    a = [(i, rng.uniform(0, 100), rng.uniform(0, 100)) for i in range(40)]
    b = [(i, rng.uniform(0, 20), rng.uniform(0, 20)) for i in range(9)]
    got = {r.point_id: round(r.d, 9) for r in joins.nearest_point(spark.createDataFrame(a, "point_id long, x double, y double"), spark.createDataFrame(b, "other_id long, x double, y double"), 3.0).collect()}
    assert got == {i: round(min(math.hypot(x - u, y - v) for _, u, v in b), 9) for i, x, y in a}


def test_climbs_and_grades(spark):
    z = {1: [100, 90, 95, 80], 2: [100, 90, 95, 99], 3: [100, 95, 99, 90, 92, 80], 4: [100, float("nan"), 90, 80]}
    p = spark.createDataFrame([(k, i, float(v)) for k, vs in z.items() for i, v in enumerate(vs)], "way_id long, seq int, z double")
    assert sorted((r.way_id, r["first"], r["last"]) for r in sequences.climbing_intervals(p, "way_id").collect()) == [(1, 2, 2), (2, 2, 3), (3, 2, 2), (3, 4, 4)]
    known = spark.createDataFrame([(1, 0.0, 0.0), (1, 30.0, 0.0), (1, 60.0, 1.0), (1, 90.0, 0.0), (2, 0.0, 50.0), (2, 20000.0, 60.0), (2, 21000.0, 0.0)], "way_id long, d double, ele double")
    at = spark.createDataFrame([(1, i, i * 10.0) for i in range(10)] + [(2, 0, 10000.0), (2, 1, 20500.0)], "way_id long, seq int, d double")
    graded, rejected = sequences.grade_between(known, at, "way_id")
    level = {(r.way_id, r.seq): r.level for r in graded.collect()}
    assert level[1, 3] == 0 and level[1, 6] == 1 and level[1, 4] is level[1, 5] is None and level[2, 0] is None and level[2, 1] == 30.0
    assert rows(rejected.select("way_id", "d0", "d1")) == [(1, 30.0, 60.0), (2, 0.0, 20000.0)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.floats(0, 3000), min_size=2, max_size=40))
def test_fixing_adds_no_climb(z):
    out = kernels.linear_fix(np.array(z))
    assert sum(b > a for a, b in zip(out, out[1:])) <= sum(b > a for a, b in zip(z, z[1:])) and out[-1] >= z[-1]
    assert kernels.climbs(np.array(sorted(z, reverse=True))) == []


def test_profiles_by_hand():
    nan = float("nan")
    for z, want in (([100, 90, 95, 80], [(2, 2)]), ([100, 90, 95, 99], [(2, 3)]), ([100, 95, 99, 90, 92, 80], [(2, 2), (4, 4)]), ([100, nan, 90, 80], []), ([50, 50, 50, 50], []), ([100, 90, 95, nan, 80], [(2, 3)]), ([], []), ([nan, nan], [])):
        assert kernels.climbs(np.array(z, float)) == want
    assert kernels.linear_fix([100, 90, 95, 99]).tolist() == [100, 90, 95, 99]  # the mouth is never lowered
    assert kernels.linear_fix([100, 50, 60, 70])[-1] == 70
    assert kernels.linear_fix([100, 90, 95, 80]).tolist() == [100, 90, 85, 80] and kernels.linear_fix([100, 90, 97, nan, 80]).tolist() == [100, 90, 90 - 10 / 3, 90 - 20 / 3, 80]


def test_ladders(spark):
    def infer(levels):
        d = spark.createDataFrame([("s", float(v), n) for v, n in levels], "square string, ele double, ways long")
        return [tuple(r)[1:] for r in ladder.infer(d, "square").collect()]

    assert infer([(v, 1) for v in (100, 125, 175, 200, 3, 7)]) == [(25.0, 0.0)]
    assert infer([(v, 1) for v in (0, 10, 20, 40, 60)]) == [(20.0, 0.0)]
    assert infer([(v, n) for v, n in ((0, 1), (10, 1), (20, 1), (40, 40), (60, 40))]) == [(20.0, 0.0)]
    assert infer([(100, 2)]) == [] and infer([]) == []
    assert infer([(10, 1), (35, 1), (60, 1), (75, 40), (100, 40)]) == [(25.0, 0.0)]  # the phase that carries most ways

    def notches(levels):
        d = spark.createDataFrame([("s", float(v), 1) for v in levels], "square string, ele double, ways long")
        return ladder.inferred(d, "square").first()

    got = notches((100, 125, 175, 200, 3, 7))
    assert got.interval == 25 and 150 in got.notches and [n for n in got.notches if n < 100] == [0, 3, 7, 25, 50, 75] and got.notches[-1] == 300 and got.present == [3, 7, 100, 125, 175, 200]
    one = lambda c: spark.range(1).select(c.alias("n")).first().n
    assert one(ladder.regular(F.lit(50), F.lit(1), F.lit(151))) == [-49, 1, 51, 101, 151]
    assert one(ladder.regular(F.lit(50), F.lit(0), F.lit(100))) == [0, 50, 100] and one(ladder.regular(F.lit(50), F.lit(151), F.lit(60)))[:2] == [-49, 1] and one(ladder.regular(F.lit(50), F.lit(0), F.lit(-1))) == []
    quarter = F.array(*(F.lit(float(v)) for v in (0, 25, 50, 75, 100)))
    assert one(ladder.covering(F.lit(160), quarter, F.lit(25.0)))[-3:] == [125, 150, 160] and one(ladder.covering(F.lit(-30), quarter, F.lit(25.0)))[:3] == [-30, -25, 0] and one(ladder.covering(F.lit(50), quarter, F.lit(25.0))) == [0, 25, 50, 75, 100]
    assert one(ladder.around(F.lit(30.0), quarter)) == (25, 50, 25) and one(ladder.around(F.lit(0.0), quarter)).below is None
    assert ladder.level_bands("10:50,25:200,50") == [(10, 50), (25, 200), (50, None)]
    assert one(ladder.band_levels(ladder.level_bands("10:50,25:200,50"), F.lit(260.0))) == [0, 10, 20, 30, 40, 50, 75, 100, 125, 150, 175, 200, 250]
    for bad in ("10:50", "0", "10,20", "10:50,5:40,50"):
        with pytest.raises(ValueError):
            ladder.level_bands(bad)
    keys = spark.createDataFrame([(q, "z" if q != "d" else "y") for q in "abcd"], "square string, zone string")
    over = spark.createDataFrame([("a", 5.0, 0.0, [0.0, 5.0])], "square string, interval double, phase double, notches array<double>")
    found = spark.createDataFrame([(q, v, 1) for q in "ab" for v in (0.0, 20.0)], "square string, ele double, ways long")
    zone = spark.createDataFrame([("z", 40.0, 0.0, 80.0)], "zone string, interval double, base double, top double")
    assert [(r.square, r.interval, r.source, len(r.notches)) for r in ladder.ladder_for(keys, over, found, zone, "square").orderBy("square").collect()] == [("a", 5, "square", 2), ("b", 20, "inferred", 6), ("c", 40, "zone", 3), ("d", 10, "default", 21)]


def test_split_keeps_the_line(spark):
    n = spark.createDataFrame([(w, i, 100 * w + i) for w, k in ((1, 11), (2, 4), (3, 7), (4, 1)) for i in range(k)], "way_id long, seq int, node_id long")
    pieces = {}
    for r in sequences.split_ways(n, 4).collect():
        pieces.setdefault((r.way_id, r.piece), []).append(r.node_id)
    assert all(len(p) <= 4 for p in pieces.values())
    for w, k in ((1, 11), (2, 4), (3, 7), (4, 1)):
        mine = [sorted(p) for (i, _), p in sorted(pieces.items()) if i == w]
        assert all(a[-1] == b[0] for a, b in zip(mine, mine[1:])) and sorted(set(sum(mine, []))) == [100 * w + i for i in range(k)]


def full(spark, a):
    return spark.createDataFrame([(i, j, None if np.isnan(v) else float(v)) for (i, j), v in np.ndenumerate(np.array(a, float))], "row int, col int, v double")


def grid(df, shape, name):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.row, r.col] = np.nan if r[name] is None else r[name]
    return out


def test_raster_neighbours(spark):
    rng = np.random.default_rng(0)
    a = rng.uniform(0, 50, (9, 12))
    gy, gx = np.gradient(a, 90.0)
    assert np.allclose(grid(raster.slope(full(spark, a), 90.0), a.shape, "slope"), np.degrees(np.arctan(np.hypot(gx, gy))))
    s = grid(raster.box_smooth(full(spark, a)), a.shape, "v")
    assert math.isclose(s[4, 5], a[2:7, 3:8].mean()) and math.isclose(s[0, 0], a[:3, :3].mean())
    shade = grid(raster.hillshade(full(spark, a), 90.0, 2), a.shape, "shade")
    assert (shade[0] == 0).all() and (shade[1:-1, 1:-1] >= 1).all()
    d2 = grid(raster.nearest_seed(full(spark, a), full(spark, a).where("v > 45"), 3), a.shape, "d2")
    seeds = np.argwhere(a > 45)
    for (i, j), v in np.ndenumerate(d2):
        best = ((seeds - (i, j)) ** 2).sum(1).min()
        assert (v == best) if best <= 9 else np.isnan(v)


def test_ramp_difference_span(spark):
    stops = [(0.0, 0, 0, 0, 0), (1.0, 17, 120, 3, 255), (200.0, 152, 190, 114, 255), (6000.0, 255, 255, 255, 255)]
    got = [tuple(r)[2:] for r in raster.ramp_colour(full(spark, [[0, 1, 200, 9000]]), stops).orderBy("col").collect()]
    assert got == [(0, 0, 0, 0), (17, 120, 3, 255), (152, 190, 114, 255), (255, 255, 255, 255)]
    dem, pub = full(spark, [[10, 0, 0, 5, 0]]), full(spark, [[7, 0, 1, 0, -3]]).withColumn("v", F.when(F.col("col") == 3, float("nan")).otherwise(F.col("v")))
    d = [r.d for r in raster.difference(dem, pub).orderBy("col").collect()]
    assert d[:3] == [3, 0, -1] and math.isnan(d[3]) and d[4] == 0
    for v, want in ((130, 150), (10.02, 10), (31.6, 40), (0.3, 5), (70, 80), (55, 60)):
        assert raster.span(spark.createDataFrame([(float(v),)] * 3, "d double")).first().span == want


def test_land_clamp_and_regions(spark):
    a = np.full((6, 6), 20.0)
    a[0, 0] = a[0, 1] = a[1, 0] = 0  # open to the edge
    a[3, 3] = 0  # enclosed
    a[4, 1] = -5
    got = grid(raster.land_clamp(full(spark, a).withColumnRenamed("v", "d"), full(spark, a).where("row = 5 AND col = 5"), full(spark, a).where("row = 2 AND col = 4"), full(spark, a).where("row = 1 AND col = 0"), (6, 6), graph.connected_components), a.shape, "v")
    assert got[0, 0] == got[0, 1] == 0 and got[1, 0] == 1 and got[3, 3] == 1 and got[4, 1] == 1 and got[2, 4] == 0 and got[5, 5] == 20
    m = dict(((r.row, r.col), r.region) for r in raster.regions(full(spark, a).where("v = 0"), graph.connected_components).collect())
    assert len(set(m.values())) == 2 and m[0, 0] == m[0, 1] == m[1, 0]


def test_envelope_snaps_to_its_square(spark):
    for r0, r1, c0, c1, want in ((2, 16, 3, 18, (0, 20, 0, 20)), (8, 11, 4, 15, (8, 12, 4, 16))):
        c = spark.createDataFrame([(r, k) for r in (r0, r1) for k in (c0, c1)], "row int, col int")
        assert tuple(raster.envelopes(c, F.lit("s"), (F.lit(0), F.lit(0)), 20).first())[1:] == want


def test_interpolation_keeps_its_contract(spark):
    n = 41
    a = np.full((n, n), np.nan)
    r = np.hypot(*(np.indices((n, n)) - n // 2))
    for radius, level in ((18, 100), (12, 125), (6, 150)):
        a[np.abs(r - radius) < 0.75] = level
    whole = grid(kernels.interpolate(full(spark, a), 10, 64), a.shape, "v")
    tiled = grid(kernels.interpolate(full(spark, a), 10, 16), a.shape, "v")
    drawn = ~np.isnan(a)
    assert np.array_equal(whole[drawn], a[drawn]) and ((whole >= 100 - 1e-6) & (whole <= 150 + 1e-6))[r <= 18].all()
    ring = (r > 13) & (r < 17)
    assert np.allclose(whole[ring], tiled[ring]) and 100 < whole[ring].mean() < 125
    assert np.isnan(kernels.first_pass(np.where(a == 100, a, np.nan), np.ones_like(a, bool), 10)[n // 2, n // 2])


def test_interpolation_leaves_no_tiles(spark):
    a = np.full((9, 80), np.nan)
    a[:, 0], a[:, -1] = 100, 150
    for tile in (8, 16, 128):
        got = grid(kernels.interpolate(full(spark, a), 3, tile), a.shape, "v")
        assert np.allclose(got, np.linspace(100, 150, 80)[None, :], atol=1e-6)
    rng = np.random.default_rng(4)
    b = np.where(rng.random((30, 30)) < 0.03, rng.integers(1, 9, (30, 30)) * 10.0, np.nan)
    one, other = (grid(kernels.interpolate(full(spark, b), 2, tile), b.shape, "v") for tile in (5, 64))
    assert not np.isnan(one).any() and np.allclose(one, other, atol=1e-8)
    alone = spark.createDataFrame([(0, 0, None), (0, 1, None), (5, 5, 7.0), (5, 6, None)], "row int, col int, v double")
    assert rows(kernels.interpolate(alone.where("row = 5"), 2, 4)) == [(5, 5, 7.0), (5, 6, 7.0)]
    assert {(r.row, r.col): r.v for r in kernels.interpolate(alone, 2, 4).collect()} == {(0, 0): None, (0, 1): None, (5, 5): 7.0, (5, 6): 7.0}


def test_contours_of_a_plane(spark):
    a = np.add.outer(np.zeros(4), np.arange(5) * 10.0 + 5)
    s = kernels.contour_segments(full(spark, a), 10.0).collect()
    assert {(x.level, x.x0, x.x1) for x in s} == {(10.0 * k, k - 0.5, k - 0.5) for k in range(1, 5)} and len(s) == 12


def test_simplify_and_stitch(spark):
    x, y = np.array([0, 1, 2, 3, 4.0]), np.array([0, 0.01, 0, 2, 0])
    assert kernels.simplified(x, y, 0.1).tolist() == [True, False, True, True, True]
    assert kernels.stitched([[1, 2, 3], [3, 4, 1]]) == [[1, 2, 3, 4, 1]] and kernels.stitched([[1, 2], [2, 3]]) == []
    assert kernels.stitched([[1, 2, 3], [3, 4, 3], [3, 5, 1]]) == [[1, 2, 3, 5, 1]]  # a sliver is no ring
    two = kernels.stitched([[1, 2, 3], [3, 0, 7, 3], [3, 4, 1]])  # a ring stays whole
    assert sorted(sorted(set(r)) for r in two) == [[0, 3, 7], [1, 2, 3, 4]] and all(r[0] == r[-1] for r in two)
    pieces, rng = [[1, 2, 3], [3, 4, 1], [3, 5, 6], [6, 7, 3]], random.Random(3)
    first = {frozenset(r) for r in kernels.stitched(pieces)}
    for _ in range(25):
        some = [p[::-1] if rng.random() < 0.5 else p for p in rng.sample(pieces, 4)]
        assert {frozenset(r) for r in kernels.stitched(some)} == first
    xs, ys = np.array([0, 1, 2, 0, 5, 9.0]), np.array([0, 3, 0, 0, 0.01, 0])  # two lines at once
    assert kernels.simplified(xs, ys, 0.1, [0, 3, 6]).tolist() == [True, True, True, True, False, True]
    w = spark.createDataFrame([(7, [3, 4, 1]), (7, [1, 2, 3]), (8, [1, 2])], "relation long, refs array<long>")
    assert [(r.relation, r.refs) for r in kernels.stitch(w).collect()] == [(7, [1, 2, 3, 4, 1])]


def test_components(spark):
    e = spark.createDataFrame([(5, 4), (4, 3), (9, 8), (3, 1)] + [(i, i + 1) for i in range(20, 40)], "a long, b long")
    got = dict(rows(graph.connected_components(e)))
    assert got[5] == 1 and got[9] == 8 and got[40] == 20 and len(got) == 4 + 2 + 21
    assert dict(rows(graph.chains(spark.createDataFrame([(1, 10, 11), (2, 11, 12), (3, 12, 13), (4, 12, 14)], "way_id long, first long, last long")))) == {1: 1, 2: 1, 3: 3, 4: 4}


def test_tags_merge(spark):
    def merged(local, up):
        d = spark.createDataFrame([(local, up)], "l map<string,string>, u map<string,string>")
        return d.select(reconcile.merge_tags(F.col("l"), F.col("u"), ["natural", "water", "waterway", "name", "type"]).alias("m")).first().m

    assert merged({"waterway": "stream", "name": "mine", "note": "x"}, {"waterway": "river", "name": "Bosco"}) == {"waterway": "river", "name": "Bosco", "note": "x"}
    assert merged({"name": "old"}, {"waterway": "river"}) == {"waterway": "river"}
    assert merged({"ele": "120"}, {"natural": "water", "ele": "95"}) == {"natural": "water", "ele": "120"}
    assert merged({}, {"natural": "water", "ele": "95"})["ele"] == "95" and merged(None, {"name": "a", "x": "y"}) == {"name": "a"}
    ordered = reconcile.merge_tags(F.expr("map('note', 'x', 'ele', '120')"), F.expr("map('natural', 'water', 'water', 'lake', 'name', 'K')"), ["natural", "water", "waterway", "name", "type"])
    assert spark.range(1).select(F.map_keys(ordered).alias("k")).first().k == ["natural", "water", "name", "ele", "note"]


def test_an_import_lands(spark):
    node = lambda rows_: spark.createDataFrame(rows_, "node_id long, lon double, lat double, tags map<string,string>")
    way = lambda rows_: spark.createDataFrame(rows_, "way_id long, refs array<long>, tags map<string,string>")
    kind = "relation_id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>"
    local = {"node": node([(i, float(i), 0.0, {"a": "b"} if i == 5 else {}) for i in (1, 2, 3, 4, 5, 6, 7)]), "way": way([(100, [1, 2, 3, 4, 5, 6], {"waterway": "river", "ele": "9"}), (-1, [2, 4], {})]), "relation": spark.createDataFrame([(300, [("node", 6, "x")], {})], kind)}
    up = {"node": node([(1, 1.0, 0.0, {}), (2, 2.5, 0.0, {})]), "way": way([(100, [1, 2], {"waterway": "stream"})]), "relation": spark.createDataFrame([], kind)}
    out = reconcile.reconcile_square(local, up, ["waterway", "name"])
    assert rows(out["removed"]) == [(3,)]  # 4 is in use, 5 tagged, 6 a member, 7 on no way
    assert rows(out["moved"]) == [(-1,)] and [(r.refs, r.tags) for r in out["way"].collect()] == [([1, 2], {"waterway": "stream", "ele": "9"})]


def test_homes_stay_or_move(spark):
    n = spark.createDataFrame([("f", "b", 1), ("f", "b", 2), ("f", "a", 3), ("g", "a", 1), ("g", "b", 2), ("h", "a", 1)], "feature string, square string, node int")
    held = spark.createDataFrame([("f", "a"), ("g", "b"), ("h", "c")], "feature string, square string")
    assert dict(rows(reconcile.homes(n, held))) == {"f": "b", "g": "b", "h": "a"} and dict(rows(reconcile.homes(n, held, move=False))) == {"f": "a", "g": "b", "h": "c"}
    assert dict(rows(reconcile.homes(n, held.where("false")))) == {"f": "b", "g": "a", "h": "a"}


def test_edges_close_across_from_nothing(spark):
    def closed(mask, zone):
        z = spark.createDataFrame(sorted(zone), "lon int, lat int")
        m = full(spark, mask).withColumn("v", F.col("v").cast("int"))
        return grid(cellsets.close_edges(m, (13, 13), (24.875, 46.125, 0.25), (25, 43, 28, 46), z), (13, 13), "v")

    ones, every = np.ones((13, 13)), {(x, y) for x in range(24, 29) for y in range(42, 47)}
    out = closed(ones, {p for p in every if p != (24, 44) and p[1] != 46})
    assert out[0].sum() == 0 and out[5:9, 0].tolist() == [0] * 4 and out[9:12, 0].all() and out[1:5, 0].all() and out[1:, -1].all() and out[-1, 1:].all() and out[1:-1, 1:-1].all()
    out = closed(ones, {(x, y) for x in range(25, 28) for y in range(43, 46)})
    assert not (out[0].any() or out[-1].any() or out[:, 0].any() or out[:, -1].any()) and out[1:-1, 1:-1].all()
    bare = ones.copy()
    bare[0, :], bare[:, -1], bare[1, 3] = 0, 0, 0
    out = closed(bare, every)
    assert out[0, 1:-1].tolist() == [1, 1, 0] + [1] * 8 and out[1:, -1].all()
    out = closed(ones, every - {(24, 45)})
    assert out[0, 0] == 0 and out[0, 1:].all()


def test_rays_doubles_forks_and_bodies(spark):
    star = seg_table(spark, [(1, 10, [(4, -1), (4, 0)]), (2, 20, [(0, 4), (1, 9)]), (3, 30, [(-4, -4), (-4, 4)]), (4, 40, [(-9, -4), (9, -4)]), (5, 50, [(3, 3), (9, 1)])])
    got = joins.rays(spark.createDataFrame([(1, 0.0, 0.0)], "point_id long, x double, y double"), star, 20.0, 6, 5.0).collect()
    assert [(r.n, r.low, r.high) for r in got] == [(8, 10, 50)]  # ends on a ray, and touched ends, are met
    pts = [(-1, 0, 5.0, 0.0, 0.5), (-1, 1, 5.0, 9.0, 0.5), (-2, 0, 5.0, 0.0, 0.5), (-2, 1, 5.0, 50.0, 50.0), (-3, 0, 6.0, 0.0, 0.0)]
    p = spark.createDataFrame(pts, "way_id long, seq int, ele double, x double, y double")
    assert rows(joins.doubled_ways(p, seg_table(spark, [(7, 5, [(0, 0), (4, 0)]), (8, 5, [(6, 0), (10, 0)])]), 1.0, 5.0)) == [(-1,)]  # under the union of two
    line = spark.createDataFrame([(1, i, n, 10.0) for i, n in enumerate((1, 2, 3))] + [(2, i, n, 10.0) for i, n in enumerate((2, 5))] + [(3, i, n, 10.0) for i, n in enumerate((3, 6, 7, 3))], "way_id long, seq int, node_id long, ele double")
    assert rows(joins.forks(line)) == [(2, 10.0, 3, 2), (3, 10.0, 3, 2)]
    ring = spark.createDataFrame([(9, *a, *b) for a, b in zip([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)], [(10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0)])], "ring_id long, ax double, ay double, bx double, by double")
    own = spark.createDataFrame([(9, 100)], "ring_id long, node_id long")
    lines = {1: [(5, 5), (6, 6)], 2: [(-1, 5), (11, 5)], 3: [(20, 20), (30, 30)], 4: [(5, 5), (20, 5)]}
    pts = spark.createDataFrame([(w, i, 100 if w == 4 else 10 * w + i, float(x), float(y)) for w, ps in lines.items() for i, (x, y) in enumerate(ps)], "way_id long, seq int, node_id long, x double, y double")
    inside = joins.lines_in_rings(pts, seg_table(spark, [(w, 10 * w, ps) for w, ps in lines.items() if w != 4]), ring, own, 7.0)
    assert rows(inside) == [(9, 1), (9, 2)]
    assert rows(joins.spanned(inside, spark.createDataFrame([(w, 10.0 * w) for w in lines], "way_id long, ele double"))) == [(9, 2, 10.0, 20.0)]
    assert rows(joins.held_lakes(spark.createDataFrame([(9, 5.0), (8, 5.0), (7, None)], "ring_id long, ele double"), inside)) == [(8, 5.0)]


def test_edits_undo(spark):
    w = spark.createDataFrame([(1, [1, 2, 3, 4], {}), (2, [4, 5, 6], {}), (3, [7, 8, 9, 7], {})], "way_id long, refs array<long>, tags map<string,string>")
    refs = lambda d: {r.way_id: r.refs for r in d.collect()}
    ids = w.where("way_id = 1").select("way_id")
    assert refs(edits.reverse_ways(edits.reverse_ways(w, ids), ids)) == refs(w)
    cut = edits.split_way(w, ids.selectExpr("way_id", "2 AS at", "-1L AS new_id"))
    assert refs(cut) == {1: [1, 2, 3], -1: [3, 4], 2: [4, 5, 6], 3: [7, 8, 9, 7]}
    assert refs(edits.join_ways(cut, ids.selectExpr("way_id", "-1L AS b"))) == refs(w)
    assert refs(edits.join_ways(w, ids.selectExpr("way_id", "2L AS b")))[1] == [1, 2, 3, 4, 5, 6]
    assert refs(edits.rotate_rings(w, w.where("way_id = 3").selectExpr("way_id", "1 AS at")))[3] == [8, 9, 7, 8]
    assert refs(edits.delete_nodes(w, spark.createDataFrame([(7,), (5,), (6,)], "node_id long"))) == {1: [1, 2, 3, 4], 3: [8, 9]}
    assert refs(edits.insert_nodes(w, ids.selectExpr("way_id", "1 AS at", "99L AS node")))[1] == [1, 99, 2, 3, 4]
    assert 3 not in refs(edits.delete_nodes(w, spark.createDataFrame([(7,), (8,)], "node_id long")))
    assert refs(edits.splice_ways(w, ids.selectExpr("way_id", "0 AS lo", "2 AS hi", "2L AS other"))) == {1: [4, 5, 6, 4], 3: [7, 8, 9, 7]}
    assert refs(edits.replace_ways(w, ids.selectExpr("way_id", "array(8L, 9L) AS new_refs")))[1] == [8, 9]
    levels = edits.set_levels(w, spark.createDataFrame([(1, "25"), (2, None)], "way_id long, ele string"), "way_id")
    assert {r.way_id: r.tags for r in levels.collect()} == {1: {"ele": "25"}, 2: {}, 3: {}}
    kind = "relation_id long, members array<struct<type:string,ref:long,role:string>>, tags map<string,string>"
    rel = spark.createDataFrame([(1, [("way", 1, "outer"), ("way", 2, "inner")], {"natural": "water"}), (2, [("way", 2, "outer")], {"natural": "water", "type": "x"}), (3, [("way", 1, "label")], {"natural": "water"})], kind)
    assert {r.relation_id: r.tags.get("type") for r in edits.type_water_relations(rel).collect()} == {1: "multipolygon", 2: "x", 3: None}
    cut = spark.createDataFrame([(1, [1, -5])], "way_id long, pieces array<long>")
    assert {r.relation_id: [(m.ref, m.role) for m in r.members] for r in edits.mend_members(rel, cut).collect()}[1] == [(1, "outer"), (-5, "outer"), (2, "inner")]
    left, ways_left = edits.delete_relation_with_parts(rel.where("relation_id < 3"), w, spark.createDataFrame([(1,)], "relation_id long"))
    assert [r.relation_id for r in left.collect()] == [2] and sorted(refs(ways_left)) == [2, 3]
    fill = spark.createDataFrame([(1, [1, 2], {"a:fill": "x"}), (2, [2, 3], {})], "way_id long, refs array<long>, tags map<string,string>")
    kept, nodes = edits.drop_fill_lines(fill, spark.createDataFrame([(1,), (2,), (3,)], "node_id long"), "a:fill")
    assert refs(kept) == {2: [2, 3]} and rows(nodes) == [(2,), (3,)]
    assert refs(edits.compound({"way": w}, [lambda s: {"way": edits.reverse_ways(s["way"], ids)}] * 2)["way"]) == refs(w)
    assert refs(edits.replace_section(w, ids.selectExpr("way_id", "1 AS lo", "2 AS hi", "array(50L) AS nodes")))[1] == [1, 50, 4]


def test_square_files_round_trip(spark, tmp_path):
    body = """<osm version="0.6"><node id="1" lat="42.25" lon="17.5" version="2"><tag k="ele" v="5 &lt; 6"/></node><node id="-2" lat="42.1" lon="17.1"/>
    <way id="7" version="1"><nd ref="1"/><nd ref="-2"/><nd ref="99"/><tag k="ele" v="100"/></way><relation id="3"><member type="way" ref="7" role="outer"/></relation></osm>"""
    (tmp_path / "N42E017.osm.xz").write_bytes(lzma.compress(body.encode()))
    (tmp_path / "N43E017.osm").write_text(body)
    e = osm.read_elements(spark, str(tmp_path / "N4*"))
    assert rows(e.groupBy("square", "kind").count()) == [(s, k, n) for s in ("N42E017", "N43E017") for k, n in (("node", 2), ("relation", 1), ("way", 1))]
    assert osm.coords(osm.ways(e), osm.nodes(e)).count() == 4
    text = {r.square: r.text for r in osm.square_texts(e).collect()}
    (tmp_path / "again").mkdir()
    (tmp_path / "again" / "N42E017.osm").write_text(text["N42E017"])
    again = osm.read_elements(spark, str(tmp_path / "again"))
    assert osm.square_texts(again).first().text == text["N42E017"] and again.where("kind = 'node' AND tags['ele'] = '5 < 6'").count() == 1
    change = e.where("square = 'N43E017'").withColumn("op", F.when(F.col("kind") == "way", "delete").otherwise("modify"))
    (tmp_path / "N43E017.osc").write_text(osm.change_texts(change).first().text)
    assert rows(osm.read_elements(spark, str(tmp_path / "*.osc")).groupBy("op").count()) == [("delete", 1), ("modify", 3)]


def test_answers_that_were_cut_short_are_refused(spark):
    good = '{"elements": [{"type": "node", "id": 1, "lat": 1.5, "lon": 2.5, "tags": {"ele": "3"}}]}'
    assert osm.answer_elements(spark.createDataFrame([(good,)], "value string")).first().id == 1
    with pytest.raises(Exception, match="incomplete answer"):
        osm.answer_elements(spark.createDataFrame([('{"remark": "runtime error: timed out", "elements": []}',)], "value string")).collect()
    t = osm.territories(spark.createDataFrame([('{"rel": 4, "rings": [[[1, 2], [3, 4], [5, 6]], [[1, 2]]]}',)], "value string"))
    assert [(r.ring, r.lon, r.lat) for r in t.orderBy("seq").collect()] == [(0, 2.0, 1.0), (0, 4.0, 3.0), (0, 6.0, 5.0)]


def test_parameters_must_all_be_there(tmp_path, spark):
    p = tmp_path / "p.toml"
    p.write_text("radius_m = 1850\nbarrier = 2\ngrad_min = 0.02\nmax_mem_mb = 500\nsmooth = 5\ncontour_step = 10\n")
    assert params.Params.load(p).radius_m == 1850
    p.write_text("radius_m = 1850\n")
    with pytest.raises(KeyError, match="barrier"):
        params.Params.load(p)
    p.write_text("[N20E086]\ninterval = 25\n")
    assert rows(params.ladder_overrides(spark, p)) == [("N20E086", 25.0, 0.0)]


def test_listing(spark):
    names = spark.createDataFrame([("N20E086.osm",), ("N20E086.osm.xz",), ("N21E086.osm.xz",), ("EMPTY",)], "name string")
    s = listing.squares_of(names)
    assert rows(listing.duplicates(s)) == [("N20E086", 2, 1)] and [r.name for r in listing.loose(s).collect()] == ["N20E086.osm"]
    sq = spark.createDataFrame([("N00W180",), ("S01E179",), ("N05E000",)], "square string")
    assert {r.square for r in listing.working_set(sq, 179, 0).collect()} == {"N00W180", "S01E179"}


def test_stream_of_edits_equals_a_batch(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    live = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stream.windowed(live, "1 hour", "60 days").writeStream.outputMode("complete").format("memory").queryName("edit_windows").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    pick = lambda d: sorted((str(r.window.start), r.event_type, r.n) for r in d.collect())
    assert pick(spark.sql("SELECT * FROM edit_windows")) == pick(stream.windowed(src, "1 hour"))
    assert stream.gestures(src, "10 minutes").agg(F.sum("n")).first()[0] == src.count()


def test_kept_index_equals_a_whole_run(spark, tmp_path):
    n = spark.createDataFrame([(w, i, (w * i) % 3) for w in range(6) for i in range(5)], "way_id long, seq int, node_id long")
    step = stream.kept_index(str(tmp_path / "ix"), ["way_id"], joins.pinches, lambda touched: n.join(touched, "way_id", "left_semi"))
    step(n.select("way_id"), 0)
    n = n.withColumn("node_id", F.when(F.col("way_id") == 2, F.col("seq").cast("long")).otherwise(F.col("node_id")))
    step(n.where("way_id = 2").select("way_id"), 1)
    assert rows(spark.read.parquet(str(tmp_path / "ix" / "1"))) == rows(joins.pinches(n))


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["way_id", "partners", "crossings"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_catalogue_takes_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    t, run = Fixture(spark, sf), lambda name: rows(catalogue.QUERIES[name](spark, sf))
    way = t.way().select("square", "way_id").collect()
    files = Counter(r.square for r in way)
    packed = Counter(r.square for r in way if r.way_id % 2 == 0)
    assert run("a3_duplicate_squares") == sorted((q, n, packed[q]) for q, n in files.items() if n > 1)
    ways = {}
    for r in t.line().select("square", "ele", "way_id").collect():
        ways.setdefault(r.square, {}).setdefault(r.ele, set()).add(r.way_id)
    want = []
    for square, by in ways.items():
        gaps = {}
        for a, b in zip(sorted(by), sorted(by)[1:], strict=False):
            gaps.setdefault(b - a, []).append(len(by[a]) + len(by[b]))
        if gaps:
            interval = max(gaps, key=lambda g: (len(gaps[g]), sum(gaps[g]), g))
            phases = Counter()
            for e, held in by.items():
                phases[e % interval] += len(held)
            want.append((square, interval, max(phases, key=lambda p: (phases[p], -p))))
    assert run("f3_infer_ladder") == sorted(want)
    root = {}

    def top(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for r in t.table("customer").select("c_custkey").collect():
        a, b = r[0], (r[0] * 7 + 3) % 1500 // 10 * 10
        if a != b:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    assert run("j5_components") == sorted((v, top(v)) for v in root)
    cells = {}
    for r in t.table("lineitem").collect():
        cells.setdefault((r.l_partkey % 64, r.l_suppkey % 64), []).append((0, r.l_orderkey * 100000 + r.l_partkey * 10 + r.l_linenumber, r.l_quantity))
    for r in t.table("part").collect():
        cells.setdefault((r.p_partkey % 64, r.p_partkey // 64 % 64), []).append((2, r.p_partkey, float(r.p_size)))
    for i in range(16):
        cells.setdefault((20 + i // 4, 20 + i % 4), []).append((1, 0, 99.0))
    assert run("e2_rasterise") == sorted((*at, max(burned)[2]) for at, burned in cells.items())


def test_rays_meet_the_same_in_any_cells_and_broadcast_nothing(spark, capsys):
    rng = random.Random(5)
    lines = [(w, rng.randrange(9), [(rng.uniform(0, 60), rng.uniform(0, 60)) for _ in range(3)]) for w in range(60)]
    pts = spark.createDataFrame([(i, rng.uniform(0, 60), rng.uniform(0, 60)) for i in range(40)], "point_id long, x double, y double")
    segs = seg_table(spark, lines)
    whole = rows(joins.rays(pts, segs, 25.0, 1, 1000.0))
    assert len(whole) == 40
    near = segs.selectExpr("ele", *(f"{c} / 10 AS {c}" for c in ("ax", "ay", "bx", "by")))
    small = pts.selectExpr("point_id", "x / 10 AS x", "y / 10 AS y")
    assert rows(joins.rays(small, near, 0.5, 1, 1.0)) == rows(joins.rays(small, near, 0.5, 1, 1000.0))  # several cells
    cut = joins.rays(pts, segs, 25.0, 1, 4.0)
    cut.explain()
    assert "Broadcast" not in capsys.readouterr().out and rows(cut) == whole
    brute = {}
    for i, x, y in (tuple(p) for p in pts.collect()):
        for k, (u, v) in enumerate([(math.cos(a * math.pi / 4) * 25, math.sin(a * math.pi / 4) * 25) for a in range(8)]):
            for _, e, p in lines:
                for (ax, ay), (bx, by) in zip(p, p[1:], strict=False):
                    den = u * (by - ay) - v * (bx - ax)
                    t, on = ((ax - x) * (by - ay) - (ay - y) * (bx - ax)) / den, ((ax - x) * v - (ay - y) * u) / den
                    if 0 < t <= 1 and 0 <= on <= 1:
                        brute[i, k] = min(brute.get((i, k), (9.0, 0)), (t, e))
    for i, n, levels, low, high in whole:
        e = [v[1] for (j, _), v in brute.items() if j == i]
        assert (n, levels, low, high) == (len(e), len(set(e)), min(e), max(e))


def test_nearest_seed_without_seeds_is_as_its_sql(spark, tmp_path):
    import duckdb

    spark.createDataFrame([(i, i, 1.0 if low else 11.0) for low in (True, False) for i in range(64)], "l_partkey long, l_suppkey long, l_quantity double").where("l_quantity < 5").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalogue.QUERIES["e8_nearest_seed"](spark, str(tmp_path))
    db = duckdb.connect()
    for name in ("orders", "part"):
        db.execute(f"CREATE VIEW {name} AS FROM '/root/testdata/sf0.001/{name}.parquet'")
    keys = "l_orderkey l_linenumber l_extendedprice".split()
    db.execute(f"CREATE VIEW lineitem AS SELECT *, {', '.join(f'0::BIGINT AS {k}' for k in keys)} FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert rows(got) == sorted(db.execute(catalogue.SQL["e8_nearest_seed"]).fetchall()) == []
    none = raster.nearest_seed(full(spark, [[1.0, 2.0]]), full(spark, [[1.0, 2.0]]).where("v > 10"), 2)
    assert [r.d2 for r in none.collect()] == [None, None]


def test_rings_with_lines_are_those_of_all_pairs_and_gather_no_vertex_of_a_crossed_ring(spark, monkeypatch):
    rng = random.Random(8)
    lines = [(w, 10.0, [(rng.uniform(0, 40), rng.uniform(0, 40)) for _ in range(2)]) for w in range(6)] + [(9, 10.0, [(55, 55), (56, 56)])]
    boxes = {100 + i: (rng.uniform(0, 38), rng.uniform(0, 38), 2.0) for i in range(40)} | {200: (50.0, 50.0, 10.0), 201: (80.0, 80.0, 2.0)}
    corner = {k: [(x, y), (x + d, y), (x + d, y + d), (x, y + d)] for k, (x, y, d) in boxes.items()}
    edges = spark.createDataFrame([(k, *c[i], *c[(i + 1) % 4]) for k, c in corner.items() for i in range(4)], "ring_id long, ax double, ay double, bx double, by double")
    pts = spark.createDataFrame([(w, i, 10 * w + i, float(x), float(y)) for w, _, ps in lines for i, (x, y) in enumerate(ps)], "way_id long, seq int, node_id long, x double, y double")
    own, segs = spark.createDataFrame([(201, 7)], "ring_id long, node_id long"), seg_table(spark, lines)
    every = {r.ring_id for r in joins.lines_in_rings(pts, segs, edges, own, 7.0).collect()}
    seen, real = [], joins.inside_rings
    monkeypatch.setattr(joins, "inside_rings", lambda p, e, size: (seen.append({r.ring_id for r in e.collect()}), real(p, e, size))[1])
    got = [r.ring_id for r in joins.rings_with_lines(pts, segs, edges, own, 7.0).collect()]
    assert sorted(got) == sorted(every) and 200 in every and 201 not in every
    assert 200 in seen[0] and len(seen[0]) < len(corner) and every - seen[0]  # crossed ones are settled before
