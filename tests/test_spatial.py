"""Grid joins against brute force, also on crowded and skewed input."""

import math
import random

import pytest

from kerbline.functions import geo
from kerbline.operators import skew, spatial
from pyspark.sql import functions as F


def metres(a, b, c, d):
    s1, s2 = math.sin(math.radians(c - a) / 2), math.sin(math.radians(d - b) / 2)
    root = s1 * s1 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * s2 * s2
    return 2 * geo.EARTH_M * math.asin(math.sqrt(min(root, 1.0)))


def brute_nearest(rows, targets, radius):
    out = {}
    for rid, lat, lon in rows:
        best = None
        if lat is not None and lon is not None:
            hits = [(metres(lat, lon, t[1], t[2]), t[0]) for t in targets]
            hits = [h for h in hits if h[0] <= radius]
            best = min(hits, default=None)
        out[rid] = (best[1], round(best[0], 5)) if best else (None, None)
    return out


def spread_points(rng, n, lat0, box):
    return [(i, lat0 + rng.uniform(0, box), -81 + rng.uniform(0, box)) for i in range(n)]


def run_nearest(spark, rows, targets, radius, **kw):
    r = spark.createDataFrame(rows, "row_id int, lat double, lon double")
    t = spark.createDataFrame(targets, "t_id int, lat double, lon double")
    got = spatial.nearest_join(r, t, radius, "t_id", **kw).collect()
    assert len(got) == len(rows)
    return {g.row_id: (g.target_id, None if g.distance_m is None else round(g.distance_m, 5)) for g in got}


@pytest.mark.parametrize("lat0", [-0.01, 34.3, 70.0, -84.0])
def test_nearest_equals_brute_force(spark, lat0):
    rng = random.Random(3)
    rows = spread_points(rng, 120, lat0, 0.02) + [(900, None, -81.0), (901, lat0, None)]
    targets = spread_points(rng, 150, lat0, 0.02)
    assert run_nearest(spark, rows, targets, 300.0) == brute_nearest(rows, targets, 300.0)


def test_nearest_on_cell_borders(spark):
    size = geo.band_height(200.0)
    rows = [(i, size * (700 + i % 4), -81.0 + size * (i // 4)) for i in range(16)]
    targets = [(i, size * (700 + i % 4) + 1e-9 * (-1) ** i, -81.0 + size * (i // 4) - 1e-9) for i in range(16)]
    assert run_nearest(spark, rows, targets, 200.0) == brute_nearest(rows, targets, 200.0)


@pytest.mark.parametrize("lat0", [34.3, 54.0])
def test_wide_search_looks_nearby_first(spark, monkeypatch, lat0):
    rng = random.Random(11)
    targets = spread_points(rng, 1500, lat0, 0.3)
    targets += [(2000 + i, lat, lon) for i, lat, lon in targets[:50]]
    # Some rows lie beside the targets, where only the last round or none finds one.
    rows = spread_points(rng, 100, lat0, 0.3) + [(100 + i, lat0 + 0.3 + 0.01 * i, -80.9) for i in range(10)]
    compared, pick = [], spatial._pick_nearest

    def counting(pairs, radius_m):
        compared.append(pairs.count())
        return pick(pairs, radius_m)

    monkeypatch.setattr(spatial, "_pick_nearest", counting)
    places = spatial._counted_places(spark.createDataFrame(rows, "row_id int, lat double, lon double"))
    held = spark.createDataFrame(targets, "t_id int, lat double, lon double")
    got = {}
    for limit in (0, 10**12):
        compared.clear()
        found = spatial.nearest_places(places, held, 5000.0, "t_id", cell_cap=1000, pairs_at_once=limit).collect()
        got[limit] = ({(g.q_lat, g.q_lon): g.target_id for g in found}, sum(compared))
    want = {(lat, lon): brute_nearest([(0, lat, lon)], targets, 5000.0)[0][0] for _, lat, lon in rows}
    assert got[0][0] == got[10**12][0] == {k: v for k, v in want.items() if v is not None}
    assert got[0][1] * 3 < got[10**12][1]


@pytest.mark.parametrize("cap", [1, 4, 25])
def test_crowded_cells_descend_to_the_same_answer(spark, cap):
    rng = random.Random(5)
    targets = [(i, 34.5 + rng.gauss(0, 1e-4), -80.9 + rng.gauss(0, 1e-4)) for i in range(200)]
    targets += [(200 + i, *targets[i][1:]) for i in range(40)]
    targets += [(500 + i, 34.48 + rng.uniform(0, 0.04), -80.92 + rng.uniform(0, 0.04)) for i in range(60)]
    rows = [(i, 34.48 + rng.uniform(0, 0.04), -80.92 + rng.uniform(0, 0.04)) for i in range(80)]
    rows += [(100 + i, 34.5, -80.9) for i in range(50)]
    assert run_nearest(spark, rows, targets, 2000.0, cell_cap=cap) == brute_nearest(rows, targets, 2000.0)


def test_tie_goes_to_smallest_id(spark):
    rows = [(1, 34.5, -80.9)]
    targets = [(9, 34.5, -80.9), (4, 34.5, -80.9), (7, 34.5, -80.9)]
    assert run_nearest(spark, rows, targets, 100.0) == {1: (4, 0.0)}


def test_hot_keys_are_found_and_salting_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 50)
    rows = [(i, "hot" if i % 3 == 0 else f"k{i}") for i in range(600)] + [(1000, None)]
    left = spark.createDataFrame(rows, "i int, k string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), ("zz", 4)], "k string, v int")
    hot = skew.hot_keys(left, ["k"])
    assert list(hot.values()) == [4]
    counted = left.where("k is not null").groupBy("k").count()
    assert skew.hot_counted(counted, ["k"], "count") == hot
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = left.join(right, ["k"], how)
        salted = skew.salted_join(left, right, ["k"], how, dict.fromkeys(hot, 7))
        assert sorted(map(str, salted.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    spread = skew.salted_join(left, right, ["k"], "left", dict.fromkeys(hot, 7))
    assert spread.count() == 600 + 200 + 1


def test_skewed_nearest_with_salted_joins(spark, monkeypatch):
    """A third of the rows at one place and a third of the targets in one cell."""
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 20)
    rng = random.Random(11)
    rows = [(i, 34.5, -80.9) for i in range(150)] + [(200 + i, 34.45 + rng.uniform(0, 0.1), -80.95 + rng.uniform(0, 0.1)) for i in range(150)]
    targets = [(i, 34.5 + rng.uniform(0, 1e-3), -80.9 + rng.uniform(0, 1e-3)) for i in range(120)]
    targets += [(300 + i, 34.45 + rng.uniform(0, 0.1), -80.95 + rng.uniform(0, 0.1)) for i in range(120)]
    want = brute_nearest(rows, targets, 1500.0)
    assert run_nearest(spark, rows, targets, 1500.0) == want
    assert run_nearest(spark, rows, targets, 1500.0, cell_cap=10) == want


def test_count_nearest_counts_every_row(spark):
    rows = spark.createDataFrame([(34.5, -80.9)] * 40 + [(34.6, -80.9), (None, -80.9)], "lat double, lon double")
    targets = spark.createDataFrame([("a", 34.5001, -80.9), ("b", 34.6, -80.9), ("c", 40.0, -80.0)], "t_id string, lat double, lon double")
    got = {r.target_id: r.n for r in spatial.count_nearest(rows, targets, 200.0, "t_id").collect()}
    assert got == {"a": 40, "b": 1}


def test_point_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    pts = list({(34.5 + rng.uniform(0, 4e-3), -80.9 + rng.uniform(0, 4e-3)) for _ in range(120)})
    df = spark.createDataFrame(pts, "lat double, lon double")
    got = {tuple(r) for r in spatial.point_pairs_within(df, 50.0).collect()}
    assert got == {(*a, *b) for a in pts for b in pts if metres(*a, *b) <= 50.0}


def test_distance_join_plans_as_equi_join(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame(spread_points(rng, 50, 34.3, 0.1), "row_id int, lat double, lon double")
    pts = spatial.distinct_points(rows.withColumnRenamed("row_id", "t"), "t").withColumn(
        "cell", geo.cell_of(F.col("lat"), F.col("lon"), 500.0)
    )
    probes = spatial._probe_cells(rows.select(F.col("lat").alias("q_lat"), F.col("lon").alias("q_lon")), 500.0)
    plan = spatial._pick_nearest(probes.join(pts, ["cell"]), 500.0)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_bbox_and_haversine(spark):
    box = {"min_lat": 34.0, "max_lat": 35.0, "min_lon": -81.0, "max_lon": -80.0}
    df = spark.createDataFrame([(34.5, -80.5), (36.0, -80.5), (None, -80.5), (34.5, None)], "lat double, lon double")
    got = [r[0] for r in df.select(geo.in_bbox(F.col("lat"), F.col("lon"), box)).collect()]
    assert got == [True, False, False, False]
    d = df.limit(1).select(geo.haversine_m(F.lit(34.0), F.lit(-81.0), F.lit(35.0), F.lit(-80.0))).first()[0]
    assert d == pytest.approx(metres(34.0, -81.0, 35.0, -80.0))
    far = df.limit(1).select(geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))).first()[0]
    assert far == pytest.approx(math.pi * geo.EARTH_M)


def test_distance_to_a_missing_place_is_missing(spark):
    rows = [(35.0, -80.0, None, -80.0), (35.0, float("nan"), 35.0, -80.0), (35.0, -80.0, 35.0, -80.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    assert [r[0] for r in df.select(geo.haversine_m(*map(F.col, "abcd"))).collect()] == [None, None, 0.0]


@pytest.mark.parametrize("centre", [(12.0, 180.0), (-60.0, 180.0), (89.5, 30.0), (89.995, 0.0), (-89.99, 100.0)])
def test_seam_and_poles_equal_brute_force(spark, centre):
    """On both sides of the date line and around the poles, by the direct and the box search."""
    rng, (lat0, lon0) = random.Random(13), centre

    def near(n, first):
        out = []
        for i in range(n):
            lat = max(-90.0, min(90.0, lat0 + rng.uniform(-0.01, 0.01)))
            wide = 180.0 if abs(lat0) > 89 else 0.02
            lon = (lon0 + rng.uniform(-wide, wide) + 180.0) % 360.0 - 180.0
            out.append((first + i, lat, lon))
        return out

    rows, targets = near(60, 0), near(60, 500)
    for radius in (300.0, 2500.0):
        want = brute_nearest(rows, targets, radius)
        assert run_nearest(spark, rows, targets, radius) == want
        assert run_nearest(spark, rows, targets, radius, cell_cap=4) == want
    pts = [(lat, lon) for _, lat, lon in rows]
    df = spark.createDataFrame(pts, "lat double, lon double")
    got = {tuple(r) for r in spatial.point_pairs_within(df, 800.0).collect()}
    assert got == {(*a, *b) for a in pts for b in pts if metres(*a, *b) <= 800.0}


def test_salts_follow_each_key(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 100)
    keys = ["a"] * 150 + ["b"] * 450 + ["c"] * 2000 + [f"x{i}" for i in range(300)]
    left = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i int, k string")
    hot = skew.hot_keys(left, ["k"])
    assert sorted(hot.values()) == [2, 5, 20]
    right = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, v int")
    joined = skew.salted_join(left, right, ["k"], hot=hot)
    assert joined.count() == 2600
    spread = F.pmod(F.xxhash64(F.lit(7), "i", "k"), F.lit(20))
    most = left.where("k = 'c'").groupBy(spread.alias("s")).count().agg(F.max("count")).first()[0]
    assert most < 200
