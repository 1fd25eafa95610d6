import pytest

from kerbline.operators import disparity, risk


def exposure(spark, scores, ems, w=1.0):
    df = spark.createDataFrame(
        [(str(i), float(s), None if e is None else float(e)) for i, (s, e) in enumerate(zip(scores, ems))],
        "segment_id string, risk_score double, ems_distance_m double",
    )
    return {int(r.segment_id): r for r in risk.risk_exposure(df, w).collect()}


def test_exposure_by_hand(spark):
    out = exposure(spark, [2.0, 4.0, 4.0, 6.0], [300, 300, 900, 700], 0.5)
    assert [out[i].risk_norm for i in range(4)] == pytest.approx([0.0, 0.5, 0.5, 1.0])
    assert [out[i].ems_norm for i in range(4)] == pytest.approx([0.0, 0.0, 1.0, 2 / 3])
    assert [out[i].risk_exposure for i in range(4)] == pytest.approx([0.0, 0.5, 0.75, 4 / 3])


def test_weight_zero_is_plain_risk(spark):
    out = exposure(spark, [7.0, 1.5, 3.25, 7.0], [40, 8000, None, 12], 0.0)
    assert [out[i].risk_exposure for i in range(4)] == [out[i].risk_norm for i in range(4)]


def test_missing_distances_fall_back_to_risk(spark):
    out = exposure(spark, [5.0, 1.0, 3.0], [None, 700, None])
    assert [out[i].ems_distance_available for i in range(3)] == [False, True, False]
    assert [out[i].risk_exposure for i in range(3)] == pytest.approx([1.0, 0.0, 0.5])
    none = exposure(spark, [8.0, 4.0], [None, None])
    assert [none[i].risk_exposure for i in range(2)] == [1.0, 0.0] and none[0].ems_norm is None


def test_distance_cannot_lift_the_least_risk(spark):
    out = exposure(spark, [1.0, 1.2], [99_000, 1], 5.0)
    assert (out[0].risk_exposure, out[1].risk_exposure) == (0.0, 1.0)


def flags(spark, floor, rows):
    names = "county string, pedcyclist_incident_count_5yr int, speed_limit_mph double, lane_count double, ems_distance_m double, aadt_raw double"
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + names)
    return [r.data_density_flag for r in risk.data_density_flag(df, floor).orderBy("i").collect()]


def test_density_flags(spark):
    full = (35.0, 4.0, 2500.0, 900.0)
    gaps = [(*full[:i], None, *full[i + 1 :]) for i in range(4)]
    # Eastshire has 12 incidents, Westshire 3; no county at all is not a sparse county.
    rows = [("Eastshire", 7, *full), ("Eastshire", 5, *full), ("Westshire", 3, *full), (None, 0, *full)]
    assert flags(spark, 10, rows) == [False, False, True, False]
    assert flags(spark, 3, rows) == [False] * 4
    rows = [("Eastshire", 50, *full)] + [("Eastshire", 0, *g) for g in gaps[:3]]
    assert flags(spark, 10, rows) == [False, True, True, True]


def scores(spark):
    rows = [(f"e{i}", "Eastshire", False, 0.2 + 0.1 * (i % 3), 0.05, i % 4 != 0, i < 3) for i in range(12)]
    rows += [(f"w{i}", "Westshire", True, 0.9, 0.4, i == 0, i != 1) for i in range(5)]
    return spark.createDataFrame(
        rows,
        "segment_id string, county string, rural_flag boolean, risk_exposure double, risk_score double, ems_distance_available boolean, data_density_flag boolean",
    )


def test_disparity_shapes_and_gap(spark):
    df = scores(spark)
    assert disparity.disparity_by_county(df).count() == 2
    rural = {r.rural_flag: r for r in disparity.disparity_by_rural(df).collect()}
    assert rural[True].pct_ems_distance_available == 20.0 and rural[False].pct_ems_distance_available == 75.0
    assert rural[False].n_segments == 12
    gap = disparity.disparity_gap(df).first()
    assert gap.rural_vs_suburban_exposure_ratio == pytest.approx(3.0)
    assert gap.rural_vs_suburban_confidence_gap_pct == pytest.approx(80.0 - 25.0)
    pivot = {r.county: (r.rural, r.suburban) for r in disparity.disparity_pivot(df).collect()}
    assert pivot == {"Eastshire": (None, pytest.approx(0.3)), "Westshire": (pytest.approx(0.9), None)}


def test_gap_is_null_without_one_group(spark):
    gap = disparity.disparity_gap(scores(spark).where("rural_flag")).first()
    assert tuple(gap) == (None, None)


def test_null_groups_are_kept(spark):
    df = scores(spark).selectExpr("*", "nullif(county, 'Westshire') as c2").drop("county").withColumnRenamed("c2", "county")
    rows = {r.county: r for r in disparity.disparity_by_county(df).collect()}
    assert rows[None].n_segments == 5 and rows[None].median_risk_exposure == pytest.approx(0.9)
    cuts = [r.cut for r in disparity.disparity_grouping_sets(df).collect()]
    assert sorted(cuts) == ["county"] * 2 + ["county_rural_flag"] * 2 + ["rural_flag"] * 2


def test_missing_column_raises(spark):
    with pytest.raises(ValueError, match="data_density_flag"):
        disparity.disparity_by_county(scores(spark).drop("data_density_flag"))


def test_quantile_stops(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)], "risk_exposure double")
    got = [r.value for r in disparity.quantile_stops(df).orderBy("position").collect()]
    assert got == [0.0, 5.0, 7.0, 9.0, 9.0, 9.0]
    empty = [(r.position, r.value) for r in disparity.quantile_stops(df.limit(0)).orderBy("position").collect()]
    assert empty == [(0, 0.0), (1, 1.0)]


def test_topn_breaks_ties_by_id_and_puts_nulls_last(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", None), ("d", 2.0)], "segment_id string, risk_exposure double")
    got = [(r["rank"], r.segment_id, r.tier) for r in risk.priority_topn(df, 4).orderBy("rank").collect()]
    assert got == [(1, "d", "Critical"), (2, "a", "Critical"), (3, "b", "Critical"), (4, "c", "High")]
    plan = risk.priority_topn(df, 2)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan
