import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from kerbline.functions import scalar
from kerbline.operators import profile, stats
from kerbline.operators.quantile import exact_quantiles


def interpolated(values, q):
    s = sorted(values)
    h = (len(s) - 1) * q
    lo, hi = math.floor(h), math.ceil(h)
    return s[lo] + (s[hi] - s[lo]) * (h - lo)


@pytest.mark.parametrize("small_group", [200_000, 0])
@pytest.mark.parametrize("accuracy", [100, 5_000_000])
def test_quantiles_do_not_depend_on_the_sketch(spark, small_group, accuracy):
    rng = random.Random(1)
    rows = [("big", rng.choice([rng.gauss(0, 1), 0.25, 1e9])) for _ in range(3000)]
    rows += [(f"n{n}", float(v)) for n in (1, 2, 3, 10, 1003) for v in range(n)]
    rows += [(None, 7.0), ("big", None), ("big", float("nan"))]
    df = spark.createDataFrame(rows, "g string, x double").repartition(5)
    wanted = {"q0": 0.0, "q1": 0.1, "med": 0.5, "p90": 0.9, "p99": 0.99, "max": 1.0}
    got = exact_quantiles(df, ["g"], "x", wanted, accuracy=accuracy, small_group=small_group).collect()
    by = {}
    for g, v in rows:
        if v is not None and v == v:
            by.setdefault(g, []).append(v)
    assert {r.g for r in got} == set(by)
    for r in got:
        assert [r[n] for n in wanted] == [pytest.approx(interpolated(by[r.g], q)) for q in wanted.values()]


def test_quantiles_of_one_large_column(spark):
    df = spark.range(300_003).select(F.col("id").cast("double").alias("x"))
    for small_group, accuracy in ((200_000, 5_000_000), (0, 100)):
        row = exact_quantiles(df, [], "x", {"p90": 0.9}, accuracy=accuracy, small_group=small_group).first()
        assert row.p90 == pytest.approx(270_001.8)


def test_nan_is_missing_in_fits(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,), (None,)], "a double")
    assert [r.n for r in stats.minmax(df, {"a": "n"}).collect()] == [0.0, None, 1.0, None]
    assert [r.a for r in stats.mean_impute(df, ["a"]).collect()] == [1.0, 2.0, 3.0, 2.0]
    assert stats.fit_zscore(df, ["a"], F.lit(True)) == {"mean_a": 2.0, "std_a": 1.0}


def test_nearest_rank_quantiles(spark):
    vals = [5.0, 1.0, 9.0, 9.0, 2.0, 7.0, 7.5]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    row = exact_quantiles(df, [], "x", {"a": 0.0, "b": 0.5, "c": 0.99}, interpolate=False).first()
    s = sorted(vals)
    assert (row.a, row.b, row.c) == (s[0], s[math.floor(7 * 0.5)], s[6])


def test_minmax(spark):
    df = spark.createDataFrame([(1.0, 4.0, None), (3.0, 4.0, None), (None, 4.0, None)], "a double, b double, c double")
    got = stats.minmax(df, {"a": "na", "b": "nb", "c": "nc"}, 1e-9).select("na", "nb", "nc").collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (None, 0.0, 0.0)]


def test_impute_and_zscore(spark):
    df = spark.createDataFrame([(1.0, None, 5.0), (None, None, 5.0), (4.0, None, 5.0)], "a double, b double, c double")
    filled = stats.mean_impute(df, ["a", "b"])
    assert sorted((r.a, r.b) for r in filled.collect()) == [(1.0, 0.0), (2.5, 0.0), (4.0, 0.0)]
    fit = stats.fit_zscore(filled, ["a", "c"], F.col("a") < 4)
    assert fit["mean_a"] == 1.75 and fit["std_a"] == pytest.approx(statistics.pstdev([1.0, 2.5]))
    assert fit["std_c"] == 1.0
    back = stats.undo_zscore(stats.apply_zscore(filled, ["a", "c"], fit), ["a", "c"], fit)
    assert sorted(r.a for r in back.collect()) == pytest.approx([1.0, 2.5, 4.0])


def test_hash_split_is_stable_under_repartitioning(spark):
    df = spark.range(4000).select(F.col("id").cast("string").alias("k"))
    one = {r.k: r.s for r in df.select("k", stats.hash_split(F.col("k")).alias("s")).collect()}
    two = {r.k: r.s for r in df.repartition(7).select("k", stats.hash_split(F.col("k")).alias("s")).collect()}
    assert one == two
    share = list(one.values()).count("train") / 4000
    assert abs(share - 0.7) < 0.03 and set(one.values()) == {"train", "val", "test"}


def test_epoch_ms(spark):
    df = spark.createDataFrame([("1609459200000",), ("n/a",), (None,), ("9223372036854775807",)], "t string")
    got = [None if r[0] is None else r[0] for r in df.select(F.unix_seconds(scalar.epoch_ms(F.col("t")))).collect()]
    assert got == [1609459200, None, None, None]


def test_small_expressions(spark):
    df = spark.createDataFrame([("", None, "9", "Union", 0.0, 2.0, float("nan"))], "s string, r string, i string, c string, z double, p double, n double")
    row = df.select(
        scalar.segment_name(F.col("s"), F.col("r"), F.col("i"), F.col("c")),
        scalar.zero_to_null(F.col("z")),
        scalar.nonpositive_to_null(F.col("p")),
        scalar.nan_to_null(F.col("n")),
        scalar.title_case(F.lit("NEW HANOVER")),
        scalar.softplus(F.lit(800.0)),
        scalar.softplus(F.lit(0.0)),
        scalar.rank_tier(F.lit(10)),
        scalar.log_exposure(F.lit(None).cast("double")),
        scalar.label_of(F.lit(9), scalar.FUNC_CLASS_LABELS),
    ).first()
    assert tuple(row)[:6] == ("Route 9 (Union)", None, 2.0, None, "New Hanover", 800.0)
    assert row[6] == pytest.approx(math.log(2)) and tuple(row)[7:] == ("High", 0.0, None)


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1, "fire"), ("a", None, "ems"), (None, 2, "fire")], "k string, v int, t string")
    assert {tuple(r) for r in profile.value_counts(df, ["k", "v"]).collect()} == {("k", "a", 2), ("v", "1", 1), ("v", "2", 1)}
    assert ("k", None, 1) in {tuple(r) for r in profile.value_counts(df, ["k"], keep_null=True).collect()}
    assert {tuple(r) for r in profile.missing_pct(df, ["k", "v", "t"]).collect()} == {("k", 33.33), ("v", 33.33), ("t", 0.0)}
    assert {tuple(r) for r in profile.crosstab(df, "k", "t", ["fire", "ems"]).collect()} == {("a", 1, 1), (None, 1, 0)}
    check = profile.source_crosscheck(df.where("k is not null"), df.where("v = 1"), "k").collect()
    assert [tuple(r) for r in check] == [("a", 2, 1, 100.0)]


def test_numeric_range(spark):
    df = spark.createDataFrame([(v,) for v in (4.0, 10.0, None, 1.0, 7.0)], "x double")
    assert tuple(profile.numeric_range(df, "x").first()) == (1.0, 5.5, 10.0)
    assert tuple(profile.numeric_range(df.limit(0), "x").first()) == (None, None, None)
