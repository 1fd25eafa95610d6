"""Exposure by county and by rural flag."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.quantile import exact_quantiles

REQUIRED = (
    "county",
    "rural_flag",
    "risk_exposure",
    "risk_score",
    "ems_distance_available",
    "data_density_flag",
)
QUANTILES = {"median_risk_exposure": 0.5, "p90_risk_exposure": 0.9}
# The map's colour steps.
STOPS = {"p0": 0.0, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def require_columns(df: DataFrame, required: Sequence[str] = REQUIRED) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")


def _pct(flag: str) -> Column:
    return 100.0 * F.avg(F.col(flag).cast("int"))


def _measures() -> list[Column]:
    return [
        F.count("*").alias("n_segments"),
        F.avg("risk_exposure").alias("mean_risk_exposure"),
        F.avg("risk_score").alias("mean_risk_score"),
        _pct("ems_distance_available").alias("pct_ems_distance_available"),
        _pct("data_density_flag").alias("pct_low_confidence"),
    ]


def disparity(scores: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The seven measures per group; a null key is a group of its own."""
    require_columns(scores)
    base = scores.groupBy(*keys).agg(*_measures()).alias("m")
    q = exact_quantiles(scores, keys, "risk_exposure", QUANTILES).alias("q")
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"m.{k}").eqNullSafe(F.col(f"q.{k}"))
    return base.join(q, cond, "left").select(
        *[F.col(f"m.{k}") for k in keys],
        "n_segments",
        "mean_risk_exposure",
        "median_risk_exposure",
        "p90_risk_exposure",
        "mean_risk_score",
        "pct_ems_distance_available",
        "pct_low_confidence",
    )


def disparity_by_county(scores: DataFrame) -> DataFrame:
    return disparity(scores, ["county"]).orderBy(F.col("mean_risk_exposure").desc_nulls_last(), "county")


def disparity_by_rural(scores: DataFrame) -> DataFrame:
    return disparity(scores, ["rural_flag"]).orderBy("rural_flag")


def disparity_by_county_rural(scores: DataFrame) -> DataFrame:
    return disparity(scores, ["county", "rural_flag"]).orderBy("county", "rural_flag")


def disparity_grouping_sets(scores: DataFrame) -> DataFrame:
    """All three cuts from one pass over the scores.

    Each row is tagged with the cuts it belongs to; ``cut`` keeps the absent key
    of a cut apart from a key that is null.
    """
    require_columns(scores)
    none_c, none_r = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    cuts = F.array(
        F.struct(F.lit("county").alias("cut"), F.col("county").alias("county"), none_r.alias("rural_flag")),
        F.struct(F.lit("rural_flag").alias("cut"), none_c.alias("county"), F.col("rural_flag").alias("rural_flag")),
        F.struct(F.lit("county_rural_flag").alias("cut"), F.col("county").alias("county"), F.col("rural_flag").alias("rural_flag")),
    )
    tagged = scores.select(
        F.inline(cuts), "risk_exposure", "risk_score", "ems_distance_available", "data_density_flag"
    )
    return disparity(tagged, ["cut", "county", "rural_flag"])


def disparity_gap(scores: DataFrame) -> DataFrame:
    """Rural over suburban mean exposure, and the difference in low-confidence share.

    Null when either group is absent or the suburban mean is zero.
    """
    require_columns(scores)
    rural, suburban = F.col("rural_flag"), ~F.col("rural_flag")
    low = F.col("data_density_flag").cast("int")
    return scores.agg(
        F.avg(F.when(rural, F.col("risk_exposure"))).alias("r"),
        F.avg(F.when(suburban, F.col("risk_exposure"))).alias("s"),
        (100.0 * F.avg(F.when(rural, low))).alias("rl"),
        (100.0 * F.avg(F.when(suburban, low))).alias("sl"),
    ).select(
        F.try_divide("r", "s").alias("rural_vs_suburban_exposure_ratio"),
        (F.col("rl") - F.col("sl")).alias("rural_vs_suburban_confidence_gap_pct"),
    )


def disparity_pivot(scores: DataFrame) -> DataFrame:
    """Mean exposure per county, rural and suburban side by side, highest first."""
    def mean_where(cond: Column) -> Column:
        return F.avg(F.when(cond, F.col("risk_exposure")))

    flag = F.col("rural_flag")
    # Rows without a flag take the suburban place of their county.
    wide = scores.groupBy("county").agg(
        mean_where(flag).alias("rural"),
        F.coalesce(mean_where(flag.isNull()), mean_where(~flag)).alias("suburban"),
    )
    return wide.orderBy(F.coalesce("rural", "suburban", F.lit(0.0)).desc(), "county")


def quantile_stops(scores: DataFrame, col: str = "risk_exposure") -> DataFrame:
    """Colour stops ``position, stop, value``: elements of the sorted column at the
    fixed shares, then the maximum. An empty input gives 0 and 1.
    """
    picked = exact_quantiles(scores, [], col, {**STOPS, "max": 1.0}, interpolate=False)

    def step(i: int, name: str, value: Column) -> Column:
        return F.struct(F.lit(i).alias("position"), F.lit(name).alias("stop"), value.alias("value"))

    blank = F.array(step(0, "p0", F.lit(0.0)), step(1, "max", F.lit(1.0)))
    steps = F.array(*[step(i, name, F.col(name)) for i, name in enumerate([*STOPS, "max"])])
    return picked.select(F.when(F.col("max").isNull(), blank).otherwise(steps).alias("s")).select(F.inline("s"))
