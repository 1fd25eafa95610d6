"""Risk-exposure index, low-confidence flag and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.scalar import rank_tier
from kerbline.operators.stats import minmax
from kerbline.session import durable

MIN_COUNTY_INCIDENTS = 15
RANGE_EPS = 1e-9


def data_density_flag(
    segments: DataFrame, min_county_incidents: int = MIN_COUNTY_INCIDENTS
) -> DataFrame:
    """Adds ``data_density_flag``: a fine attribute or the station distance is
    missing, or the county has too few incidents. A missing county is not sparse.

    County totals are aggregated first and joined back, so that a county with a
    large part of all segments never lands in one task.
    """
    totals = durable(
        segments.where(F.col("county").isNotNull())
        .groupBy("county")
        .agg(F.coalesce(F.sum("pedcyclist_incident_count_5yr"), F.lit(0)).alias("_county_total")),
        "county_totals",
    )
    missing = F.col("speed_limit_mph").isNull() | F.col("lane_count").isNull()
    if "ems_distance_m" in segments.columns:
        missing = missing | F.col("ems_distance_m").isNull()
    sparse = F.coalesce(F.col("_county_total") < min_county_incidents, F.lit(False))
    return (
        segments.join(totals, "county", "left")
        .withColumn("data_density_flag", missing | sparse)
        .select(*segments.columns, "data_density_flag")
    )


def risk_exposure(scores: DataFrame, w_ems: float = 1.0) -> DataFrame:
    """``risk_norm * (1 + w_ems * ems_norm)``, or ``risk_norm`` where the station
    distance is missing. Adds the two normalised terms and ``ems_distance_available``.
    """
    available = F.col("ems_distance_m").isNotNull()
    out = minmax(scores, {"risk_score": "risk_norm", "ems_distance_m": "ems_norm"}, RANGE_EPS)
    return (
        out.withColumn("ems_distance_available", available)
        .withColumn("ems_norm", F.when(available, F.col("ems_norm")))
        .withColumn(
            "risk_exposure",
            F.when(available, F.col("risk_norm") * (1 + F.lit(float(w_ems)) * F.col("ems_norm"))).otherwise(
                F.col("risk_norm")
            ),
        )
    )


def priority_topn(scores: DataFrame, n: int = 25) -> DataFrame:
    """Highest exposure first, ties by id; adds ``rank`` and ``tier``.

    The limit runs before the ranking, so only ``n`` rows are numbered.
    """
    order = [F.col("risk_exposure").desc_nulls_last(), F.col("segment_id")]
    top = scores.orderBy(*order).limit(n)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))
    return ranked.withColumn("tier", rank_tier(F.col("rank")))
