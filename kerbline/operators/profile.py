"""Source profile reports: value counts, gaps, ranges, cross-tabs, cross-checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.quantile import exact_quantiles


def value_counts(df: DataFrame, cols: Sequence[str], keep_null: bool = False) -> DataFrame:
    """``column_name, value, n`` for several columns in one pass."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols]
    )
    long = df.select(F.inline(pairs))
    if not keep_null:
        long = long.where(F.col("value").isNotNull())
    return long.groupBy("column_name", "value").agg(F.count("*").alias("n"))


def missing_pct(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``column_name, missing_pct``: all columns from one aggregation."""
    gaps = df.agg(
        *[F.round(100.0 * F.avg(F.col(c).isNull().cast("int")), 2).alias(c) for c in cols]
    )
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing_pct")) for c in cols]
    )
    return gaps.select(F.inline(pairs))


def numeric_range(df: DataFrame, col: str) -> DataFrame:
    """One row: exact minimum, median and maximum."""
    return exact_quantiles(df, [], col, {"min_value": 0.0, "median_value": 0.5, "max_value": 1.0})


def date_range(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("first_date"), F.max(col).alias("last_date"))


def crosstab(df: DataFrame, row: str, col: str, values: Sequence[str]) -> DataFrame:
    """Counts of ``row`` by the listed values of ``col``, 0 where a pair is absent."""
    return df.groupBy(row).pivot(col, list(values)).count().fillna(0, list(values))


def involvement_counts(df: DataFrame, flags: dict[str, Column], key: str | None = None) -> DataFrame:
    """Conditional counts, over all rows or per ``key``."""
    aggs = [F.count_if(c).alias(n) for n, c in flags.items()]
    return df.groupBy(key).agg(*aggs) if key else df.agg(*aggs)


def source_crosscheck(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Counts per key of two extractions of the same facts, and how far apart they are."""
    ca = a.groupBy(key).agg(F.count("*").alias("count_a"))
    cb = b.groupBy(key).agg(F.count("*").alias("count_b"))
    none = F.lit(0).cast("long")
    return (
        ca.join(cb, key, "full")
        .select(
            key,
            F.coalesce("count_a", none).alias("count_a"),
            F.coalesce("count_b", none).alias("count_b"),
        )
        .withColumn(
            "divergence_pct",
            F.round(
                F.try_divide(100.0 * (F.col("count_a") - F.col("count_b")), F.col("count_b")), 2
            ),
        )
    )


def target_summary(segments: DataFrame) -> DataFrame:
    """How sparse the incident counts are."""
    n = F.coalesce(F.col("pedcyclist_incident_count_5yr"), F.lit(0))
    return segments.agg(
        F.count("*").alias("n_segments"),
        (100.0 * F.avg((n == 0).cast("int"))).alias("pct_zero_incidents"),
        F.avg(n).alias("mean_incidents"),
        F.coalesce(F.max(n), F.lit(0)).cast("double").alias("max_incidents"),
        F.count_distinct("county").alias("n_counties"),
    )


def score_summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.count("*").alias("n_segments"),
        F.avg("risk_score").alias("mean_risk_score"),
        F.avg("risk_exposure").alias("mean_risk_exposure"),
        (100.0 * F.avg(F.col("data_density_flag").cast("int"))).alias("pct_low_confidence"),
        (100.0 * F.avg(F.col("ems_distance_available").cast("int"))).alias("pct_ems_distance_available"),
    )


def assembly_report(features: DataFrame, edges: DataFrame) -> DataFrame:
    """One row about the assembled table and its graph."""

    def share(c: Column) -> Column:
        return F.round(100.0 * F.avg(c.cast("int")), 2)

    def gap(name: str) -> Column:
        return share(F.col(name).isNull()).alias(f"missing_{name}_pct")

    n_edges = edges.agg(F.count("*").alias("n")).scalar()
    hits = F.col("pedcyclist_incident_count_5yr")
    return features.agg(
        F.count("*").alias("n_segments"),
        F.count_distinct("county").alias("n_counties"),
        F.count_if("rural_flag").alias("n_rural"),
        share(F.col("rural_flag")).alias("rural_pct"),
        gap("speed_limit_mph"),
        gap("lane_count"),
        gap("aadt_raw"),
        gap("ems_distance_m"),
        F.sum(hits).alias("n_incidents"),
        F.count_if(hits > 0).alias("n_segments_hit"),
        share(hits > 0).alias("segments_hit_pct"),
    ).withColumn("n_edges", n_edges)
