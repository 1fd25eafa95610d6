"""Poisson count model with traffic as exposure on own and diffused features."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.scalar import log_exposure, softplus
from kerbline.operators.graph import diffusion_features
from kerbline.operators.stats import apply_zscore, fit_zscore, mean_impute
from kerbline.session import durable

# The feature groups of the model input, in order.
FEATURE_GROUPS = {
    "infrastructure": ["speed_limit_mph", "lane_count", "road_classification"],
    "aadt": ["aadt_normalized"],
    "crash_history": ["pedcyclist_incident_count_5yr", "general_crash_count_5yr_county"],
    "context": ["rural_flag", "county_code"],
    "ems_access": ["ems_distance_m"],
}
TARGET = "pedcyclist_incident_count_5yr"
OFFSET_EPS = 1e-6


class Coefficient(NamedTuple):
    """Weight of one feature after ``hop`` diffusion steps; the intercept has no feature."""

    hop: int
    feature: str
    w: float


def present_features(df: DataFrame, include_target_history: bool = True) -> list[tuple[str, str]]:
    """``(group, feature)`` pairs for the columns at hand; a group without any is left out."""
    return [
        (group, c)
        for group, cols in FEATURE_GROUPS.items()
        for c in cols
        if c in df.columns and (include_target_history or c != TARGET)
    ]


def feature_groups(df: DataFrame) -> dict[str, list[str]]:
    groups: dict[str, list[str]] = {}
    for group, c in present_features(df):
        groups.setdefault(group, []).append(c)
    return groups


def model_matrix(segments: DataFrame, keep: Sequence[str] = ("segment_id",)) -> DataFrame:
    """Feature columns as doubles with gaps filled by the column mean."""
    cols = [c for _, c in present_features(segments)]
    typed = segments.select(*keep, *[F.col(c).cast("double").alias(c) for c in cols if c not in keep])
    return mean_impute(typed, cols)


def design(segments: DataFrame, edges: DataFrame, order: int = 2, include_target_history: bool = True) -> DataFrame:
    """Own features and their diffused copies, one row per segment."""
    cols = [c for _, c in present_features(segments, include_target_history)]
    x = durable(model_matrix(segments).withColumnRenamed("segment_id", "node").select("node", *cols), "matrix")
    return diffusion_features(x, edges, cols, order).withColumnRenamed("node", "segment_id")


def column_of(coef: Coefficient) -> str:
    return coef.feature if coef.hop == 0 else f"{coef.feature}_h{coef.hop}"


def linear_predictor(intercept: float, coefs: Sequence[Coefficient]) -> Column:
    eta = F.lit(float(intercept))
    for c in coefs:
        eta = eta + F.lit(float(c.w)) * F.col(column_of(c))
    return eta


def rate(eta: Column, link: str = "log") -> Column:
    """Non-negative rate from the predictor."""
    return F.exp(eta) if link == "log" else softplus(eta)


def score(matrix: DataFrame, intercept: float, coefs: Sequence[Coefficient], link: str = "log") -> DataFrame:
    """``segment_id, eta, risk_score``; the reported rate leaves the exposure offset out."""
    return matrix.select("segment_id", linear_predictor(intercept, coefs).alias("eta")).withColumn(
        "risk_score", rate(F.col("eta"), link)
    )


def poisson_nll(scored: DataFrame, segments: DataFrame, split: Column | None = None) -> DataFrame:
    """Mean of ``lambda - k ln(lambda)`` with traffic as exposure, per split if given."""
    rows = scored.select("segment_id", "risk_score").join(
        segments.select(
            "segment_id",
            F.coalesce(F.col(TARGET), F.lit(0)).cast("double").alias("k"),
            log_exposure(F.col("aadt_raw")).alias("offset"),
            (F.lit("all") if split is None else split).alias("split"),
        ),
        "segment_id",
    )
    log_lambda = F.log(F.col("risk_score") + OFFSET_EPS) + F.col("offset")
    return rows.groupBy("split").agg(
        F.count("*").alias("n"), F.avg(F.exp(log_lambda) - F.col("k") * log_lambda).alias("nll")
    )


class PoissonFit(NamedTuple):
    intercept: float
    coefs: list[Coefficient]
    scaler: dict[str, float]
    columns: list[str]


def fit_poisson(
    matrix: DataFrame,
    segments: DataFrame,
    split: Column,
    weight: Column | None = None,
    max_iter: int = 25,
    reg: float = 1e-6,
) -> PoissonFit:
    """Fit on the training rows with log exposure as offset.

    Features are standardised on the training rows, so the coefficients belong to
    standardised columns. Only the coefficients reach the driver.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    cols = [c for c in matrix.columns if c != "segment_id"]
    rows = matrix.join(
        segments.select(
            "segment_id",
            F.coalesce(F.col(TARGET), F.lit(0)).cast("double").alias("_k"),
            log_exposure(F.col("aadt_raw")).alias("_offset"),
            split.alias("_split"),
            (F.lit(1.0) if weight is None else weight.cast("double")).alias("_weight"),
        ),
        "segment_id",
    ).where((F.col("_split") == "train") & (F.col("_weight") > 0))
    scaler = fit_zscore(rows, cols, F.lit(True))
    scaled = apply_zscore(rows, cols, scaler).persist()
    try:
        model = GeneralizedLinearRegression(
            family="poisson",
            link="log",
            featuresCol="_features",
            labelCol="_k",
            offsetCol="_offset",
            weightCol="_weight",
            maxIter=max_iter,
            regParam=reg,
        ).fit(VectorAssembler(inputCols=cols, outputCol="_features").transform(scaled))
    finally:
        scaled.unpersist()
    coefs = []
    for name, w in zip(cols, model.coefficients.toArray().tolist()):
        base, _, hop = name.rpartition("_h")
        coefs.append(Coefficient(int(hop), base, w) if hop.isdigit() and base else Coefficient(0, name, w))
    return PoissonFit(float(model.intercept), coefs, scaler, cols)


def score_fit(matrix: DataFrame, fit: PoissonFit) -> DataFrame:
    return score(apply_zscore(matrix, fit.columns, fit.scaler), fit.intercept, fit.coefs)


def raw_coefficients(fit: PoissonFit) -> tuple[float, list[Coefficient]]:
    """Intercept and weights for the columns as they are, not standardised."""
    intercept, coefs = fit.intercept, []
    for c in fit.coefs:
        w = c.w / fit.scaler[f"std_{column_of(c)}"]
        intercept -= w * fit.scaler[f"mean_{column_of(c)}"]
        coefs.append(Coefficient(c.hop, c.feature, w))
    return intercept, coefs


def save_fit(spark: SparkSession, fit: PoissonFit, path: str) -> None:
    """The fit as a small table: one row per coefficient, the intercept without a feature."""
    rows = [(-1, None, None, fit.intercept, None, None)]
    for place, c in enumerate(fit.coefs):
        name = column_of(c)
        rows.append((place, c.hop, c.feature, c.w, fit.scaler[f"mean_{name}"], fit.scaler[f"std_{name}"]))
    schema = "place int, hop int, feature string, w double, mean double, std double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_fit(spark: SparkSession, path: str) -> PoissonFit:
    rows = spark.read.parquet(path).orderBy("place").collect()
    coefs = [Coefficient(r.hop, r.feature, r.w) for r in rows[1:]]
    scaler = {}
    for r, c in zip(rows[1:], coefs, strict=True):
        scaler |= {f"mean_{column_of(c)}": r.mean, f"std_{column_of(c)}": r.std}
    return PoissonFit(rows[0].w, coefs, scaler, [column_of(c) for c in coefs])


def score_equations(matrix: DataFrame, segments: DataFrame, fit: PoissonFit) -> DataFrame:
    """``feature, observed, imbalance``: what a fit without penalty must balance in each column.

    ``imbalance`` is ``sum(x (k - mu)) / sum(|x| k)`` over the given rows of the
    standardised columns, 0 at the optimum; the intercept has x = 1.
    """
    scaled = apply_zscore(matrix, fit.columns, fit.scaler)
    rows = scaled.withColumn("_mu", rate(linear_predictor(fit.intercept, fit.coefs))).join(
        segments.select(
            "segment_id",
            F.coalesce(F.col(TARGET), F.lit(0)).cast("double").alias("_k"),
            F.exp(log_exposure(F.col("aadt_raw"))).alias("_exposure"),
        ),
        "segment_id",
    )
    gap = F.col("_k") - F.col("_mu") * F.col("_exposure")
    columns = {"(intercept)": F.lit(1.0)} | {c: F.col(c) for c in fit.columns}
    sums = rows.agg(
        F.array(
            *[
                F.struct(
                    F.lit(name).alias("feature"),
                    F.sum("_k").alias("observed"),
                    (F.sum(x * gap) / F.greatest(F.sum(F.abs(x) * F.col("_k")), F.lit(1.0))).alias("imbalance"),
                )
                for name, x in columns.items()
            ]
        ).alias("rows")
    )
    return sums.select(F.inline("rows"))
