"""Scores, priority list, explanations and what-if results from the feature table."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators import bootstrap, explain, model, risk, whatif
from kerbline.operators.model import Coefficient
from kerbline.session import durable


def score_segments(
    features: DataFrame,
    edges: DataFrame,
    intercept: float,
    coefs: Sequence[Coefficient],
    w_ems: float = 1.0,
    min_county_incidents: int = risk.MIN_COUNTY_INCIDENTS,
) -> DataFrame:
    """The feature table with rate, low-confidence flag and exposure."""
    order = max((c.hop for c in coefs), default=0)
    wide = model.design(features, edges, order)
    scored = model.score(wide, intercept, coefs)
    return with_exposure(features, scored, w_ems, min_county_incidents)


def with_exposure(
    features: DataFrame, scored: DataFrame, w_ems: float = 1.0, min_county_incidents: int = risk.MIN_COUNTY_INCIDENTS
) -> DataFrame:
    rows = durable(features.join(scored, "segment_id"), "scored")
    return risk.risk_exposure(risk.data_density_flag(rows, min_county_incidents), w_ems)


def explained(
    segment_ids: DataFrame,
    features: DataFrame,
    edges: DataFrame,
    coefs: Sequence[Coefficient],
    k: int = 6,
) -> DataFrame:
    """``segment_id, top_features`` of a few segments; gaps are filled from the whole table."""
    matrix = model.model_matrix(features).join(segment_ids.select("segment_id"), "segment_id", "left_semi")
    nodes = segment_ids.select(F.col("segment_id").alias("node"))
    return explain.topk_nested(explain.attribution_arrays(matrix, nodes, edges, coefs, partial=True), k)


def priority_list(
    scores: DataFrame,
    features: DataFrame,
    edges: DataFrame,
    coefs: Sequence[Coefficient],
    n: int = 25,
    confidence: DataFrame | None = None,
) -> DataFrame:
    """Ranked records with their top features and suggested countermeasures.

    The limit comes first: only ``n`` segments are explained.
    """
    top = durable(risk.priority_topn(scores, n), "top")
    nested = explained(top, features, edges, coefs)
    suggested = explain.countermeasures(nested)
    rows = top.join(nested, "segment_id").join(suggested, "segment_id")
    sure = F.lit(None).cast("double")
    if confidence is not None:
        rows = rows.join(confidence, "segment_id", "left")
        sure = F.round("explanation_confidence", 4)
    return rows.select(
        "rank",
        "tier",
        "segment_id",
        "segment_name",
        "county",
        F.coalesce("rural_flag", F.lit(False)).alias("rural_flag"),
        F.round("risk_score", 4).alias("risk_score"),
        F.round("risk_exposure", 4).alias("risk_exposure_score"),
        "data_density_flag",
        sure.alias("explanation_confidence"),
        "top_features",
        F.col("suggestions").alias("suggested_countermeasures"),
    ).orderBy("rank")


class FittedRun(NamedTuple):
    scores: DataFrame
    priority: DataFrame
    explained: DataFrame
    fit: model.PoissonFit


def fit_and_publish(
    features: DataFrame,
    edges: DataFrame,
    split: Column,
    model_path: str,
    n: int = 25,
    runs: int = 3,
    k: int = 6,
    w_ems: float = 1.0,
) -> FittedRun:
    """From the feature table to the list: fit, store, load, score, rank, explain, confidence.

    The model is stored as a coefficient table at ``model_path`` and everything
    after it uses what is read back. Only the ``n`` ranked segments are explained
    and get a confidence, which is the overlap with one-step refits on bootstrap weights.
    """
    spark = features.sparkSession
    matrix = durable(model.design(features, edges, 2, include_target_history=False), "design")
    model.save_fit(spark, model.fit_poisson(matrix, features, split), model_path)
    fit = model.load_fit(spark, model_path)
    scores = durable(with_exposure(features, model.score_fit(matrix, fit), w_ems), "scores")
    wanted = durable(risk.priority_topn(scores, n).select("segment_id"), "ranked")
    top = durable(top_of_fit(matrix, features, edges, fit, wanted, k), "explained")
    sure = explanation_confidence(features, edges, top, runs, k, matrix=matrix, fit=fit, split=split)
    _, raw = model.raw_coefficients(fit)
    listed = priority_list(scores, features, edges, raw, n, durable(sure, "confidence"))
    return FittedRun(scores, listed, top.join(sure, "segment_id", "left"), fit)


def explanation_records(
    scores: DataFrame, explained: DataFrame, district: str, timestamp: str, model_checkpoint: str
) -> DataFrame:
    """``segment_id, record``: the explanation of each explained segment as one JSON object.

    ``explained`` has ``segment_id, top_features`` and, if known,
    ``explanation_confidence``; an unknown one is written as 0, as the contract
    asks for a number. Missing text is written as empty text for the same reason.
    """
    known = "explanation_confidence" in explained.columns
    sure = F.coalesce("explanation_confidence", F.lit(0.0)) if known else F.lit(0.0)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    record = F.struct(
        F.struct(
            F.lit(district).alias("district"),
            F.lit(timestamp).alias("timestamp"),
            F.lit(model_checkpoint).alias("model_checkpoint"),
        ).alias("meta"),
        F.struct(
            text("segment_id"),
            text("segment_name"),
            text("county"),
            F.coalesce("rural_flag", F.lit(False)).alias("rural_flag"),
            F.round("risk_score", 6).alias("risk_score"),
            F.round("risk_exposure", 6).alias("risk_exposure_score"),
        ).alias("segment"),
        F.transform(
            "top_features",
            lambda f: F.struct(
                f["feature_name"].alias("feature_name"),
                F.round(f["importance"], 6).alias("importance"),
                f["value"].alias("value"),
                f["modality"].alias("modality"),
            ),
        ).alias("top_features"),
        F.col("data_density_flag"),
        F.round(sure, 4).alias("explanation_confidence"),
    )
    joined = scores.drop("top_features", "explanation_confidence").join(explained, "segment_id")
    return joined.select("segment_id", F.to_json(record, {"ignoreNullFields": "false"}).alias("record"))


def what_if(
    scores: DataFrame,
    features: DataFrame,
    edges: DataFrame,
    coefs: Sequence[Coefficient],
    n: int = 25,
) -> DataFrame:
    """What-if rows for the ``n`` highest exposures."""
    top = durable(risk.priority_topn(scores, n).select(F.col("segment_id").alias("target")), "targets")
    nodes = features.select(F.col("segment_id").alias("node"))
    matrix = model.model_matrix(features)
    names = [c for c in matrix.columns if c != "segment_id"]
    return whatif.counterfactual(top, matrix, scores.select("segment_id", "eta"), nodes, edges, coefs, names)


def explanation_confidence(
    features: DataFrame,
    edges: DataFrame,
    base: DataFrame,
    runs: int = 3,
    k: int = 6,
    matrix: DataFrame | None = None,
    fit: model.PoissonFit | None = None,
    split: Column | None = None,
    steps: int = 1,
) -> DataFrame:
    """``segment_id, explanation_confidence``: mean overlap of the top-k feature set
    over refits on bootstrap weights of the training rows.

    ``base`` has the top features of the fit on unweighted rows. ``matrix`` and
    ``fit`` are the design and that fit if they are there already. All refits come
    from ``steps`` passes over the rows and all overlaps from one plan, so the number
    of jobs does not depend on ``runs``. Weights come from a hash of the row key, so
    a rerun repeats them.
    """
    if matrix is None:
        matrix = durable(model.design(features, edges, include_target_history=False), "design")
    split = F.lit("train") if split is None else split
    if fit is None:
        fit = model.fit_poisson(matrix, features, split)
    refits = bootstrap.bootstrap_refits(matrix, features, fit, explain.poisson_weight, runs, split, steps)
    own = matrix.join(base.select("segment_id").distinct(), "segment_id", "left_semi")
    nodes = features.select(F.col("segment_id").alias("node"))
    raw = [model.raw_coefficients(refit)[1] for refit in refits]
    return explain.topk_stability(own, nodes, edges, base, raw, k)


def top_of_fit(
    matrix: DataFrame, features: DataFrame, edges: DataFrame, fit: model.PoissonFit, wanted: DataFrame, k: int = 6
) -> DataFrame:
    """Top features under a fit; its weights are moved back to the raw columns."""
    _, raw = model.raw_coefficients(fit)
    own = matrix.join(wanted.select("segment_id").distinct(), "segment_id", "left_semi")
    nodes = features.select(F.col("segment_id").alias("node"))
    return explain.topk_nested(explain.attribution_arrays(own, nodes, edges, raw), k)
