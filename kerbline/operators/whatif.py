"""What-if results: set a feature of one segment, see the score move around it."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators.graph import SELF_WEIGHT, degree, with_self
from kerbline.operators.model import Coefficient
from kerbline.operators.skew import hot_keys, salted_join
from kerbline.session import durable


class Intervention(NamedTuple):
    key: str
    label: str
    feature_contains: str
    set_value: float


# Intervention presets.
INTERVENTIONS = (
    Intervention("add_crosswalk", "Add a marked crosswalk", "crosswalk", 1.0),
    Intervention("add_sidewalk", "Close the sidewalk gap", "sidewalk", 1.0),
    Intervention("add_lighting", "Add street lighting", "lighting", 1.0),
    Intervention("reduce_speed_limit_25", "Reduce speed limit to 25 mph", "speed_limit", 25.0),
    Intervention("reduce_speed_limit_30", "Reduce speed limit to 30 mph", "speed_limit", 30.0),
)


def _matching(features: Sequence[str], it: Intervention) -> list[str]:
    return [f for f in features if it.feature_contains in f.lower()]


def _spread(targets: DataFrame, nodes: DataFrame, edges: DataFrame, order: int, self_weight: float) -> DataFrame:
    """``target, node, u0, .., u<order>``: column ``target`` of each adjacency power.

    Starts at the targets and follows edges outwards, so only rows within
    ``order`` hops are ever made.
    """
    hot = hot_keys(edges, ["src"], base=edges)
    looped = with_self(nodes, edges, self_weight)
    step = targets.select("target", F.col("target").alias("node"), F.lit(1.0).alias("u"))
    stacked = step.withColumn("k", F.lit(0))
    for k in range(1, order + 1):
        moved = salted_join(looped, step.withColumnRenamed("node", "src"), ["src"], hot=hot, salt_by=["dst"])
        reached = durable(
            moved.groupBy("target", F.col("dst").alias("node")).agg(F.sum(F.col("u") * F.col("raw")).alias("u")),
            f"reached_{k}",
        )
        totals = degree(reached.select("node").distinct(), edges, partial=True)
        step = durable(
            reached.join(totals, "node").select(
                "target", "node", (F.col("u") / (F.col("degree") + self_weight)).alias("u")
            ),
            f"carried_{k}",
        )
        stacked = stacked.unionByName(step.withColumn("k", F.lit(k)))
    sums = [F.coalesce(F.sum(F.when(F.col("k") == k, F.col("u"))), F.lit(0.0)).alias(f"u{k}") for k in range(order + 1)]
    return stacked.groupBy("target", "node").agg(*sums)


def counterfactual(
    targets: DataFrame,
    matrix: DataFrame,
    scored: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    coefs: Sequence[Coefficient],
    features: Sequence[str],
    interventions: Sequence[Intervention] = INTERVENTIONS,
    order: int = 2,
    digits: int = 4,
    self_weight: float = SELF_WEIGHT,
) -> DataFrame:
    """One row per target, applicable intervention and affected segment.

    ``targets`` has ``target``; ``matrix`` holds the own features, ``scored`` the
    predictor ``eta`` of every segment. The predictor is linear, so the change is
    the changed feature times what the graph carries from the target, and no
    segment beyond ``order`` hops moves. Equal to scoring everything again.
    """
    spread = _spread(targets, nodes, edges, order, self_weight)
    own = targets.join(matrix.withColumnRenamed("segment_id", "target"), "target")
    changes = []
    for it in interventions:
        hit = set(_matching(features, it))
        if not hit:
            continue
        gains = []
        for k in range(order + 1):
            g = F.lit(0.0)
            for c in coefs:
                if c.feature in hit and c.hop == k:
                    g = g + F.lit(float(c.w)) * (F.lit(float(it.set_value)) - F.col(c.feature))
            gains.append(g.alias(f"g{k}"))
        changes.append(F.struct(F.lit(it.key).alias("intervention"), F.lit(it.label).alias("label"), *gains))
    if not changes:
        raise ValueError("no intervention matches a feature")
    asked = own.select("target", F.inline(F.array(*changes)))
    # Self loops keep what has arrived, so the first step that reaches a node is its hop.
    hop = F.lit(order)
    for k in reversed(range(order)):
        hop = F.when(F.col(f"u{k}") > 0, F.lit(k)).otherwise(hop)
    delta_eta = sum((F.col(f"g{k}") * F.col(f"u{k}") for k in range(1, order + 1)), F.col("g0") * F.col("u0"))
    before, after = F.exp("eta"), F.exp(F.col("eta") + F.col("delta_eta"))
    return (
        spread.withColumn("hop", hop)
        .join(asked, "target")
        .withColumn("delta_eta", delta_eta)
        .join(scored.select(F.col("segment_id").alias("node"), "eta"), "node")
        .select(
            F.col("target").alias("segment_id"),
            "intervention",
            "label",
            F.col("node").alias("affected_id"),
            "hop",
            F.round(before, digits).alias("baseline_risk_score"),
            F.round(after, digits).alias("updated_risk_score"),
            F.round(after - before, digits).alias("delta"),
        )
    )


# Fixed value: the sentence for a segment without the feature.
NOT_SIMULATED = "No feature matching '{}' found for this segment — intervention not simulated."


def not_applied(
    targets: DataFrame, features: Sequence[str], interventions: Sequence[Intervention] = INTERVENTIONS
) -> DataFrame:
    """``segment_id, intervention, applied, reason`` where no feature matches."""
    missed = [it for it in interventions if not _matching(features, it)]
    spark = targets.sparkSession
    if not missed:
        return spark.createDataFrame([], "segment_id string, intervention string, applied boolean, reason string")
    rows = F.array(
        *[
            F.struct(
                F.lit(it.key).alias("intervention"),
                F.lit(False).alias("applied"),
                F.lit(NOT_SIMULATED.format(it.feature_contains)).alias("reason"),
            )
            for it in missed
        ]
    )
    return targets.select(F.col("target").alias("segment_id"), F.inline(rows))


def neighbor_mean_delta(results: DataFrame) -> DataFrame:
    """Mean change over the direct neighbours, per target and intervention."""
    return (
        results.where("hop = 1")
        .groupBy("segment_id", "intervention")
        .agg(F.count("*").alias("n_neighbors"), F.avg("delta").alias("mean_delta"))
    )
