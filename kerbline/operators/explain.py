"""Which of a segment's own features drove its score, and what to do about them."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.operators.graph import SELF_WEIGHT, return_weight
from kerbline.operators.model import Coefficient, present_features


class Rule(NamedTuple):
    feature_contains: str
    op: str
    threshold: float
    category: str
    fhwa_reference: str
    rationale: str


# Countermeasure rules in order of precedence.
RULES = (
    Rule("speed_limit", ">=", 45.0, "Reduced speed limit / traffic calming", "FHWA Proven Safety Countermeasures: Road Diets, Speed Management", "High posted speed limit is among this segment's top risk drivers."),
    Rule("crosswalk", "<", 0.5, "Marked crosswalk / pedestrian crossing improvement", "FHWA Proven Safety Countermeasures: Pedestrian Crossing Improvements", "No marked crosswalk detected near this segment."),
    Rule("sidewalk", "<", 0.5, "Sidewalk gap closure", "FHWA STEP Guide: Pedestrian Facility Design", "Sidewalk coverage is incomplete or absent along this segment."),
    Rule("lighting", "<", 0.5, "Street lighting improvement", "FHWA Proven Safety Countermeasures: Lighting", "Low/absent street lighting coverage on this segment."),
    Rule("intersection_density", ">=", 0.7, "Signal timing / intersection control review", "FHWA Proven Safety Countermeasures: Signal Timing", "High nearby intersection density increases conflict points."),
    Rule("aadt", ">=", 0.7, "Road diet / lane reconfiguration", "FHWA Proven Safety Countermeasures: Road Diets", "High traffic volume (AADT) relative to the district."),
    Rule("lane_count", ">=", 4.0, "Pedestrian refuge island / crossing distance reduction", "FHWA Proven Safety Countermeasures: Pedestrian Refuge Islands", "Wide multi-lane crossing distance on this segment."),
    Rule("crash_history", ">", 0.0, "Targeted enforcement / engineering study", "FHWA Systemic Safety Project Selection Tool", "Documented prior ped/cyclist crash history on this segment."),
)
# The suggestion when no rule matches.
NO_RULE = ("Engineering study recommended (no rule matched)", "FHWA Systemic Safety Project Selection Tool", "This segment's top risk drivers did not match an existing rule — flagged for manual review rather than a guessed countermeasure.")


def attribution_arrays(
    matrix: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    coefs: Sequence[Coefficient],
    base: dict[str, float] | None = None,
    self_weight: float = SELF_WEIGHT,
    partial: bool = False,
) -> DataFrame:
    """``segment_id, parts``: per feature its contribution and importance.

    The share of the linear predictor that comes from the segment's own value of
    a feature, other segments left as they are. Own values return through the
    graph with the diagonals of the adjacency powers. ``matrix`` may hold any
    subset of the segments and ``nodes`` names them; ``partial`` says that they are a
    small part of the graph. ``base`` is the value a feature is compared with (0).
    """
    groups = {c: g for g, c in present_features(matrix)}
    back = return_weight(nodes, edges, self_weight, partial).withColumnRenamed("node", "segment_id")
    passed = {0: F.lit(1.0), 1: F.col("back_1"), 2: F.col("back_2")}
    gains: dict[str, Column] = {}
    for c in coefs:
        gain = F.lit(float(c.w)) * passed[c.hop]
        gains[c.feature] = gains[c.feature] + gain if c.feature in gains else gain
    parts = [
        F.struct(
            F.lit(feature).alias("feature_name"),
            F.lit(groups[feature]).alias("modality"),
            F.col(feature).alias("value"),
            (gain * (F.col(feature) - F.lit(float((base or {}).get(feature, 0.0))))).alias("contribution"),
        )
        for feature, gain in gains.items()
    ]
    total = F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + F.abs(p["contribution"]))

    def with_share(p: Column) -> Column:
        share = F.when(F.col("total") > 0, F.abs(p["contribution"]) / F.col("total")).otherwise(F.lit(0.0))
        return p.withField("importance", share)

    return (
        matrix.join(back, "segment_id")
        .select("segment_id", F.array(*parts).alias("parts"))
        .withColumn("total", total)
        .select("segment_id", F.transform("parts", with_share).alias("parts"))
    )


def attribution(
    matrix: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    coefs: Sequence[Coefficient],
    base: dict[str, float] | None = None,
    self_weight: float = SELF_WEIGHT,
) -> DataFrame:
    """``segment_id, feature_name, modality, value, contribution, importance``, long form."""
    arrays = attribution_arrays(matrix, nodes, edges, coefs, base, self_weight)
    # Never empty. The outer form keeps the optimizer from adding a not-empty filter
    # that would compute the array once more.
    return arrays.select("segment_id", F.inline_outer("parts"))


def topk_nested(arrays: DataFrame, k: int = 6) -> DataFrame:
    """``segment_id, top_features``: the ``k`` most important features, best first.

    Sorted inside the row, without a shuffle. Numbers are rounded for reporting.
    """
    # Importances are compared after rounding to 12 digits: ties go by name.
    ordered = F.transform(
        "parts",
        lambda p: F.struct((-F.round(p["importance"], 12)).alias("o"), p["feature_name"].alias("n"), p.alias("p")),
    )
    best = F.slice(F.array_sort(ordered), 1, k)

    def report(e: Column, i: Column) -> Column:
        p = e["p"]
        return F.struct(
            (i + 1).alias("feature_rank"),
            p["feature_name"].alias("feature_name"),
            F.round(p["importance"], 4).alias("importance"),
            F.round(p["value"], 4).alias("value"),
            p["modality"].alias("modality"),
        )

    return arrays.select("segment_id", F.transform(best, report).alias("top_features"))


def topk_features(arrays: DataFrame, k: int = 6) -> DataFrame:
    """The top features, one row each."""
    return topk_nested(arrays, k).select("segment_id", F.inline_outer("top_features"))


def _rule_table(rules: Sequence[Rule]) -> Column:
    return F.array(
        *[F.struct(*[F.lit(v).alias(n) for n, v in r._asdict().items()]) for r in rules]
    )


def _holds(rule: Column, value: Column) -> Column:
    t = rule["threshold"]
    return (
        F.when(rule["op"] == ">=", value >= t).when(rule["op"] == "<", value < t).otherwise(value > t)
    )


def _measure(category: Column, reference: Column, rationale: Column) -> Column:
    return F.struct(
        category.alias("category"), reference.alias("fhwa_reference"), rationale.alias("rationale")
    )


def countermeasures(
    features: DataFrame, rules: Sequence[Rule] = RULES, max_suggestions: int = 3
) -> DataFrame:
    """``segment_id, suggestions`` from ``segment_id, top_features``.

    Features are taken in rank order. Each adds the first rule that matches its
    name and value and whose category is not there yet; a feature whose rule is
    taken falls through to its next one. Without any match there is one explicit
    entry saying so.
    """
    table = _rule_table(rules)
    none_yet = F.slice(
        F.transform(table, lambda r: _measure(r["category"], r["fhwa_reference"], r["rationale"])), 1, 0
    )

    def add(found: Column, feature: Column) -> Column:
        fits = F.filter(
            table,
            lambda r: (F.instr(F.lower(feature["feature_name"]), r["feature_contains"]) > 0)
            & _holds(r, feature["value"])
            & ~F.exists(found, lambda f: f["category"] == r["category"]),
        )
        first = F.transform(
            F.slice(fits, 1, 1), lambda r: _measure(r["category"], r["fhwa_reference"], r["rationale"])
        )
        return F.when(F.size(found) >= max_suggestions, found).otherwise(F.concat(found, first))

    matched = F.aggregate("top_features", none_yet, add)
    fallback = F.array(_measure(*[F.lit(x) for x in NO_RULE]))
    return features.select(
        "segment_id", matched.alias("m")
    ).select("segment_id", F.when(F.size("m") > 0, F.col("m")).otherwise(fallback).alias("suggestions"))


def countermeasure_rows(suggested: DataFrame) -> DataFrame:
    return suggested.select("segment_id", F.posexplode_outer("suggestions").alias("p", "s")).select(
        "segment_id", (F.col("p") + 1).alias("suggestion_rank"), "s.*"
    )


def topk_jaccard(a: DataFrame, b: DataFrame) -> DataFrame:
    """``segment_id, jaccard`` of two ``top_features`` sets; two empty sets give 0."""

    def names(df: DataFrame, out: str) -> DataFrame:
        return df.select("segment_id", F.col("top_features.feature_name").alias(out))

    both = names(a, "a").join(names(b, "b"), "segment_id", "left")
    x, y = F.col("a"), F.coalesce("b", F.array().cast("array<string>"))
    union = F.size(F.array_union(x, y))
    return both.select(
        "segment_id",
        F.when(union > 0, F.size(F.array_intersect(x, y)) / union).otherwise(F.lit(0.0)).alias("jaccard"),
    )


def topk_stability(
    matrix: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    base: DataFrame,
    fits: Sequence[Sequence[Coefficient]],
    k: int = 6,
    self_weight: float = SELF_WEIGHT,
    partial: bool = False,
) -> DataFrame:
    """``segment_id, explanation_confidence``: mean overlap of a segment's ``top_features``
    in ``base`` with its top features under each of ``fits`` (raw weights).

    All fits are applied inside the row; the graph is looked at once, however many
    there are. A segment of ``base`` that is not in ``matrix`` overlaps with nothing.
    """
    features = list(dict.fromkeys(c.feature for coefs in fits for c in coefs))
    gains = []
    for coefs in fits:
        by_hop = {(c.feature, c.hop): 0.0 for c in coefs}
        for c in coefs:
            by_hop[(c.feature, c.hop)] += c.w
        gains.append(
            F.array(*[F.struct(*[F.lit(float(by_hop.get((f, h), 0.0))).alias(f"g{h}") for h in (0, 1, 2)]) for f in features])
        )
    back = return_weight(nodes, edges, self_weight, partial).withColumnRenamed("node", "segment_id")
    values = F.array(*[F.struct(F.lit(f).alias("n"), F.col(f).alias("v")) for f in features])
    rows = matrix.join(back, "segment_id").select("segment_id", "back_1", "back_2", values.alias("values"))

    def weighed(fit: Column) -> Column:
        def one(v: Column, g: Column) -> Column:
            gain = g["g0"] + g["g1"] * F.col("back_1") + g["g2"] * F.col("back_2")
            return F.struct(v["n"].alias("n"), F.abs(gain * v["v"]).alias("c"))

        return F.zip_with("values", fit, one)

    def with_total(parts: Column) -> Column:
        return F.struct(parts.alias("parts"), F.aggregate(parts, F.lit(0.0), lambda a, x: a + x["c"]).alias("total"))

    def best(fit: Column) -> Column:
        def place(x: Column) -> Column:
            share = F.when(fit["total"] > 0, x["c"] / fit["total"]).otherwise(F.lit(0.0))
            return F.struct((-F.round(share, 12)).alias("o"), x["n"].alias("n"))

        return F.transform(F.slice(F.array_sort(F.transform(fit["parts"], place)), 1, k), lambda x: x["n"])

    under = rows.select("segment_id", F.transform(F.array(*gains), weighed).alias("parts"))
    under = under.select("segment_id", F.transform("parts", with_total).alias("fits"))
    under = under.select("segment_id", F.transform("fits", best).alias("sets"))

    def overlap(other: Column) -> Column:
        union = F.size(F.array_union("own", other))
        return F.when(union > 0, F.size(F.array_intersect("own", other)) / union).otherwise(F.lit(0.0))

    own = base.select("segment_id", F.col("top_features.feature_name").alias("own"))
    every = own.join(under, "segment_id", "left").select("segment_id", F.transform("sets", overlap).alias("overlaps"))
    mean = F.aggregate("overlaps", F.lit(0.0), lambda a, x: a + x) / F.lit(float(len(fits)))
    return every.select("segment_id", F.coalesce(mean, F.lit(0.0)).alias("explanation_confidence"))


def poisson_weight(key: Column, run: int) -> Column:
    """Bootstrap weight of a row in one rerun: a Poisson(1) draw from a hash of its key."""
    u = F.pmod(F.xxhash64(key, F.lit(run)), F.lit(1_000_000)) / F.lit(1_000_000.0)
    # Cumulative Poisson(1) probabilities.
    steps = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582]
    draw = F.lit(6)
    for k in range(len(steps) - 1, -1, -1):
        draw = F.when(u < steps[k], F.lit(k)).otherwise(draw)
    return draw
