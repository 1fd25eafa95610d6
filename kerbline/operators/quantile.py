"""Exact quantiles per group without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.session import durable

# Rank error of the first-pass sketch is at most rows / ACCURACY.
ACCURACY = 50_000
# Groups up to this size skip the narrowing.
SMALL_GROUP = 200_000


def _same(keys: Sequence[str], a: str, b: str) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return cond


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    quantiles: dict[str, float],
    interpolate: bool = True,
    accuracy: int = ACCURACY,
    small_group: int = SMALL_GROUP,
) -> DataFrame:
    """One row per group with one column per entry of ``quantiles``.

    With ``interpolate`` the value lies linearly between the two neighbours of
    rank ``(n - 1) * q``; otherwise it is the element of rank
    ``min(n - 1, floor(n * q))``. Nulls and NaN are left out.

    Pass one sketches each group and brackets every wanted rank from both sides
    by more than the sketch's error. Pass two counts what lies below the bracket
    and keeps only distinct values inside it, so the ordered step sees about
    ``8 / accuracy`` of a group. The counts then show whether both neighbours of
    the rank lie in the bracket; groups where one does not are ordered in full.
    ``accuracy`` and ``small_group`` (groups that skip the brackets) decide about
    the work, not about the result.
    """
    names = list(quantiles)
    margin = 4.0 / accuracy
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(
        *keys, F.col(value).cast("double").alias("_x")
    )
    edges = [e for n in names for e in (max(quantiles[n] - margin, 0.0), min(quantiles[n] + margin, 1.0))]
    sketch = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.percentile_approx("_x", [float(e) for e in edges], accuracy).alias("_p"),
    )
    whole = F.col("_n") <= small_group

    def rank(q: float) -> Column:
        if interpolate:
            return (F.col("_n") - 1) * F.lit(q)
        return F.least(F.col("_n") - 1, F.floor(F.col("_n") * F.lit(q))).cast("double")

    brackets = sketch.select(
        *keys,
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("name"),
                    F.when(~whole & F.lit(quantiles[n] > margin), F.col("_p")[2 * i]).alias("lo"),
                    F.when(~whole & F.lit(quantiles[n] < 1 - margin), F.col("_p")[2 * i + 1]).alias("hi"),
                    rank(quantiles[n]).alias("rank"),
                )
                for i, n in enumerate(names)
            ]
        ).alias("_b"),
    )
    if keys:
        # One row per group, written first so that its real size decides on a broadcast.
        paired = rows.alias("r").join(durable(brackets, "brackets").alias("b"), _same(keys, "r", "b"))
    else:
        # A single row of brackets becomes part of the plan.
        known = brackets.first()["_b"]
        fields = ("name", "lo", "hi", "rank")
        types = ("string", "double", "double", "double")
        constants = F.array(
            *[F.struct(*[F.lit(b[f]).cast(t).alias(f) for f, t in zip(fields, types)]) for b in known]
        )
        paired = rows.alias("r").withColumn("_b", constants)
    picked = durable(_picked(paired, keys, "hi", "lo"), "ranks")
    missed = picked.where("NOT held").select(*keys).distinct()
    if not missed.isEmpty():
        full = rows.alias("r").join(missed.alias("m"), _same(keys, "r", "m"), "left_semi") if keys else rows.alias("r")
        counts = full.groupBy(*keys).agg(F.count("*").alias("_n"))
        ranks = F.array(*[F.struct(F.lit(n).alias("name"), rank(quantiles[n]).alias("rank")) for n in names])
        counts = durable(counts.select(*keys, ranks.alias("_b")), "missed")
        again = rows.alias("r").join(counts.alias("c"), _same(keys, "r", "c"))
        redone = _picked(again, keys, "CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
        sound = picked.alias("p").join(missed.alias("m"), _same(keys, "p", "m"), "left_anti") if keys else picked.limit(0)
        picked = sound.unionByName(redone)
    wide = [F.max(F.when(F.col("name") == n, F.col("q"))).alias(n) for n in names]
    return picked.groupBy(*keys).agg(*wide)


def _picked(paired: DataFrame, keys: Sequence[str], hi: str, lo: str) -> DataFrame:
    """``name, q`` per group, and ``held``: the bracket holds both neighbours of the rank."""
    high, low_end = F.expr(hi), F.expr(lo)
    # Values below the bracket share one null row, values above it are not needed.
    inside = (
        paired.select(*[F.col(f"r.{k}") for k in keys], "_x", F.inline("_b"))
        .where(high.isNull() | (F.col("_x") <= high))
        .select(
            *keys,
            "name",
            "rank",
            F.when(low_end.isNull() | (F.col("_x") >= low_end), F.col("_x")).alias("v"),
        )
        .groupBy(*keys, "name", "rank", "v")
        .agg(F.count("*").alias("c"))
    )
    up_to = F.sum("c").over(
        Window.partitionBy(*keys, "name").orderBy(F.col("v").asc_nulls_first()).rowsBetween(
            Window.unboundedPreceding, Window.currentRow
        )
    )
    low = F.floor("rank")
    at = lambda r: F.min(F.when(F.col("up_to") > r, F.col("v")))
    below = F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("c"))), F.lit(0))
    return (
        inside.withColumn("up_to", up_to)
        .groupBy(*keys, "name", "rank")
        .agg(at(low).alias("a"), at(F.ceil("rank")).alias("b"), below.alias("below"), F.sum("c").alias("upto"))
        .select(
            *keys,
            "name",
            (F.col("a") + (F.col("b") - F.col("a")) * (F.col("rank") - low)).alias("q"),
            ((F.col("below") <= low) & (F.col("upto") > F.ceil("rank"))).alias("held"),
        )
    )
