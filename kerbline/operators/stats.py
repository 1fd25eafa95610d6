"""Column statistics fitted in one aggregation and applied to every row.

A fit is a one-row result whose numbers become constants of the next plan: the
table is not shuffled and no window runs over all of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _present(c: str | Column) -> Column:
    """NaN counts as missing, as null does."""
    x = (F.col(c) if isinstance(c, str) else c).cast("double")
    return F.when(~F.isnan(x), x)


def _fit(df: DataFrame, **aggs: Column) -> dict[str, float | None]:
    return df.agg(*[a.cast("double").alias(n) for n, a in aggs.items()]).first().asDict()


def minmax_of(cols: Sequence[str]) -> dict[str, Column]:
    """The aggregates of ``fit_minmax`` by name, to be taken while a table is written."""
    return {f"lo_{c}": F.min(_present(c)) for c in cols} | {f"hi_{c}": F.max(_present(c)) for c in cols}


def fit_minmax(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    return _fit(df, **minmax_of(cols))


def minmax(
    df: DataFrame, cols: Mapping[str, str], eps: float = 0.0, fitted: Mapping[str, float | None] | None = None
) -> DataFrame:
    """Scale columns to [0, 1] by their range; ``cols`` maps input to output names.

    ``fitted`` are the ranges if they are known (``minmax_of``).

    Missing values, NaN included, become null. A column whose range is not above ``eps``, or
    that has no value at all, becomes 0.0.
    """
    fitted = fit_minmax(df, list(cols)) if fitted is None else fitted
    out = {}
    for c, name in cols.items():
        lo, hi = fitted[f"lo_{c}"], fitted[f"hi_{c}"]
        wide_enough = lo is not None and hi - lo > eps
        out[name] = (_present(c) - F.lit(lo)) / F.lit(hi - lo) if wide_enough else F.lit(0.0)
    return df.withColumns(out)


def mean_impute(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill gaps with the column mean, or 0.0 for a column without any value."""
    means = _fit(df, **{c: F.avg(_present(c)) for c in cols})
    filled = {
        c: F.coalesce(_present(c), F.lit(0.0 if means[c] is None else means[c])) for c in cols
    }
    return df.withColumns(filled)


def fit_zscore(df: DataFrame, cols: Sequence[str], train: Column) -> dict[str, float]:
    """``mean_<c>, std_<c>`` over the training rows, population deviation.

    Deviations under 1e-6 (constant columns) become 1. Two plain numbers per
    column, so the fit can be stored with a model.
    """
    aggs: dict[str, Column] = {}
    for c in cols:
        x = F.when(train, _present(c))
        aggs[f"mean_{c}"] = F.coalesce(F.avg(x), F.lit(0.0))
        std = F.stddev_pop(x)
        aggs[f"std_{c}"] = F.when(std >= 1e-6, std).otherwise(F.lit(1.0))
    return _fit(df, **aggs)


def apply_zscore(df: DataFrame, cols: Sequence[str], fitted: Mapping[str, float]) -> DataFrame:
    return df.withColumns(
        {c: (F.col(c) - F.lit(fitted[f"mean_{c}"])) / F.lit(fitted[f"std_{c}"]) for c in cols}
    )


def undo_zscore(df: DataFrame, cols: Sequence[str], fitted: Mapping[str, float]) -> DataFrame:
    return df.withColumns(
        {c: F.col(c) * F.lit(fitted[f"std_{c}"]) + F.lit(fitted[f"mean_{c}"]) for c in cols}
    )


def hash_split(key: Column, train: float = 0.7, val: float = 0.15, bucket: Column | None = None, seed: int = 42) -> Column:
    """``train`` / ``val`` / ``test`` by a hash of the row key.

    The same key always falls in the same part, whatever the row order or
    partitioning. ``bucket`` replaces the default hash by own integers in [0, 1000).
    """
    b = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1000)) if bucket is None else bucket
    first = round(train * 1000)
    second = first + round(val * 1000)
    return F.when(b < first, "train").when(b < second, "val").otherwise("test")


def integer_bucket(key: Column, seed: int = 42) -> Column:
    """Multiplicative hash of a long key in [0, 1000), reproducible in plain SQL."""
    mixed = F.pmod(key, F.lit(1_000_003)) * F.lit(7919) + F.lit(seed)
    return F.pmod(F.pmod(mixed, F.lit(1_000_003)), F.lit(1000))
