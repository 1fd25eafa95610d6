"""Finding hot join keys and joining around them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.session import rows_of

# Keys that one sketch can name, as a share of all rows.
HOT_SHARE = 0.001
# Rows of one key that one task should get; a key with more is hot.
HOT_MIN_ROWS = 100_000
# Copies of the other side's rows that a hot key may ask for.
MOST_SALTS = 4096
# What was found for written tables that are still in use.
_KNOWN: WeakKeyDictionary[DataFrame, dict] = WeakKeyDictionary()


def _key_hash(keys: Sequence[str], alias: str | None = None) -> Column:
    cols = [F.col(f"{alias}.{k}" if alias else k) for k in keys]
    return F.xxhash64(*cols)


def hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    share: float = HOT_SHARE,
    min_rows: int | None = None,
    base: DataFrame | None = None,
) -> dict[int, int]:
    """Hashes of the keys with more rows than one task should get, and their salts.

    The number of salts follows from the key's own count, so that the rows per
    salt stay bounded whatever the size of the table.

    One pass with a mergeable frequent-items sketch; at most ``1 / share``
    numbers reach the driver. The list only steers row placement: a key that is
    missing from it is joined just as correctly, without being split.

    ``base`` is a written table whose row count bounds the rows of any one key;
    when it is small the sketch is not needed.
    """
    least = HOT_MIN_ROWS if min_rows is None else min_rows
    if base is df:
        # A written table does not change; its edges, say, are asked about by every step.
        known, asked = _KNOWN.setdefault(df, {}), (tuple(keys), share, least)
        if asked not in known:
            known[asked] = {} if rows_of(df) <= least else hot_keys(df, keys, share, least)
        return known[asked]
    if base is not None and rows_of(base) <= least:
        return {}
    top = int(1 / share)
    row = (
        df.where(F.greatest(*[F.col(k).isNull().cast("int") for k in keys], F.lit(0)) == 0)
        .select(_key_hash(keys).alias("h"))
        .agg(
            F.count("*").alias("n"),
            F.expr(f"approx_top_k(h, {top}, {top * 10})").alias("top"),
        )
        .first()
    )
    return {item["item"]: _salts_for(item["count"], least) for item in row["top"] or () if item["count"] > least}


def _salts_for(count: int, least: int) -> int:
    return min(MOST_SALTS, max(2, -(-count // max(1, least))))


def hot_counted(counts: DataFrame, keys: Sequence[str], n: str) -> dict[int, int]:
    """The same from rows already counted per key, exactly; the ``1 / HOT_SHARE`` largest at most."""
    most = counts.where(F.col(n) > HOT_MIN_ROWS).orderBy(F.desc(n)).limit(int(1 / HOT_SHARE))
    return {r["h"]: _salts_for(r["n"], HOT_MIN_ROWS) for r in most.select(_key_hash(keys).alias("h"), F.col(n).alias("n")).collect()}


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    hot: Mapping[int, int] | None = None,
    salt_by: Sequence[str] = (),
) -> DataFrame:
    """Join where single keys of ``left`` may be very frequent.

    Rows of hot keys are spread over the key's salts by a hash of ``salt_by``
    (all columns by default) and the matching rows of ``right`` are repeated for
    each part. Without hot keys this is an ordinary join.
    """
    keys = list(keys)
    if not hot:
        return left.join(right, keys, how)
    table = F.create_map(*[F.lit(x).cast("long") for pair in hot.items() for x in pair])
    salts = F.coalesce(F.try_element_at(table, _key_hash(keys)), F.lit(1).cast("long"))
    spread = F.pmod(F.xxhash64(F.lit(7), *[F.col(c) for c in (salt_by or left.columns)]), salts)
    left_salted = left.withColumn("_salt", spread)
    right_salted = right.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)))
    return left_salted.join(right_salted, [*keys, "_salt"], how).drop("_salt")
