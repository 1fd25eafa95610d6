"""Row-level cleaning and labelling expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# Functional class labels.
FUNC_CLASS_LABELS = {
    1: "Interstate",
    2: "Other Freeway/Expressway",
    3: "Other Principal Arterial",
    4: "Minor Arterial",
    5: "Major Collector",
    6: "Minor Collector",
    7: "Local",
}


def zero_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(0))


def nonpositive_to_null(c: Column) -> Column:
    return F.when(c > 0, c)


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def epoch_ms(c: Column) -> Column:
    """Epoch milliseconds (number or text) to timestamp.

    Null when unreadable or outside what a 64-bit nanosecond clock can hold.
    """
    ms = c.try_cast("bigint")
    limit = 9_223_372_036_854
    return F.timestamp_millis(F.when(ms.between(-limit, limit), ms))


def label_of(code: Column, labels: Mapping) -> Column:
    pairs = [F.lit(v) for kv in labels.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), code)


def flag_or_no(c: Column) -> Column:
    return F.coalesce(c, F.lit("N"))


def title_case(c: Column) -> Column:
    return F.initcap(F.lower(c))


def segment_name(street: Column, route: Column, route_id: Column, county: Column) -> Column:
    base = F.coalesce(
        F.nullif(street, F.lit("")),
        F.nullif(route, F.lit("")),
        F.concat(F.lit("Route "), route_id),
    )
    return F.concat(base, F.lit(" ("), county, F.lit(")"))


def softplus(x: Column) -> Column:
    """ln(1 + e^x), written so that large x does not overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def log_exposure(aadt: Column) -> Column:
    one = F.lit(1.0)
    return F.log(F.greatest(F.coalesce(aadt, one), one))


def rank_tier(rank: Column) -> Column:
    return F.when(rank <= 3, "Critical").when(rank <= 10, "High").otherwise("Elevated")
