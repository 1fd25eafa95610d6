"""Incident reports: the text records of the live overlay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Text columns of a live incident, in the order they are read out.
REPORT_PARTS = ("Road", "Reason", "Condition", "Detour")

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def live_reports(live: DataFrame, key: str = "event_id") -> DataFrame:
    """One report (event_id, report) per live incident; null when every part is missing."""
    parts = [F.col(c).cast("string") for c in REPORT_PARTS if c in live.columns]
    text = F.concat_ws(". ", *parts) if parts else F.lit(None).cast("string")
    return live.select(F.col(key).alias("event_id"), F.when(text != "", text).alias("report"))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is.

    ``lower`` has a fast path for ASCII text but also changes letters outside
    A-Z, so it is used only where there are none.
    """
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )
