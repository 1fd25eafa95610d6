"""Small inputs that every operator must take."""

from __future__ import annotations

import re

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
# Columns whose names operators use inside.
CLASHING = "id int, text_ string, row string, part int, key string, _id string, _norm string, draw double, size int"


def words(text: str | None) -> list[bytes]:
    return WORD.findall((text or "").encode().translate(LOWER))


def odd_reports(spark, extra: list[tuple] = ()):
    """Nulls, empty and long texts, repeated rows, and columns with clashing names."""
    rows = [
        (1, "Road closed. Crash near the old bridge, use the other exit."),
        (2, "ROAD closed. Crash near the old bridge, use the other exit."),
        (2, "ROAD closed. Crash near the old bridge, use the other exit."),
        (3, None),
        (4, ""),
        (5, "lane " * 30_000),
        (None, "No identifier here, but a text of more than five words."),
        (6, "12 34 !? ..."),
        (7, "é ñ ü  double  spaces\n\n\ttabs"),
        *extra,
    ]
    clash = (0, "t", "r", 1, "k", "i", "n", 0.5, 9)
    return spark.createDataFrame([(*r, *clash) for r in rows], f"event_id long, report string, {CLASHING}")


def no_reports(spark):
    return odd_reports(spark).limit(0)
