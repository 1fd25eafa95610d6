"""Sharding of road records by weighted rendezvous hashing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.session import durable


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard that wins ``key``: each draws an exponential waiting time, the shortest wins.

    A draw depends on the key and the shard's number only, so one more shard
    takes keys only into itself, and a shard gets keys in proportion to its weight.
    """
    if not weights or any(w <= 0 for w in weights):
        raise ValueError("every shard needs a positive weight")
    draws = []
    for shard, weight in enumerate(weights):
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11)
        wait = -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 53))) / F.lit(float(weight))
        draws.append(F.struct(wait.alias("wait"), F.lit(shard).alias("shard")))
    return F.array_min(F.array(*draws))["shard"]


def shard_segments(
    segments: DataFrame,
    weights: Sequence[float],
    key: str = "segment_id",
    payload: str = "segment_name",
    grown_by: float | None = None,
) -> DataFrame:
    """Places segment records in weighted shards and numbers them there without gaps.

    Method: rendezvous hashing of the stable record key. Returns ``key``, size
    (UTF-8 bytes of ``payload`` plus 1, missing: none), payload_crc32, shard,
    slot (0, 1, ... in each shard), grown_shard (with one more shard of weight
    ``grown_by``; null without it).

    Only keys, sizes and checksums are moved, never the payload. Slots come from
    counts per (shard, part of the input) and a running number in each, so no
    shard is numbered by one task, whatever its weight or its keys.

    Edge cases: all records without a key share one shard. A missing payload
    counts as empty. Repeated rows each get their own slot, in one shard. An
    empty table gives an empty result. Other columns are ignored.
    """
    text = F.coalesce(F.col(payload), F.lit(""))
    grown = rendezvous_shard(F.col(key), [*weights, grown_by]) if grown_by else F.lit(None).cast("int")
    placed = durable(
        segments.select(
            F.col(key).alias("_key"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("payload_crc32"),
            rendezvous_shard(F.col(key), weights).alias("shard"),
            grown.alias("grown_shard"),
            # Stored with the row, so both passes below see the same part.
            F.spark_partition_id().alias("_part"),
        ),
        "placed",
    )
    # One row per (shard, part); its order within the shard gives the first slot.
    counts = placed.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = durable(
        counts.select("shard", "_part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("_start")), "slot-starts"
    )
    nth = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("_key", "payload_crc32"))
    return (
        placed.withColumn("_nth", nth)
        .join(starts, ["shard", "_part"])
        .select(
            F.col("_key").alias(key),
            "size",
            "payload_crc32",
            "shard",
            (F.col("_start") + F.col("_nth") - 1).cast("long").alias("slot"),
            "grown_shard",
        )
    )
