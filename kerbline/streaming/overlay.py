"""Live incident overlay: the latest record per incident, batch and streaming."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kerbline.streaming.merged import latest_per_key, merge_deltas, read_merged

# Complete versions that stay readable; older ones are removed after a new one is complete.
KEPT_VERSIONS = 2


def overlay_counts(snapshot: DataFrame, county: str, event_type: str) -> DataFrame:
    return snapshot.groupBy(county, event_type).agg(F.count("*").alias("n"))


def write_snapshot(records: DataFrame, path: str) -> None:
    """Replace the stored snapshot. Without records the result is a valid empty table."""
    records.write.mode("overwrite").parquet(path)


class _Versions:
    """The version folders under a root. A version counts once its success mark is there."""

    def __init__(self, spark: SparkSession, root: str):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path, self._root = hadoop.Path, root.rstrip("/")
        self._files = hadoop.Path(self._root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def folder(self, version: int) -> str:
        return f"{self._root}/v={version}"

    def all(self) -> list[int]:
        top = self._path(self._root)
        if not self._files.exists(top):
            return []
        names = (str(s.getPath().getName()) for s in self._files.listStatus(top))
        return sorted(int(m[1]) for m in map(re.compile(r"v=(\d+)").fullmatch, names) if m)

    def complete(self) -> list[int]:
        return [v for v in self.all() if self._files.exists(self._path(f"{self.folder(v)}/_SUCCESS"))]

    def remove_before(self, version: int) -> None:
        for v in self.all():
            if v < version:
                self._files.delete(self._path(self.folder(v)), True)


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest complete version under ``root``, or None; other versions are not looked into."""
    merged = read_merged(spark, root)
    if merged is not None:
        return merged
    versions = _Versions(spark, root)
    complete = versions.complete()
    return spark.read.parquet(versions.folder(complete[-1])) if complete else None


def merge_batches(root: str, key: str, order: Sequence[str]) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: merge the batch with the newest complete version into a new one.

    For snapshots that are small against a batch; ``merged.merge_deltas`` writes the
    batch only.

    Versions are numbered in the order they are begun, whatever the batch's own
    number, so a stream that starts anew on the same root goes on from what is
    there. A version left half written is never read. Taking the latest record
    per key twice changes nothing, so a repeated batch is harmless.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = _Versions(spark, root)
        begun, complete = versions.all(), versions.complete()
        rows = batch
        if complete:
            rows = spark.read.parquet(versions.folder(complete[-1])).select(*batch.columns).unionByName(batch)
        new = begun[-1] + 1 if begun else 0
        latest_per_key(rows, key, order).write.parquet(versions.folder(new))
        kept = [*complete, new][-KEPT_VERSIONS:]
        versions.remove_before(kept[0])

    return write


def without_redelivery(stream: DataFrame, ids: Sequence[str], ts: str, delay: str) -> DataFrame:
    """Drop repeated deliveries that arrive within ``delay``; state stays bounded."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(ids))


def start_overlay(
    stream: DataFrame,
    root: str,
    checkpoint: str,
    key: str,
    order: Sequence[str],
    ids: Sequence[str] = (),
    ts: str | None = None,
    delay: str = "1 hour",
    end: str | None = None,
    pull: str | None = None,
    retain_s: float = 7 * 86_400.0,
) -> StreamingQuery:
    """Keep the snapshot under ``root``, merged when it is read (``current``).

    With ``ids`` and ``ts`` repeated deliveries are dropped first. With ``end`` or
    ``pull`` incidents that are over leave the snapshot (see ``merge_deltas``).
    """
    if ids:
        if ts is None:
            raise ValueError("dropping repeated deliveries needs the time column ts")
        stream = without_redelivery(stream, ids, ts, delay)
    return (
        stream.writeStream.foreachBatch(merge_deltas(root, key, order, ts, end, pull, retain_s))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
