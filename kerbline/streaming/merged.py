"""Live incidents as a table that is merged when it is read: small deltas per batch, compacted bucket by bucket."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from kerbline.session import durable_at

BUCKETS = 16
# Deltas of a bucket that a reader merges at most, before they are made one.
DELTAS = 8
# A bucket's deltas go into its base once they have this share of the base's bytes.
FOLD_SHARE = 0.5
# Manifests whose files stay, so that a reader that began with one of them can go on.
KEPT_MANIFESTS = 3
BUCKET = "_bucket"


def latest_per_key(records: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The newest record of each key. Partial maxima are taken before the shuffle."""
    rest = [c for c in records.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return records.groupBy(key).agg(newest).select(*[key if c == key else f"r.{c}" for c in records.columns])


class _Store:
    """Manifests and data folders under a root; a manifest counts once it has its name."""

    def __init__(self, spark: SparkSession, root: str):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._path, self.root = hadoop.Path, root.rstrip("/")
        self._files = hadoop.Path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        top = self._path(folder)
        return [str(s.getPath().getName()) for s in self._files.listStatus(top)] if self._files.exists(top) else []

    def versions(self) -> list[int]:
        found = map(re.compile(r"manifest-(\d+)\.json").fullmatch, self._names(f"{self.root}/manifests"))
        return sorted(int(m[1]) for m in found if m)

    def _manifest(self, version: int) -> str:
        return f"{self.root}/manifests/manifest-{version:012d}.json"

    def load(self, version: int) -> dict:
        stream = self._files.open(self._path(self._manifest(version)))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def newest(self) -> dict | None:
        versions = self.versions()
        return self.load(versions[-1]) if versions else None

    def commit(self, state: dict) -> None:
        """Puts the manifest in place at once, then removes what no kept one names."""
        made = self._path(f"{self.root}/manifests/.{uuid.uuid4().hex}")
        stream = self._files.create(made, False)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        place = self._path(self._manifest(state["version"]))
        if self._files.exists(place) or not self._files.rename(made, place):
            raise RuntimeError(f"version {state['version']} is there already: another writer is at work")
        versions = self.versions()
        for version in versions[:-KEPT_MANIFESTS]:
            self._files.delete(self._path(self._manifest(version)), False)
        named = {f["path"] for v in versions[-KEPT_MANIFESTS:] for runs in self.load(v)["buckets"].values() for f in runs}
        folders = {p.rsplit("/", 1)[0] for p in named}
        for name in self._names(f"{self.root}/data"):
            if f"{self.root}/data/{name}" not in folders:
                self._files.delete(self._path(f"{self.root}/data/{name}"), True)

    def written(self, folder: str) -> dict[str, dict]:
        """Bucket -> its part of a data folder, and the bytes in it."""
        out = {}
        for name in self._names(folder):
            if found := re.fullmatch(rf"{BUCKET}=(\d+)", name):
                path = f"{folder}/{name}"
                out[found[1]] = {"path": path, "bytes": int(self._files.getContentSummary(self._path(path)).getLength())}
        return out


def _later(a, b):
    return b if a is None else a if b is None else max(a, b)


def _passed(state: dict, ts: str, retain_s: float) -> Column:
    """Whether a time lies further back than late records are waited for."""
    return F.unix_micros(F.col(ts).cast("timestamp")) < F.lit(int(state["watermark"] - retain_s * 1e6))


def _ended(state: dict) -> Column:
    """Whether the newest record of an incident says that it is over."""
    over = F.lit(False)
    if state["end"]:
        end = F.unix_micros(F.col(state["end"]).cast("timestamp"))
        over = over | F.coalesce(end <= F.lit(state["watermark"]), F.lit(False))
    if state["pull"]:
        pull = _comparable(state["pull"], StructType.fromJson(state["schema"]))
        over = over | ~pull.eqNullSafe(F.lit(state["newest_pull"]))
    return over


def _comparable(column: str, schema: StructType) -> Column:
    """A pull's name as a value that a manifest keeps and orders: times as whole numbers."""
    kind = schema[column].dataType.typeName()
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column)


def _rows(spark: SparkSession, state: dict, runs: Sequence[dict]) -> DataFrame:
    schema = StructType.fromJson(state["schema"])
    paths = [r["path"] for r in runs]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def merge_deltas(
    root: str,
    key: str,
    order: Sequence[str],
    ts: str | None = None,
    end: str | None = None,
    pull: str | None = None,
    retain_s: float = 7 * 86_400.0,
    buckets: int = BUCKETS,
    deltas: int = DELTAS,
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer: the newest record per key of each batch, as a delta of its own.

    A batch writes its own rows only. ``read_merged`` takes the newest record per key
    over all deltas. A bucket with ``deltas`` of them has them made one, or folded into
    its base once they are large against it, so what is written stays in proportion to
    what came in. Readers follow one manifest and never see half a batch or half a
    compaction.

    An incident leaves the snapshot when its newest record has an ``end`` at or before
    the newest ``ts`` of all records, or when the newest ``pull`` does not hold it (a
    pull holds all active incidents, and a batch whole pulls). Its record stays as a
    tombstone, so a record delivered late does not revive it, until it is older than
    ``retain_s``; records as old as that are refused. Pulls are named by numbers, texts
    or times, and the greatest is the newest.

    Buckets are those of the first batch. A repeated batch changes nothing. One writer
    at a time: a second one fails when it commits.
    """
    if (end or pull) and not ts:
        raise ValueError("leaving the snapshot needs the time column ts")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        store = _Store(spark, root)
        state = store.newest() or {
            "version": -1, "watermark": None, "newest_pull": None, "buckets": {}, "n_buckets": buckets,
            "schema": json.loads(batch.schema.json()), "key": key, "order": list(order), "end": end, "pull": pull,
        }
        rows = batch.select(*StructType.fromJson(state["schema"]).names)
        if ts and (end or pull) and state["watermark"] is not None:
            rows = rows.where(~F.coalesce(_passed(state, ts, retain_s), F.lit(False)))
        bucket = F.pmod(F.xxhash64(key), F.lit(state["n_buckets"])).cast("int").alias(BUCKET)
        metrics = {"n": F.count(F.lit(1))}
        if ts:
            metrics["watermark"] = F.max(F.unix_micros(F.col(ts).cast("timestamp")))
        if pull:
            metrics["pull"] = F.max(_comparable(pull, StructType.fromJson(state["schema"])))
        version = state["version"] + 1
        folder = f"{store.root}/data/{version:012d}-{uuid.uuid4().hex[:8]}"
        newest = latest_per_key(rows, key, order).select("*", bucket).repartition(BUCKET)
        seen = durable_at(newest, folder, BUCKET, metrics)
        state["watermark"] = _later(state["watermark"], seen.get("watermark"))
        state["newest_pull"] = _later(state["newest_pull"], seen.get("pull"))
        for b, run in store.written(folder).items():
            runs = state["buckets"].setdefault(b, [])
            # The first run of a bucket has nothing below it.
            runs.append({**run, "base": not runs})
        _compact(spark, store, state, version, deltas, retain_s, ts)
        store.commit(state | {"version": version})

    return write


def _compact(
    spark: SparkSession, store: _Store, state: dict, version: int, deltas: int, retain_s: float, ts: str | None
) -> None:
    """Makes the deltas of full buckets one run each; other buckets are not touched."""
    merged, folded = [], []
    for b, runs in state["buckets"].items():
        own = [r for r in runs if not r["base"]]
        if len(own) >= deltas:
            base = sum(r["bytes"] for r in runs if r["base"])
            (folded if sum(r["bytes"] for r in own) >= FOLD_SHARE * base else merged).append(b)
    for chosen, whole in ((merged, False), (folded, True)):
        if not chosen:
            continue
        runs = [r for b in chosen for r in state["buckets"][b] if whole or not r["base"]]
        rows = latest_per_key(_rows(spark, state, runs), state["key"], state["order"])
        if whole and ts and state["watermark"] is not None:
            # Only with the base: a tombstone that goes earlier would bring the base's record back.
            rows = rows.where(~(_ended(state) & F.coalesce(_passed(state, ts, retain_s), F.lit(False))))
        bucket = F.pmod(F.xxhash64(state["key"]), F.lit(state["n_buckets"])).cast("int").alias(BUCKET)
        folder = f"{store.root}/data/{version:012d}-{uuid.uuid4().hex[:8]}"
        durable_at(rows.select("*", bucket).repartition(BUCKET), folder, BUCKET)
        found = store.written(folder)
        for b in chosen:
            kept = [] if whole else [r for r in state["buckets"][b] if r["base"]]
            state["buckets"][b] = kept + ([{**found[b], "base": whole}] if b in found else [])


def read_merged(spark: SparkSession, root: str) -> DataFrame | None:
    """The active incidents of the newest version under ``root``, or None; their newest records."""
    state = _Store(spark, root).newest()
    if state is None:
        return None
    rows = _rows(spark, state, [r for runs in state["buckets"].values() for r in runs])
    newest = latest_per_key(rows, state["key"], state["order"])
    return newest.where(~_ended(state)) if state["end"] or state["pull"] else newest
