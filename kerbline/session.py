"""Session settings and the shared folder used for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from weakref import WeakKeyDictionary

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: str = "8", app: str = "kerbline") -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


# Folders made for local sessions that name none, by application.
_LOCAL_DIRS: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read, taken from ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = tempfile.mkdtemp(prefix="kerbline-")
    return _LOCAL_DIRS[app]


def _run_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/kerbline/{spark.sparkContext.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{_run_dir(spark)}/{uuid.uuid4().hex[:12]}-{name}"


def drop_intermediates(spark: SparkSession) -> None:
    """Delete the intermediate tables this application wrote. Call when it is done with them."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_run_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives executor loss, and gives Catalyst the real file
    size, so a later join broadcasts it only if it is under
    ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def durable_with(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict]:
    """``durable`` and aggregates over the rows, gathered while they are written.

    Without ``metrics`` it is the number of rows, as ``n``. No job of its own is run.
    """
    seen = Observation()
    wanted = metrics or {"n": F.count(F.lit(1))}
    held = durable(df.observe(seen, *[c.alias(k) for k, c in wanted.items()]), name)
    return held, seen.get


# Row counts taken while tables were written, for those that are still in use.
_ROWS: WeakKeyDictionary[DataFrame, int] = WeakKeyDictionary()


def counted(df: DataFrame, name: str) -> DataFrame:
    """``durable``, and ``rows_of`` knows the number of rows without a job."""
    held, seen = durable_with(df, name)
    _ROWS[held] = seen["n"]
    return held


def rows_of(df: DataFrame) -> int:
    known = _ROWS.get(df)
    return df.count() if known is None else known


def durable_at(df: DataFrame, path: str, by: str, metrics: dict[str, Column] | None = None) -> dict:
    """Write ``df`` to ``path``, one folder per value of ``by``; returns aggregates over the rows, taken on the way."""
    seen = Observation()
    watched = df.observe(seen, *[c.alias(k) for k, c in metrics.items()]) if metrics else df
    watched.write.partitionBy(by).parquet(path)
    return seen.get if metrics else {}


def together(spark: SparkSession, *steps: Callable[[], DataFrame]) -> list[DataFrame]:
    """Submit independent steps at the same time, so that one fills the gaps of another."""
    with ThreadPoolExecutor(len(steps)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
        return [r.result() for r in running]
