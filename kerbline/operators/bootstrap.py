"""Refits of the count model on many bootstrap weights from one pass over the rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions.scalar import log_exposure
from kerbline.operators.model import TARGET, Coefficient, PoissonFit, column_of
from kerbline.operators.stats import apply_zscore

# Rows that one task turns into products at once.
CHUNK_ROWS = 4096


def _sums(rows: DataFrame, betas: np.ndarray) -> np.ndarray:
    """Per draw the gradient, the information matrix and the weight: ``(draws, p + p * p + 1)``.

    ``rows`` has ``x`` (with the leading 1), ``k``, ``offset`` and ``w`` (one weight per
    draw). Every task sends one row per draw, and these are added up by place.
    """
    draws, p = betas.shape
    chunk = CHUNK_ROWS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((draws, p + p * p + 1))
        for whole in batches:
            for batch in (whole.slice(i, chunk) for i in range(0, whole.num_rows, chunk)):
                x = batch.column("x").flatten().to_numpy().reshape(-1, p)
                w = batch.column("w").flatten().to_numpy().reshape(-1, draws)
                k = batch.column("k").to_numpy()
                mean = np.exp(x @ betas.T + batch.column("offset").to_numpy()[:, None])
                for r in range(draws):
                    total[r, :p] += x.T @ (w[:, r] * (k - mean[:, r]))
                    total[r, p:-1] += (x.T @ (x * (w[:, r] * mean[:, r])[:, None])).reshape(-1)
                    total[r, -1] += w[:, r].sum()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(draws, dtype=np.int32)), pa.array(list(total), pa.list_(pa.float64()))], ["draw", "sums"]
        )

    parts = rows.mapInArrow(add, "draw int, sums array<double>")
    added = parts.select("draw", F.posexplode("sums").alias("place", "v")).groupBy("draw", "place").agg(F.sum("v").alias("v"))
    out = np.zeros((draws, p + p * p + 1))
    found = added.toArrow()
    out[found.column("draw").to_numpy(), found.column("place").to_numpy()] = found.column("v").to_numpy()
    return out


def bootstrap_refits(
    matrix: DataFrame,
    segments: DataFrame,
    fit: PoissonFit,
    weight: Callable[[Column, int], Column],
    runs: int,
    split: Column | None = None,
    steps: int = 1,
    reg: float = 1e-6,
) -> list[PoissonFit]:
    """The fit that each of ``runs`` weight draws would give, by Newton steps from ``fit``.

    A pass over the training rows gives gradient and information matrix of all draws;
    the small systems are solved on the driver. The number of jobs is ``steps``,
    whatever the number of draws. One step is off by the square of what the draw
    moves the weights, which shrinks with the number of rows.
    """
    cols = fit.columns
    scaled = apply_zscore(matrix, cols, fit.scaler).join(
        segments.select(
            "segment_id",
            F.coalesce(F.col(TARGET), F.lit(0)).cast("double").alias("k"),
            log_exposure(F.col("aadt_raw")).alias("offset"),
            F.array(*[weight(F.col("segment_id"), r).cast("double") for r in range(1, runs + 1)]).alias("w"),
            (F.lit("train") if split is None else split).alias("_split"),
        ),
        "segment_id",
    )
    rows = scaled.where(F.col("_split") == "train").select(F.array(F.lit(1.0), *cols).alias("x"), "k", "offset", "w")
    by_name = {column_of(c): c.w for c in fit.coefs}
    start = np.array([fit.intercept, *[by_name[c] for c in cols]])
    betas, p = np.tile(start, (runs, 1)), len(start)
    ridge = np.append(0.0, np.full(p - 1, reg))
    for _ in range(steps):
        sums = _sums(rows, betas)
        for r in range(runs):
            gradient = sums[r, :p] - sums[r, -1] * ridge * betas[r]
            information = sums[r, p:-1].reshape(p, p) + sums[r, -1] * np.diag(ridge)
            # Columns without variation have no information and stay as they are.
            betas[r] += np.linalg.lstsq(information, gradient, rcond=1e-12)[0]
    return [
        PoissonFit(
            float(b[0]),
            [c._replace(w=float(b[1 + cols.index(column_of(c))])) for c in fit.coefs],
            fit.scaler,
            cols,
        )
        for b in betas
    ]


def save_coefficient_sets(spark: SparkSession, sets: Sequence[Sequence[Coefficient]], path: str) -> None:
    """``run, place, hop, feature, w``: the raw weights of several fits as one small table."""
    rows = [(run, place, *c) for run, coefs in enumerate(sets, 1) for place, c in enumerate(coefs)]
    schema = "run int, place int, hop int, feature string, w double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)


def load_coefficient_sets(spark: SparkSession, path: str) -> list[list[Coefficient]]:
    sets: dict[int, list[Coefficient]] = {}
    for r in spark.read.parquet(path).orderBy("run", "place").collect():
        sets.setdefault(r.run, []).append(Coefficient(r.hop, r.feature, r.w))
    return list(sets.values())
