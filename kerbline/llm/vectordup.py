"""Near-duplicate road segments by their feature vectors: quantised tile products, verified exactly."""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kerbline.llm.components import components
from kerbline.llm.workers import ship_package
from kerbline.operators.skew import hot_counted, salted_join
from kerbline.session import durable

SIMILARITY = 0.9
# A pair of blocks is one task's work: so many vectors of each at most, and so many components.
BLOCK_ROWS = 16_384
BLOCK_VALUES = 1 << 21
# Small inputs are cut finer, so that several tasks share them.
LEAST_BLOCKS = 6
LEAST_ROWS = 1024
TILE = 1024
# Whole numbers are exact in 32-bit products up to this many components of at most 127.
EXACT_WIDTH = 1024
# Covers the rounding of double sums.
SLACK = 1e-9
# Pairs compared in full precision at once.
PAIRS = 1 << 16


@dataclass
class Quantised:
    """Vectors of length 1, their int8 codes, and per vector the step and the length of what rounding lost."""

    units: np.ndarray
    codes: np.ndarray
    step: np.ndarray
    error: np.ndarray

    def __getitem__(self, rows: slice | np.ndarray) -> Quantised:
        return Quantised(self.units[rows], self.codes[rows], self.step[rows], self.error[rows])


def quantised(vectors: np.ndarray) -> Quantised:
    """Codes of vectors that are finite and not zero."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    step = np.abs(units).max(axis=1) / 127
    codes = np.rint(units / step[:, None]).astype(np.int8)
    return Quantised(units, codes, step, np.linalg.norm(units - codes * step[:, None], axis=1))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of int8 codes, as whole numbers."""
    width = a.shape[1]
    if width <= EXACT_WIDTH:
        return a.astype(np.float32) @ b.astype(np.float32).T
    total = np.zeros((len(a), len(b)))
    for i in range(0, width, EXACT_WIDTH):
        total += _products(a[:, i : i + EXACT_WIDTH], b[:, i : i + EXACT_WIDTH])
    return total


def tile_links(a: Quantised, b: Quantised, similarity: float) -> tuple[np.ndarray, np.ndarray, int]:
    """(i, j) of the pairs with a cosine of at least ``similarity``, and how many were looked at in full.

    The product of two quantised vectors is off by at most e_a + (1 + e_a) e_b,
    where e is the length of what rounding lost. Only pairs whose interval holds
    the threshold are computed in full precision.
    """
    products = _products(a.codes, b.codes)
    lost = a.error.max() + (1 + a.error.max()) * b.error.max() + SLACK
    least = similarity - lost
    step = (a.step.max() * b.step.max()) if least > 0 else (a.step.min() * b.step.min())
    # No pair of this tile can do with less; a float just below, so that rounding loses none.
    at = np.flatnonzero(products.reshape(-1) >= products.dtype.type(least / step * (1 - 1e-6 * np.sign(least))))
    i, j = np.divmod(at, len(b.codes))
    estimate = products.reshape(-1)[at].astype(np.float64) * a.step[i] * b.step[j]
    bound = a.error[i] + (1 + a.error[i]) * b.error[j] + SLACK
    linked = estimate - bound >= similarity
    unsure = np.flatnonzero(~linked & (estimate + bound >= similarity))
    for begin in range(0, len(unsure), PAIRS):
        some = unsure[begin : begin + PAIRS]
        linked[some] = np.einsum("ij,ij->i", a.units[i[some]], b.units[j[some]]) >= similarity
    return i[linked], j[linked], len(unsure)


class _Forest:
    """Connected nodes under their smallest one; takes many links at once."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        while len(u):
            u, v = self.root[u], self.root[v]
            apart = u != v
            u, v = u[apart], v[apart]
            np.minimum.at(self.root, np.maximum(u, v), np.minimum(u, v))
            while True:
                up = self.root[self.root]
                if (up == self.root).all():
                    break
                self.root = up


def _block_pair(kind: str, similarity: float):
    def link(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        block = rows.column("block").to_numpy()
        width = rows.column("width")[0].as_py()
        held = quantised(rows.column("vector").combine_chunks().flatten().to_numpy().reshape(-1, width).astype(np.float64))
        copies = rows.column("copies").to_numpy()
        # Vectors of like steps share a tile, which keeps the threshold of whole tiles tight.
        sides = [np.flatnonzero(block == b) for b in np.unique(block)]
        sides = [s[np.argsort(held.step[s], kind="stable")] for s in sides]
        tiles = [[s[i : i + TILE] for i in range(0, len(s), TILE)] for s in sides]
        links, forest = np.zeros(len(block), np.int64), _Forest(len(block))
        same = len(sides) == 1 and rows.column("lo")[0].as_py() == rows.column("hi")[0].as_py()
        for nth, a in enumerate(tiles[0]):
            left = held[a]
            for b in tiles[0][nth:] if same else (tiles[1] if len(tiles) > 1 else ()):
                i, j, _ = tile_links(left, held[b], similarity)
                if a is b:
                    i, j = i[i < j], j[i < j]
                links[a] += np.bincount(i, copies[b[j]], len(a)).astype(np.int64)
                links[b] += np.bincount(j, copies[a[i]], len(b)).astype(np.int64)
                forest.link(a[i], b[j])
        some = pa.array(np.flatnonzero(links))
        table = pa.table(
            {
                "id": rows.column("id").take(some),
                "mark": rows.column("mark").take(some),
                "links": pa.array(links).take(some),
                "other": rows.column("id").take(pa.array(forest.root).take(some)),
            }
        )
        return table

    return link


def near_duplicate_segments(
    vectors: DataFrame,
    key: str = "segment_id",
    vector: str = "features",
    similarity: float = SIMILARITY,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Segments whose feature vectors point the same way: a cosine of at least ``similarity``.

    Method: equal vectors are one from the start. Distinct ones are dealt into
    blocks of at most about ``block_rows`` (fewer if they are long), and each pair
    of blocks is one task: products of int8 codes, tile by tile, with an error
    bound per vector, and full double precision only where the bound leaves a pair
    open. A task returns one row per vector that has a link in it, with its number
    of links and the vector it is connected with, so a group of any size gives no
    row per pair. Blocks are compared with all others: that is the exact join, and
    its arithmetic grows with the square of the distinct vectors; a vector travels
    once per block.

    Returns per input row: ``key``, n_links (other rows linked directly),
    component_id (smallest key reachable by links, its own included), kept (it is
    that one).

    Edge cases: a vector that is null, empty, zero or holds null or non-finite
    components has no links; vectors of different length have none with each
    other. A row without a key takes no part: no links, no component, kept. Equal
    vectors are linked with each other whatever rounding gives. Vectors whose rows have the
    same smallest key are one node. An empty table gives an empty result. Other
    columns are ignored.
    """
    if not 0 < similarity <= 1:
        raise ValueError("similarity is above 0 and at most 1")
    spark = vectors.sparkSession
    ship_package(spark)
    part = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    # Adding 0 turns -0.0 into 0.0, which are the same component.
    given = vectors.select(
        F.col(key).alias("id"),
        F.transform(F.col(vector).cast(f"array<{part}>"), lambda x: x + F.lit(0).cast(part)).alias("vector"),
    )
    rows = given.select("*", F.coalesce(F.col("id").isNotNull() & _usable("vector"), F.lit(False)).alias("usable"))
    usable = rows.where("usable").select("id", "vector", F.xxhash64("vector").alias("mark"))
    classes = durable(
        usable.groupBy("mark", "vector").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")),
        "distinct-vectors",
    )
    met = durable(_met(classes, similarity, block_rows), "block-links")
    links = met.groupBy("id", "mark").agg(F.sum("links").alias("links"))
    labels = components(met.select(F.col("id").alias("u"), F.col("other").alias("v")))
    found = (
        classes.join(links.withColumnRenamed("id", "first"), ["first", "mark"], "left")
        .join(labels.withColumnRenamed("node", "first"), "first", "left")
        .select(
            "mark",
            "vector",
            "first",
            "copies",
            (F.coalesce("links", F.lit(0).cast("long")) + F.col("copies") - 1).alias("n_links"),
            F.coalesce("label", "first").alias("component_id"),
        )
    )
    found = durable(found, "vector-classes")
    single = found.where("copies = 1").select(F.col("first").alias("id"), "n_links", "component_id")
    several = found.where("copies > 1")
    copied = salted_join(
        usable, several.drop("first", "copies"), ["mark", "vector"], hot=hot_counted(several, ["mark", "vector"], "copies")
    ).select("id", "n_links", "component_id")
    alone = rows.where("NOT usable").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = single.unionByName(copied).unionByName(alone)
    return every.select(
        F.col("id").alias(key),
        "n_links",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _usable(vector: str) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _met(classes: DataFrame, similarity: float, block_rows: int) -> DataFrame:
    """(id, mark, links, other) per pair of blocks and vector that has a link in it."""
    kind = classes.schema["first"].dataType.simpleString()
    whole = classes.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    most = max(1, min(block_rows, BLOCK_VALUES // max(1, whole["width"] or 1)))
    blocks = max(1, ceil(whole["n"] / most), min(LEAST_BLOCKS, whole["n"] // LEAST_ROWS))
    block = F.pmod(F.xxhash64(F.lit(3), "mark"), F.lit(blocks)).cast("int")
    dealt = classes.select(
        F.col("first").alias("id"),
        "mark",
        "copies",
        "vector",
        F.size("vector").alias("width"),
        block.alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("with"),
    ).select("*", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"))
    return (
        dealt.drop("with")
        .groupBy("width", "lo", "hi")
        .applyInArrow(_block_pair(kind, similarity), f"id {kind}, mark long, links long, other {kind}")
    )
