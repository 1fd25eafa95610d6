"""Connected components by alternating stars, all on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.session import durable

# A round at least halves the height of what is left, so this is far above need.
MAX_ROUNDS = 60


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node on an edge (u, v): the smallest node it is connected with.

    Large stars hang a node's larger neighbours on its smallest one, small stars
    hang the smaller ones and the node itself there; both only need the minimum
    of a node's neighbours, taken before the shuffle. Ends when nothing changes.
    """
    held = durable(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "links"
    )
    last = _mark(held)
    if not last[0]:
        return held.select(F.col("u").alias("node"), F.col("v").alias("label"))
    for _ in range(MAX_ROUNDS):
        both = held.union(held.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = durable(large.where("u != v").distinct(), "large-stars")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        held = durable(small.where("u != v").distinct(), "small-stars")
        now = _mark(held)
        if now == last:
            break
        last = now
    else:
        raise RuntimeError("components did not settle")
    node_labels = held.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return node_labels.union(held.select("v", "v").distinct())
