"""Network distance from every segment to its nearest facility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.operators.skew import hot_keys, salted_join
from kerbline.session import counted, durable, durable_with

# Hops that one job follows before what it found is compared with what is settled.
HOPS_PER_ROUND = 3
ROUNDS_PER_TABLE = 4


def _inner_nodes(edges: DataFrame, facilities: DataFrame) -> tuple[DataFrame, int]:
    """``node, lo, hi``: nodes with two neighbours that are no facility: the inside of chains."""
    ends = edges.groupBy(F.col("src").alias("node")).agg(
        F.count(F.lit(1)).alias("n"), F.min("dst").alias("lo"), F.max("dst").alias("hi")
    )
    two = ends.where("n = 2 AND lo < hi").select("node", "lo", "hi")
    held, seen = durable_with(two.join(facilities, "node", "left_anti"), "inner")
    return held, seen["n"]


def _arms(edges: DataFrame, inner: DataFrame) -> DataFrame:
    """``src, first, tip, length, inside``: each way into a chain, followed to the chain's end.

    ``inside`` says that ``src`` lies in a chain itself. Pointer jumping: a way that
    ends inside a chain is extended by the way that goes on from there, which is as
    long already, so the length followed doubles each round. Ways in rings without
    any end never finish; they are left out once nothing else is open.
    """
    heads = inner.select(F.col("node").alias("dst"), "lo", "hi")
    tails = inner.select(F.col("node").alias("src"), F.lit(True).alias("inside"))
    onward = F.when(F.col("lo") == F.col("src"), F.col("hi")).otherwise(F.col("lo"))
    ways = (
        edges.join(heads, "dst", "left")
        .join(tails, "src", "left")
        .where(F.col("lo").isNotNull() | F.col("inside"))
        .select(
            "src",
            F.col("dst").alias("first"),
            F.col("dst").alias("tip"),
            F.when(F.col("lo").isNotNull(), onward).alias("next"),
            F.col("weight_m").alias("length"),
            F.coalesce("inside", F.lit(False)).alias("inside"),
        )
    )
    open_ways = F.count("next")
    ways, seen = durable_with(ways, "ways_0", open=open_ways)
    rounds = 0
    while seen["open"]:
        rounds += 1
        last = seen["open"]
        beyond = ways.where("inside").select(
            F.col("src").alias("tip"),
            F.col("first").alias("next"),
            F.col("tip").alias("tip2"),
            F.col("next").alias("next2"),
            F.col("length").alias("length2"),
        )
        # A finished way has no ``next`` and meets nothing.
        further = ways.join(beyond, ["tip", "next"], "left").select(
            "src",
            "first",
            F.coalesce("tip2", "tip").alias("tip"),
            F.when(F.col("tip2").isNotNull(), F.col("next2")).otherwise(F.col("next")).alias("next"),
            (F.col("length") + F.coalesce("length2", F.lit(0.0))).alias("length"),
            "inside",
        )
        ways, seen = durable_with(further, f"ways_{rounds}", open=open_ways)
        if seen["open"] == last:
            break
    return ways.where(F.col("next").isNull()).select("src", "first", "tip", "length", "inside")


def _settled(tables: Sequence[DataFrame]) -> DataFrame:
    """The least distance of each node in tables that were written one after another."""
    every = tables[0]
    for table in tables[1:]:
        every = every.unionByName(table)
    return every.groupBy("node").agg(F.min("dist_m").alias("dist_m")) if len(tables) > 1 else every


def _relaxed(edges: DataFrame, start: DataFrame, hops: int, rounds_per_table: int, max_rounds: int) -> DataFrame:
    """``node, dist_m`` from ``start`` along ``edges``.

    The nodes improved by the last round are a table of their own. A round follows
    only their edges, ``hops`` steps far in one job, and then compares what it met
    with what is settled, so a wrong turn is followed for a few hops at most.
    """
    hot = hot_keys(edges, ["src"], base=edges)
    # Hot sources are spread by their salt in the join itself.
    placed = (edges if hot else edges.repartition("src")).persist()
    try:
        frontier = durable(start, "reach_0")
        settled, rounds = [frontier], 0
        while True:
            ahead, met = frontier, None
            for _ in range(hops):
                sent = salted_join(placed, ahead.withColumnRenamed("node", "src"), ["src"], hot=hot, salt_by=["dst"])
                ahead = sent.groupBy(F.col("dst").alias("node")).agg(F.min(F.col("dist_m") + F.col("weight_m")).alias("dist_m"))
                met = ahead if met is None else met.unionByName(ahead)
            offers = met.groupBy("node").agg(F.min("dist_m").alias("offer"))
            known = offers.join(_settled(settled), "node", "left")
            better = known.where(F.col("dist_m").isNull() | (F.col("offer") < F.col("dist_m")))
            rounds += 1
            frontier, seen = durable_with(better.select("node", F.col("offer").alias("dist_m")), f"reach_{rounds}")
            if not seen["n"]:
                return _settled(settled)
            if rounds >= max_rounds:
                raise RuntimeError(f"distances still improving after {rounds} rounds")
            settled.append(frontier)
            if len(settled) > rounds_per_table:
                settled = [durable(_settled(settled), f"settled_{rounds}")]
    finally:
        placed.unpersist()


def nearest_facility_distance(
    nodes: DataFrame,
    edges: DataFrame,
    facilities: DataFrame,
    hops_per_round: int = HOPS_PER_ROUND,
    rounds_per_table: int = ROUNDS_PER_TABLE,
    max_rounds: int = 100_000,
) -> DataFrame:
    """``node, dist_m``: network distance to the nearest facility, all facilities at once.

    ``nodes`` and ``facilities`` have ``node``; ``edges`` has ``src, dst, weight_m``
    with both directions of each link, once each. Facilities that are not nodes are
    ignored and unreachable nodes do not appear.

    Chains of nodes with two neighbours are contracted first: each becomes one edge
    between its ends, found in as many rounds as the logarithm of the longest chain.
    What is left, crossings and facilities, is relaxed from the facilities on, a few
    hops per job. A node inside a chain then takes the better of its two ends. The
    number of rounds follows the crossings on a way to a station, not its segments.
    Raises rather than return distances that have not settled.
    """
    lean = edges.select("src", "dst", "weight_m")
    start = durable(facilities.join(nodes, "node", "left_semi").select("node").distinct(), "facility-nodes")
    inner, found = _inner_nodes(lean, start)
    zero = start.select("node", F.lit(0.0).alias("dist_m"))
    if not found:
        return _relaxed(lean, zero, hops_per_round, rounds_per_table, max_rounds)
    arms = _arms(lean, inner)
    ends = inner.select(F.col("node").alias("src"))
    direct = lean.join(ends, "src", "left_anti").join(ends.withColumnRenamed("src", "dst"), "dst", "left_anti")
    through = arms.where("NOT inside AND src != tip").select("src", F.col("tip").alias("dst"), F.col("length").alias("weight_m"))
    short = direct.select("src", "dst", "weight_m").unionByName(through)
    short = counted(short.groupBy("src", "dst").agg(F.min("weight_m").alias("weight_m")), "short-edges")
    reached = _relaxed(short, zero, hops_per_round, rounds_per_table, max_rounds)
    inside = arms.where("inside").select("src", F.col("tip").alias("node"), "length")
    unfolded = (
        salted_join(inside, reached, ["node"], hot=hot_keys(inside, ["node"], base=arms))
        .groupBy(F.col("src").alias("node"))
        .agg(F.min(F.col("dist_m") + F.col("length")).alias("dist_m"))
    )
    return reached.unionByName(unfolded)
