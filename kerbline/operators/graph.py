"""Segment graph: adjacency, weights, network distance, diffusion, neighbourhoods.

A graph is an edge list ``src, dst`` that holds both directions and no self rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.functions import geo
from kerbline.operators.skew import hot_keys, salted_join
from kerbline.operators.spatial import point_pairs_within
from kerbline.session import counted, durable

# The adjacency carries a self loop and the model adds the identity once more.
SELF_WEIGHT = 2.0


class Places(NamedTuple):
    """A graph without its edges: segments are adjacent iff one reaches a place where
    the other ends.

    ``at`` and ``reach`` have ``node, place``. The tables grow with the number of
    segments however many of them meet at one place, while the edge list grows
    with the square of that number.
    """

    at: DataFrame
    reach: DataFrame


def _meet(left: DataFrame, right: DataFrame, hot: Mapping[int, int]) -> DataFrame:
    """Rows of both sides at the same ``place``, without it.

    A place that is a struct is compared field by field: only plain columns sort fast.
    A place with a missing field meets nothing. The hash of a struct is that of its fields.
    """
    kind = left.schema["place"].dataType
    if not isinstance(kind, T.StructType):
        return salted_join(left, right, ["place"], hot=hot).drop("place")
    keys = {f"_{f}": F.col("place")[f] for f in kind.names}
    flat_left, flat_right = left.withColumns(keys).drop("place"), right.withColumns(keys).drop("place")
    return salted_join(flat_left, flat_right, list(keys), hot=hot).drop(*keys)


def places_exact(segments: DataFrame) -> Places:
    """Places are intersection ids; ``segments`` has ``segment_id, from_id, to_id``."""
    ends = (
        segments.select(F.col("segment_id").alias("node"), F.explode(F.array("from_id", "to_id")).alias("place"))
        .where(F.col("place").isNotNull())
        .distinct()
    )
    return Places(ends, ends)


def places_proximity(segments: DataFrame, tol_m: float = 15.0) -> Places:
    """Places are distinct endpoint coordinates; a segment reaches those within ``tol_m``
    of its own ends.

    Distances are checked between coordinates, not between segments.
    """
    ends = segments.select(
        F.col("segment_id").alias("node"),
        F.inline(
            F.array(
                F.struct(F.col("start_lat").alias("lat"), F.col("start_lon").alias("lon")),
                F.struct(F.col("end_lat").alias("lat"), F.col("end_lon").alias("lon")),
            )
        ),
    ).distinct()
    spot = F.struct("lat", "lon")
    at = counted(ends.select("node", spot.alias("place")), "ends")
    close = point_pairs_within(counted(ends.select("lat", "lon").distinct(), "spots"), tol_m).select(
        F.struct(F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon")).alias("place"),
        F.struct(F.col("b_lat").alias("lat"), F.col("b_lon").alias("lon")).alias("near"),
    )
    reach = (
        _meet(at, close, hot_keys(at, ["place"], base=at))
        .select("node", F.col("near").alias("place"))
        .distinct()
    )
    return Places(at, counted(reach, "reach"))


def edges_of(places: Places) -> DataFrame:
    """The edge list ``src, dst``: both directions, each pair once, no self rows."""
    left = places.reach.withColumnRenamed("node", "src")
    right = places.at.withColumnRenamed("node", "dst")
    return (
        _meet(left, right, hot_keys(left, ["place"], base=left))
        .where(F.col("src") != F.col("dst"))
        .select("src", "dst")
        .distinct()
    )


def adjacency_exact(segments: DataFrame) -> DataFrame:
    """Edges between segments that share an intersection id; missing ids connect nothing."""
    return edges_of(places_exact(segments))


def adjacency_proximity(segments: DataFrame, tol_m: float = 15.0) -> DataFrame:
    """Edges between segments that have endpoints at most ``tol_m`` apart."""
    return edges_of(places_proximity(segments, tol_m))


def edge_weights(edges: DataFrame, segments: DataFrame) -> DataFrame:
    """``weight_m``: distance between the midpoints of adjacent segments."""
    mids = segments.select("segment_id", "mid_lat", "mid_lon")
    hot = hot_keys(edges, ["src"], base=edges)
    with_src = salted_join(
        edges,
        mids.select(F.col("segment_id").alias("src"), F.col("mid_lat").alias("lat1"), F.col("mid_lon").alias("lon1")),
        ["src"],
        hot=hot,
    )
    with_both = salted_join(
        with_src,
        mids.select(F.col("segment_id").alias("dst"), F.col("mid_lat").alias("lat2"), F.col("mid_lon").alias("lon2")),
        ["dst"],
        hot=hot,
    )
    return with_both.select(
        "src",
        "dst",
        geo.haversine_m(F.col("lat1"), F.col("lon1"), F.col("lat2"), F.col("lon2")).alias("weight_m"),
    )


def with_self(nodes: DataFrame, edges: DataFrame, self_weight: float) -> DataFrame:
    """``src, dst, raw``: the edges with weight 1 and one self row per node.

    With the self rows in the table, one join carries both what a node keeps and
    what it sends, so a hop reads the previous one once.
    """
    own = nodes.select(
        F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(float(self_weight)).alias("raw")
    )
    return edges.select("src", "dst", F.lit(1.0).alias("raw")).unionByName(own)


def row_norm_adjacency(nodes: DataFrame, edges: DataFrame, self_weight: float = SELF_WEIGHT) -> DataFrame:
    """``src, dst, weight``: rows of the adjacency with self loop, each summing to one."""
    total = degree(nodes, edges).select(
        F.col("node").alias("src"), (F.col("degree") + self_weight).alias("total")
    )
    looped = with_self(nodes, edges, self_weight)
    return salted_join(looped, total, ["src"], hot=hot_keys(edges, ["src"], base=edges), salt_by=["dst"]).select(
        "src", "dst", (F.col("raw") / F.col("total")).alias("weight")
    )


def degree(nodes: DataFrame, edges: DataFrame, partial: bool = False) -> DataFrame:
    """``node, degree`` for every row of ``nodes``, isolated ones with 0.

    With ``partial``, ``nodes`` is a small part of the graph: other nodes' edges are
    filtered out before anything is shuffled.
    """
    if partial:
        edges = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi")
    ones = edges.select(F.col("src").alias("node"), F.lit(1).alias("d"))
    zeros = nodes.select("node", F.lit(0).alias("d"))
    return ones.unionByName(zeros).groupBy("node").agg(F.sum("d").alias("degree"))


def diffuse(
    values: DataFrame,
    edges: DataFrame,
    cols: Sequence[str],
    order: int = 2,
    self_weight: float = SELF_WEIGHT,
) -> list[DataFrame]:
    """``[A x, A^2 x, ...]`` for the row-normalised adjacency ``A``.

    ``values`` has ``node`` and ``cols``. A hop is one join and one aggregation
    for all columns; the row sum comes out of the same aggregation.
    """
    hot = hot_keys(edges, ["src"], base=edges)
    looped = with_self(values, edges, self_weight)
    current = values.select("node", *cols)
    sums = [(F.sum(F.col("raw") * F.col(c)) / F.sum("raw")).alias(c) for c in cols]
    out = []
    for k in range(1, order + 1):
        sent = salted_join(looped, current.withColumnRenamed("node", "src"), ["src"], hot=hot, salt_by=["dst"])
        current = sent.groupBy(F.col("dst").alias("node")).agg(*sums)
        if k < order:
            current = durable(current, f"hop_{k}")
        out.append(current)
    return out


class PlaceSums(NamedTuple):
    """The adjacency in factors: which places nodes reach, end at, and would be counted twice at."""

    at: DataFrame
    reach: DataFrame
    ends: DataFrame
    twice: DataFrame


def place_sums(nodes: DataFrame, places: Places) -> PlaceSums:
    """Tables for ``neighbour_sums`` over the subgraph of ``nodes``; they grow with the nodes, not with pairs."""
    at = counted(places.at.join(nodes.select("node"), "node", "left_semi"), "at")
    reach = counted(places.reach.join(nodes.select("node"), "node", "left_semi"), "in-reach")
    ends = counted(at.groupBy("node").agg(F.min("place").alias("p"), F.max("place").alias("q")), "ends")
    spans = ends.where(F.col("p") < F.col("q")).select("p", "q").distinct()
    # Pairs among the few places one node reaches, as far as some node has its ends there.
    p, q = reach.select("node", F.col("place").alias("p")), reach.select("node", F.col("place").alias("q"))
    pairs = p.join(q, "node").where(F.col("p") < F.col("q"))
    twice = salted_join(pairs, spans, ["p", "q"], "left_semi", hot_keys(pairs, ["p", "q"], base=reach))
    return PlaceSums(at, reach, ends, counted(twice, "twice"))


def neighbour_sums(values: DataFrame, sums: PlaceSums, cols: Sequence[str]) -> DataFrame:
    """``node`` and per column the sum over its neighbours, without a list of them.

    The sum over the places a node reaches, less what was counted at two of them
    (nodes with both ends there), less its own value. Nodes without a place are left out.
    """
    x = values.select("node", *cols)
    per_place = sums.at.join(x, "node").groupBy("place").agg(*[F.sum(c).alias(c) for c in cols])
    own = sums.ends.join(x, "node").select("node", "p", "q", *[(-F.col(c)).alias(c) for c in cols])
    both = own.where(F.col("p") < F.col("q")).groupBy("p", "q").agg(*[F.sum(c).alias(c) for c in cols])
    once = salted_join(sums.reach, per_place, ["place"], hot=hot_keys(sums.reach, ["place"], base=sums.reach))
    again = salted_join(sums.twice, both, ["p", "q"], hot=hot_keys(sums.twice, ["p", "q"], base=sums.twice))
    parts = [t.select("node", *cols) for t in (once, again, own)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("node").agg(*[F.sum(c).alias(c) for c in cols])


def diffuse_at_places(
    values: DataFrame, places: Places, cols: Sequence[str], order: int = 1, self_weight: float = SELF_WEIGHT
) -> list[DataFrame]:
    """``[A x, A^2 x, ...]`` without the edge list, for graphs with very large intersections."""
    sums = place_sums(values, places)
    current, out = values.select("node", *cols), []
    for k in range(1, order + 1):
        x = current.withColumn("_one", F.lit(1.0))
        totals = [*cols, "_one"]
        own = x.select("node", *[(F.col(c) * F.lit(float(self_weight))).alias(c) for c in totals])
        every = neighbour_sums(x, sums, totals).unionByName(own)
        summed = every.groupBy("node").agg(*[F.sum(c).alias(c) for c in totals])
        current = summed.select("node", *[(F.col(c) / F.col("_one")).alias(c) for c in cols])
        if k < order:
            current = durable(current, f"hop_{k}")
        out.append(current)
    return out


def return_weight_at_places(nodes: DataFrame, places: Places, self_weight: float = SELF_WEIGHT) -> DataFrame:
    """``node, back_1, back_2`` as ``return_weight`` gives them, without the edge list.

    The diagonal of ``A^2`` needs the sum of 1 / total over a node's neighbours, which is
    one more sum over places.
    """
    sums = place_sums(nodes, places)
    ones = nodes.select("node", F.lit(1.0).alias("n"))
    degrees = nodes.select("node").join(neighbour_sums(ones, sums, ["n"]), "node", "left")
    total = F.coalesce("n", F.lit(0.0)) + F.lit(float(self_weight))
    totals = durable(degrees.select("node", total.alias("total"), (1 / total).alias("inv")), "totals")
    around = neighbour_sums(totals, sums, ["inv"]).withColumnRenamed("inv", "around")
    one = self_weight / F.col("total")
    back_2 = one * one + F.coalesce("around", F.lit(0.0)) / F.col("total")
    return totals.join(around, "node", "left").select("node", one.alias("back_1"), back_2.alias("back_2"))


def diffusion_features(
    values: DataFrame,
    edges: DataFrame | Places,
    cols: Sequence[str],
    order: int = 2,
    self_weight: float = SELF_WEIGHT,
) -> DataFrame:
    """``x`` next to ``A x .. A^order x``; columns of hop k are named ``<col>_h<k>``.

    The graph is an edge list or, for very large intersections, its places.
    """
    along = diffuse_at_places if isinstance(edges, Places) else diffuse
    wide = values.select("node", *cols)
    for k, hop in enumerate(along(values, edges, cols, order, self_weight), start=1):
        wide = wide.join(hop.withColumnsRenamed({c: f"{c}_h{k}" for c in cols}), "node")
    return wide


def khop_neighbors(targets: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """``target, node, hop``: nodes first met at exactly ``hop`` steps from each target.

    ``targets`` has ``target``. The target itself is left out.
    """
    hot = hot_keys(edges, ["src"], base=edges)
    start = targets.select("target").distinct()
    seen = start.select("target", F.col("target").alias("node"), F.lit(0).alias("hop"))
    frontier = start.select("target", F.col("target").alias("src"))
    for hop in range(1, hops + 1):
        reached = (
            salted_join(edges.select("src", "dst"), frontier, ["src"], hot=hot, salt_by=["dst"])
            .select("target", F.col("dst").alias("node"))
            .distinct()
            .join(seen, ["target", "node"], "left_anti")
        )
        if hop < hops:
            reached = durable(reached, f"within_{hop}")
        seen = seen.unionByName(reached.withColumn("hop", F.lit(hop)))
        frontier = reached.select("target", F.col("node").alias("src"))
    return seen.where("hop > 0")


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends in ``nodes``."""
    hot = hot_keys(edges, ["src"], base=edges)
    kept = salted_join(edges, nodes.select(F.col("node").alias("src")), ["src"], "left_semi", hot)
    return salted_join(kept, nodes.select(F.col("node").alias("dst")), ["dst"], "left_semi", hot)


def return_weight(
    nodes: DataFrame, edges: DataFrame | Places, self_weight: float = SELF_WEIGHT, partial: bool = False
) -> DataFrame:
    """``node, back_1, back_2``: diagonals of ``A`` and ``A^2`` for ``nodes``.

    What share of its own value a segment gets back after one and two hops. With
    ``partial``, ``nodes`` is a small part of the graph and only the edges next to
    it are followed. With places instead of edges, ``nodes`` are all of the graph's.
    """
    if isinstance(edges, Places):
        if partial:
            raise ValueError("a part of the graph is followed along its edges")
        return return_weight_at_places(nodes, edges, self_weight)
    counted = nodes.select("node")
    if partial:
        edges_in = durable(edges.join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi"), "edges_in")
        counted = durable(
            counted.unionByName(edges_in.select(F.col("src").alias("node"))).distinct(), "around"
        )
    else:
        edges_in = edges
    totals = degree(counted, edges, partial).select("node", (F.col("degree") + self_weight).alias("total"))
    other = totals.select(F.col("node").alias("src"), (1 / F.col("total")).alias("inv"))
    hot = hot_keys(edges_in, ["src"], base=edges_in)
    around = (
        salted_join(edges_in, other, ["src"], hot=hot, salt_by=["dst"])
        .groupBy(F.col("dst").alias("node"))
        .agg(F.sum("inv").alias("around"))
    )
    one = self_weight / F.col("total")
    return nodes.select("node").join(totals, "node").join(around, "node", "left").select(
        "node",
        one.alias("back_1"),
        (one * one + F.coalesce("around", F.lit(0.0)) / F.col("total")).alias("back_2"),
    )
