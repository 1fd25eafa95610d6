import heapq
import random

import pytest
from pyspark.sql import functions as F

from kerbline import session
from kerbline.operators import graph, routing, skew


def seg(spark, rows):
    return spark.createDataFrame(
        rows, "segment_id string, start_lat double, start_lon double, end_lat double, end_lon double"
    )


def pairs(df):
    return {(r.src, r.dst) for r in df.collect()}


def edge_df(spark, undirected):
    both = [(a, b, float(w)) for a, b, w in undirected] + [(b, a, float(w)) for a, b, w in undirected]
    return spark.createDataFrame(both, "src string, dst string, weight_m double")


def node_df(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_exact_topology(spark):
    rows = [("p", 10, 20), ("q", 20, 30), ("r", 30, 10), ("s", 40, None), ("t", None, None), ("u", 40, 50)]
    df = spark.createDataFrame(rows, "segment_id string, from_id long, to_id long")
    ring = {("p", "q"), ("q", "r"), ("p", "r"), ("s", "u")}
    assert pairs(graph.adjacency_exact(df)) == ring | {(b, a) for a, b in ring}


def test_proximity(spark):
    # One thousandth of a degree of latitude is about 111 m.
    df = seg(
        spark,
        [
            ("p", 50.0, 7.0, 50.010, 7.0),
            ("q", 50.0101, 7.0, 50.020, 7.0),
            ("r", 50.0203, 7.0, 50.030, 7.0),
            ("s", -50.0, 7.0, None, None),
        ],
    )
    assert pairs(graph.adjacency_proximity(df, 12.0)) == {("p", "q"), ("q", "p")}
    assert ("q", "r") in pairs(graph.adjacency_proximity(df, 40.0))


@pytest.mark.parametrize("min_rows", [100_000, 3])
def test_shorter_way_round_wins(spark, monkeypatch, min_rows):
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", min_rows)
    # A direct long edge, a way round in three short ones, a spur and a part that no station reaches.
    edges = edge_df(spark, [("a", "z", 90), ("a", "b", 7), ("b", "c", 11), ("c", "z", 13), ("z", "y", 5), ("m", "n", 1)])
    dist = routing.nearest_facility_distance(node_df(spark, "abcyzmn"), edges, node_df(spark, "aq"))
    assert {r.node: r.dist_m for r in dist.collect()} == {"a": 0, "b": 7, "c": 18, "z": 31, "y": 36}


def test_distances_on_random_graph(spark):
    rng = random.Random(4)
    names = [f"n{i}" for i in range(60)]
    und = list({tuple(sorted(rng.sample(names, 2))) for _ in range(90)})
    und = [(a, b, rng.uniform(1, 100)) for a, b in und]
    nbr = {n: [] for n in names}
    for a, b, w in und:
        nbr[a].append((b, w))
        nbr[b].append((a, w))
    sources = names[:3]
    best, heap = {}, [(0.0, s) for s in sources]
    while heap:
        d, u = heapq.heappop(heap)
        if u in best:
            continue
        best[u] = d
        for v, w in nbr[u]:
            heapq.heappush(heap, (d + w, v))
    got = routing.nearest_facility_distance(node_df(spark, names), edge_df(spark, und), node_df(spark, sources), 2)
    assert {r.node: pytest.approx(r.dist_m) for r in got.collect()} == best


def ladder(n):
    """Two parallel roads with a rung at every step: no node has two neighbours only, but the last."""
    und = [(f"{side}{i:02d}", f"{side}{i + 1:02d}", 1) for i in range(n) for side in "ab"]
    return und + [(f"a{i:02d}", f"b{i:02d}", 5) for i in range(n + 1)] + [(f"a{n:02d}", "z", 1), ("z", "y", 1)]


def test_loop_raises_instead_of_returning_unsettled_distances(spark):
    und = ladder(12)
    names = {n for a, b, _ in und for n in (a, b)}
    with pytest.raises(RuntimeError):
        routing.nearest_facility_distance(node_df(spark, names), edge_df(spark, und), node_df(spark, ["a06"]), 1, 2, max_rounds=4)
    got = routing.nearest_facility_distance(node_df(spark, names), edge_df(spark, und), node_df(spark, ["a06"]))
    dist = {r.node: r.dist_m for r in got.collect()}
    assert dist["a00"] == 6 and dist["b00"] == 11 and dist["z"] == 7 and dist["y"] == 8 and len(dist) == len(names)


def by_heap(und, sources):
    nbr = {}
    for a, b, w in und:
        nbr.setdefault(a, []).append((b, w))
        nbr.setdefault(b, []).append((a, w))
    best, heap = {}, [(0.0, s) for s in sources]
    while heap:
        d, u = heapq.heappop(heap)
        if u not in best:
            best[u] = d
            for v, w in nbr.get(u, ()):
                heapq.heappush(heap, (d + w, v))
    return best


def test_long_chain_settles_in_few_rounds(spark, monkeypatch):
    rng = random.Random(6)
    und = [(f"c{i}", f"c{i + 1}", rng.randint(1, 9)) for i in range(10_000)]
    # Rings without a crossing, one of them with a station, and a chain that returns to where it began.
    for r in "uv":
        und += [(f"{r}{i}", f"{r}{(i + 1) % 50}", 1) for i in range(50)]
    und += [("c7", "w0", 2)] + [(f"w{i}", f"w{i + 1}", 2) for i in range(30)] + [("w30", "c7", 2), ("c7", "lone", 4)]
    names = {n for a, b, _ in und for n in (a, b)}
    sources = ["c0", "c6000", "v3"]
    written = []
    keep = session.durable
    monkeypatch.setattr(session, "durable", lambda df, name: written.append(name) or keep(df, name))
    got = routing.nearest_facility_distance(node_df(spark, names), edge_df(spark, und), node_df(spark, sources))
    dist = {r.node: r.dist_m for r in got.collect()}
    assert dist == by_heap(und, sources) and len(dist) == len(names) - 50
    assert len([n for n in written if n.startswith(("ways", "reach"))]) < 40


@pytest.mark.parametrize("seed", range(4))
def test_contraction_on_sparse_random_graphs(spark, seed):
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(80)]
    und = {tuple(sorted(rng.sample(names, 2))) for _ in range(85)}
    und = [(a, b, rng.uniform(1, 100)) for a, b in sorted(und)]
    sources = names[:2]
    got = routing.nearest_facility_distance(node_df(spark, names), edge_df(spark, und), node_df(spark, sources))
    assert {r.node: pytest.approx(r.dist_m) for r in got.collect()} == by_heap(und, sources)


def dense_power(names, und, x, self_weight, order):
    idx = {n: i for i, n in enumerate(names)}
    n = len(names)
    a = [[0.0] * n for _ in range(n)]
    for s, d, _ in und:
        a[idx[s]][idx[d]] = a[idx[d]][idx[s]] = 1.0
    for i in range(n):
        a[i][i] = self_weight
        total = sum(a[i])
        a[i] = [v / total for v in a[i]]
    for _ in range(order):
        x = [sum(a[i][j] * x[j] for j in range(n)) for i in range(n)]
    return dict(zip(names, x))


@pytest.mark.parametrize("min_rows", [100_000, 4])
def test_diffusion_equals_dense_product(spark, monkeypatch, min_rows):
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", min_rows)
    names = list("ABCDEFG")
    und = [("A", b, 1) for b in "BCDEF"] + [("B", "C", 1)]
    x = [1.0, -2.0, 3.0, 0.5, 4.0, 9.0, 2.0]
    values = spark.createDataFrame(list(zip(names, x)), "node string, v double")
    edges = edge_df(spark, und)
    for order, hop in enumerate(graph.diffuse(values, edges, ["v"], 2), start=1):
        got = {r.node: pytest.approx(r.v) for r in hop.collect()}
        assert got == dense_power(names, und, x, 2.0, order)
    wide = graph.diffusion_features(values, edges, ["v"], 2).collect()
    assert {r.node: pytest.approx(r.v_h2) for r in wide} == dense_power(names, und, x, 2.0, 2)


def hub_segments():
    rng = random.Random(8)
    rows = [(f"h{i}", "HUB", f"j{rng.randrange(6)}") for i in range(40)]
    rows += [(f"s{i}", f"j{rng.randrange(6)}", f"j{rng.randrange(6)}") for i in range(30)]
    return rows + [("n0", None, "j1"), ("n1", None, None)]


def test_place_diffusion_equals_edge_diffusion_at_a_hub(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 10)
    segs = spark.createDataFrame(hub_segments(), "segment_id string, from_id string, to_id string")
    values = segs.selectExpr("segment_id as node", "cast(pmod(hash(segment_id), 17) as double) as v")
    places = graph.places_exact(segs)
    edges = graph.edges_of(places)
    for want, got in zip(graph.diffuse(values, edges, ["v"], 2), graph.diffuse_at_places(values, places, ["v"], 2), strict=True):
        got = got.collect()
        assert {r.node: pytest.approx(r.v) for r in got} == {r.node: r.v for r in want.collect()}
    nodes = values.select("node")
    back = {r.node: pytest.approx((r.back_1, r.back_2)) for r in graph.return_weight(nodes, edges).collect()}
    assert {r.node: (r.back_1, r.back_2) for r in graph.return_weight(nodes, places).collect()} == back
    assert len(got) == 72


def test_place_diffusion_for_proximity(spark):
    rng = random.Random(9)
    rows = []
    for i in range(60):
        lat, lon = 35 + 0.001 * rng.randrange(5), -80 + 0.001 * rng.randrange(5)
        j = lambda: rng.choice([0.0, 0.0001, 0.0002])
        rows.append((f"s{i}", lat + j(), lon, lat + 0.001 + j(), lon + j()))
    segs = seg(spark, rows)
    values = segs.selectExpr("segment_id as node", "start_lat * 1000 - 35000 as v")
    places = graph.places_proximity(segs, 25.0)
    edges = graph.edges_of(places)
    for want, got in zip(graph.diffuse(values, edges, ["v"], 2), graph.diffuse_at_places(values, places, ["v"], 2), strict=True):
        got = got.collect()
        assert {r.node: pytest.approx(r.v) for r in got} == {r.node: r.v for r in want.collect()}
    nodes = values.select("node")
    back = {r.node: pytest.approx((r.back_1, r.back_2)) for r in graph.return_weight(nodes, edges).collect()}
    assert {r.node: (r.back_1, r.back_2) for r in graph.return_weight(nodes, places).collect()} == back


def test_a_very_large_intersection_makes_no_pairs(spark, monkeypatch):
    # All 100,000 segments meet at one place; their pairs would be 10^10 rows.
    monkeypatch.setattr(skew, "HOT_MIN_ROWS", 20_000)
    n = 100_000
    segs = spark.range(n).selectExpr("cast(id as string) as segment_id", "'HUB' as from_id", "concat('j', id) as to_id")
    values = segs.selectExpr("segment_id as node", "cast(pmod(cast(segment_id as long), 10) as double) as v")
    places = graph.places_exact(segs)
    one, two = graph.diffuse_at_places(values, places, ["v"], 2)
    total = 4.5 * n
    first = {v: (total + v) / (n + 1) for v in range(10)}
    rows = one.join(values.withColumnRenamed("v", "x"), "node").groupBy("x").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    assert {r.x: (r.lo, r.hi) for r in rows} == {v: (pytest.approx(y), pytest.approx(y)) for v, y in first.items()}
    total = sum(first.values()) * n / 10
    rows = two.join(values.withColumnRenamed("v", "x"), "node").groupBy("x").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).collect()
    assert {r.x: (r.lo, r.hi) for r in rows} == {v: (pytest.approx((total + y) / (n + 1)),) * 2 for v, y in first.items()}
    back = graph.return_weight(values.select("node"), places).select("back_1", "back_2").distinct().collect()
    assert len({(round(r.back_1, 12), round(r.back_2, 15)) for r in back}) == 1
    assert back[0].back_2 == pytest.approx((2 / (n + 1)) ** 2 + (n - 1) / (n + 1) ** 2)


def test_khop_row_norm_and_induced(spark):
    edges = edge_df(spark, [("A", "B", 1), ("B", "C", 1), ("C", "D", 1), ("A", "X", 1), ("X", "B", 1)])
    target = spark.createDataFrame([("A",)], "target string")
    got = {(r.node, r.hop) for r in graph.khop_neighbors(target, edges, 2).collect()}
    assert got == {("B", 1), ("X", 1), ("C", 2)}
    norm = graph.row_norm_adjacency(node_df(spark, "ABCDXZ"), edges).collect()
    rows = {}
    for r in norm:
        rows.setdefault(r.src, {})[r.dst] = r.weight
    assert rows["Z"] == {"Z": 1.0}
    assert rows["A"] == {"A": 0.5, "B": 0.25, "X": 0.25}
    assert all(sum(v.values()) == pytest.approx(1.0) for v in rows.values())
    kept = pairs(graph.induced_subgraph(edges, node_df(spark, "ABX")))
    assert kept == {("A", "B"), ("B", "A"), ("A", "X"), ("X", "A"), ("X", "B"), ("B", "X")}


def test_return_weights_are_the_diagonals(spark):
    names = list("ABCD")
    und = [("A", "B", 1), ("B", "C", 1)]
    got = {r.node: r for r in graph.return_weight(node_df(spark, names), edge_df(spark, und)).collect()}
    for i, n in enumerate(names):
        unit = [float(j == i) for j in range(4)]
        assert got[n].back_1 == pytest.approx(dense_power(names, und, unit, 2.0, 1)[n])
        assert got[n].back_2 == pytest.approx(dense_power(names, und, unit, 2.0, 2)[n])


def test_partial_return_weights_equal_the_whole(spark):
    und = [("A", "B", 1), ("B", "C", 1), ("C", "D", 1), ("A", "D", 1), ("D", "E", 1)]
    edges = edge_df(spark, und)
    whole = {r.node: tuple(r) for r in graph.return_weight(node_df(spark, "ABCDEF"), edges).collect()}
    part = {r.node: tuple(r) for r in graph.return_weight(node_df(spark, "AF"), edges, partial=True).collect()}
    assert part == {n: whole[n] for n in "AF"}


def test_assembled_graph_invariants(spark, sf_dir):
    from kerbline.sources.demo import Stages

    st = Stages.of(spark, sf_dir)
    edges = {(r.src, r.dst): r.weight_m for r in st.edges.collect()}
    assert edges and all(a != b and (b, a) in edges for a, b in edges)
    dist = {r.segment_id: r.ems_distance_m for r in st.features.collect() if r.ems_distance_m is not None}
    for (a, b), w in edges.items():
        if a in dist:
            assert dist[b] <= dist[a] + w + 1e-6


def test_places_meet_on_plain_columns_and_missing_coordinates_meet_nothing(spark):
    rows = [("a", 35.0, -80.0, None, None), ("b", 35.0, -80.0, None, None), ("c", 36.0, -80.0, None, -80.0)]
    segs = spark.createDataFrame(rows, "segment_id string, start_lat double, start_lon double, end_lat double, end_lon double")
    linked = graph.adjacency_proximity(segs, 50.0)
    assert {tuple(r) for r in linked.collect()} == {("a", "b"), ("b", "a")}
    alone = segs.withColumns({"start_lat": F.lit(None).cast("double"), "start_lon": F.lit(None).cast("double")})
    assert graph.adjacency_proximity(alone, 50.0).isEmpty()
