"""Near-duplicate feature vectors against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kerbline.llm.vectordup import near_duplicate_segments, quantised, tile_links
from kerbline.plans.catalog import QUERIES

NAN, INF = float("nan"), float("inf")


def brute_force(rows, similarity):
    usable = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    unit = [v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for _, v in usable]
    label = list(range(len(usable)))
    n = [0] * len(usable)
    for a in range(len(usable)):
        for b in range(len(usable)):
            if a != b and len(unit[a]) == len(unit[b]) and (list(usable[a][1]) == list(usable[b][1]) or unit[a] @ unit[b] >= similarity):
                n[a] += 1
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    first = {}
    for (i, _), x in zip(usable, label, strict=True):
        first[x] = min(first.get(x, i), i)
    out = [(i, m, first[x], i == first[x]) for (i, _), x, m in zip(usable, label, n, strict=True)]
    return out + [(i, 0, i, True) for i, v in rows if not (i is not None and v and None not in v and np.isfinite(v).all() and any(v))]


def sample(seed, width=12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(15, width))
    rows = [(500 + i, (c + rng.normal(size=width) * s).tolist()) for i, (c, s) in enumerate(zip(centres[rng.integers(0, 15, 260)], rng.random(260), strict=True))]
    rows += [(100 + i, rows[3][1]) for i in range(130)] + [(300 + i, (np.array(rows[4][1]) * (i + 1)).tolist()) for i in range(40)]
    rows += [(1, None), (2, []), (3, [0.0] * width), (4, [NAN] + [1.0] * (width - 1)), (5, [INF] + [1.0] * (width - 1)), (6, [None, 1.0]), (7, [1.0, 2.0]), (8, [2.0, 4.0])]
    rows += [(9, [0.0, 1e-300]), (10, [-0.0, 1e300]), (11, [0.0, 1e300]), (None, [1.0, 2.0]), (12, [-1.0, -2.0])]
    return rows


@pytest.mark.parametrize("block_rows", [16_384, 40])
@pytest.mark.parametrize("similarity", [0.9, 0.3])
def test_links_of_segments(spark, block_rows, similarity):
    rows = sample(5)
    clash = "id int, first int, mark long, links long, block int, vector string"
    given = spark.createDataFrame([(*r, 1, 2, 3, 4, 5, "v") for r in rows], f"segment_id long, features array<double>, {clash}")
    got = [tuple(r) for r in near_duplicate_segments(given, similarity=similarity, block_rows=block_rows).collect()]
    order = lambda r: (r[0] is None, r)
    assert sorted(got, key=order) == sorted(brute_force(rows, similarity), key=order)
    assert near_duplicate_segments(given.limit(0)).count() == 0


def test_bounds_hold_and_most_pairs_are_not_recomputed():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(300, 64)), rng.normal(size=(300, 64))
    b[:150] = a[:150] + rng.normal(size=(150, 64)) * np.linspace(0, 1, 150)[:, None]
    b[150:160] = 0
    b[150:160, 0], a[150:160, 0] = 1, 40
    x, y = quantised(a), quantised(b)
    assert (np.abs(x.units - x.codes * x.step[:, None]) <= x.step[:, None] / 2 + 1e-12).all()
    for similarity in (0.95, 0.9, 0.5):
        i, j, full = tile_links(x, y, similarity)
        want = np.argwhere(x.units @ y.units.T >= similarity)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == [tuple(p) for p in want.tolist()]
        assert full < 0.01 * 300 * 300


def test_wide_vectors_are_multiplied_exactly():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(20, 3000))
    i, j, _ = tile_links(quantised(a), quantised(a * 7), 0.99)
    assert i.tolist() == j.tolist() == list(range(20))


def test_vectors_of_assembled_segments(spark, sf_dir):
    features = QUERIES["feature_table"](spark, sf_dir)
    columns = ["speed_limit_mph", "lane_count", "aadt_normalized"]
    vectors = features.select("segment_id", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in columns]).alias("features"))
    rows = [tuple(r) for r in vectors.collect()]
    got = sorted(tuple(r) for r in near_duplicate_segments(vectors, similarity=0.99).collect())
    assert got == sorted(brute_force(rows[:0], 0.99)) if not rows else len(got) == len(rows)
    assert any(n for _, n, _, _ in got)
