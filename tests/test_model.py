"""Model, attribution, countermeasures and what-if results."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kerbline.operators import bootstrap, explain, model, whatif
from kerbline.operators.model import Coefficient
from kerbline.plans import publish

FEATURES = "segment_id string, county string, speed_limit_mph double, lane_count double, aadt_normalized double, aadt_raw double, pedcyclist_incident_count_5yr int, rural_flag boolean"


def chain(spark, n=8):
    rows = [
        (f"s{i}", "c", None if i == 3 else 25.0 + 5 * (i % 5), 1.0 + i % 3, (i % 4) / 4, 100.0 + i, i % 3, i % 2 == 0)
        for i in range(n)
    ]
    edges = [(f"s{i}", f"s{i + 1}") for i in range(n - 1)] + [("s0", "s4")]
    both = edges + [(b, a) for a, b in edges]
    return spark.createDataFrame(rows, FEATURES), spark.createDataFrame(both, "src string, dst string")


COEFS = (
    Coefficient(0, "speed_limit_mph", 0.03),
    Coefficient(1, "speed_limit_mph", -0.02),
    Coefficient(2, "speed_limit_mph", 0.01),
    Coefficient(0, "lane_count", 0.2),
    Coefficient(2, "aadt_normalized", 0.7),
)


def test_groups_without_columns_are_left_out(spark):
    feats, _ = chain(spark)
    groups = model.feature_groups(feats)
    assert groups["infrastructure"] == ["speed_limit_mph", "lane_count"] and "ems_access" not in groups
    assert ("crash_history", model.TARGET) not in model.present_features(feats, include_target_history=False)


def test_fit_recovers_known_coefficients(spark):
    rng = random.Random(12)
    rows, k = [], []
    for i in range(4000):
        x, y, aadt = rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(50, 400)
        lam = aadt * math.exp(-5.0 + 0.8 * x - 0.5 * y)
        draw, p, u = 0, math.exp(-lam), rng.random()
        cdf = p
        while u > cdf and draw < 200:
            draw += 1
            p *= lam / draw
            cdf += p
        rows.append((f"s{i}", x, y))
        k.append((f"s{i}", draw, aadt))
    matrix = spark.createDataFrame(rows, "segment_id string, lane_count double, lane_count_h1 double")
    segs = spark.createDataFrame(k, "segment_id string, pedcyclist_incident_count_5yr int, aadt_raw double")
    fit = model.fit_poisson(matrix, segs, F.lit("train"))
    again = model.fit_poisson(matrix.repartition(5), segs, F.lit("train"))
    raw = {(c.hop, c.feature): c.w / fit.scaler["std_lane_count" + ("_h1" if c.hop else "")] for c in fit.coefs}
    assert raw[(0, "lane_count")] == pytest.approx(0.8, abs=0.1)
    assert raw[(1, "lane_count")] == pytest.approx(-0.5, abs=0.1)
    assert [c.w for c in again.coefs] == pytest.approx([c.w for c in fit.coefs], rel=1e-6)


def top(spark, feats):
    rows = [("s", [(i + 1, n, 0.5, float(v), "infrastructure") for i, (n, v) in enumerate(feats)])]
    return spark.createDataFrame(
        rows,
        "segment_id string, top_features array<struct<feature_rank:int,feature_name:string,importance:double,value:double,modality:string>>",
    )


def categories(spark, feats, **kw):
    out = explain.countermeasures(top(spark, feats), **kw).first().suggestions
    return [c.category for c in out]


def test_countermeasure_rules(spark):
    by_name = {}
    for rule in explain.RULES:
        by_name.setdefault(rule.feature_contains, rule)
    for name, rule in by_name.items():
        # A value far on the side that the rule asks for.
        beyond = rule.threshold + (1000 if rule.op.startswith(">") else -1000)
        assert categories(spark, [(f"own_{name}_x", beyond)])[0] == rule.category
    unmatched = categories(spark, [("nothing_of_the_kind", 17)])
    assert unmatched == [explain.NO_RULE[0]]
    repeated = [(n, r.threshold + (1000 if r.op.startswith(">") else -1000)) for n, r in by_name.items()]
    assert len(categories(spark, repeated * 2)) == min(3, len({r.category for r in by_name.values()}))
    assert categories(spark, repeated, max_suggestions=1) == [explain.RULES[0].category]


def test_taken_category_falls_through_to_the_next_rule(spark):
    a = explain.Rule("speed", ">=", 1.0, "A", "r", "t")
    b = explain.Rule("speed_limit", ">=", 1.0, "B", "r", "t")
    assert categories(spark, [("speed_limit_mph", 5), ("speed_limit_x", 5)], rules=(a, b)) == ["A", "B"]


def test_attribution_touches_the_own_row_only(spark):
    """The contribution equals the change of the predictor when the own value is zeroed."""
    feats, edges = chain(spark)
    nodes = feats.select(F.col("segment_id").alias("node"))
    matrix = model.model_matrix(feats)
    got = {
        (r.segment_id, r.feature_name): r
        for r in explain.attribution(matrix, nodes, edges, COEFS).collect()
    }
    wide = model.design(feats, edges)
    base = {r.segment_id: r.eta for r in model.score(wide, 0.5, COEFS).collect()}
    zeroed = feats.withColumn("speed_limit_mph", F.when(F.col("segment_id") == "s2", 0.0).otherwise(F.coalesce("speed_limit_mph", F.lit(got[("s3", "speed_limit_mph")].value))))
    moved = {r.segment_id: r.eta for r in model.score(model.design(zeroed, edges), 0.5, COEFS).collect()}
    assert got[("s2", "speed_limit_mph")].contribution == pytest.approx(base["s2"] - moved["s2"])
    for s in base:
        shares = [r.importance for (seg, _), r in got.items() if seg == s]
        assert all(0 <= v <= 1 for v in shares) and sum(shares) == pytest.approx(1.0)


def test_topk_order_and_jaccard(spark):
    feats, edges = chain(spark)
    nodes = feats.select(F.col("segment_id").alias("node"))
    arrays = explain.attribution_arrays(model.model_matrix(feats), nodes, edges, COEFS)
    two = explain.topk_nested(arrays, 2)
    for r in two.collect():
        imp = [f.importance for f in r.top_features]
        assert len(imp) == 2 and imp == sorted(imp, reverse=True) and r.top_features[0].feature_rank == 1
    assert {r.jaccard for r in explain.topk_jaccard(two, two).collect()} == {1.0}
    none = two.withColumn("top_features", F.slice("top_features", 1, 0))
    assert {r.jaccard for r in explain.topk_jaccard(none, none).collect()} == {0.0}
    assert "Window" not in two._jdf.queryExecution().toString()


def test_counterfactual_equals_full_rescore(spark):
    feats, edges = chain(spark)
    nodes = feats.select(F.col("segment_id").alias("node"))
    matrix = model.model_matrix(feats)
    filled = feats.drop("speed_limit_mph").join(matrix.select("segment_id", "speed_limit_mph"), "segment_id")
    scored = model.score(model.design(filled, edges), -1.0, COEFS)
    target = spark.createDataFrame([("s1",), ("s6",)], "target string")
    names = [c for c in matrix.columns if c != "segment_id"]
    got = whatif.counterfactual(target, matrix, scored, nodes, edges, COEFS, names, digits=9).collect()
    before = {r.segment_id: r.risk_score for r in scored.collect()}
    for t in ("s1", "s6"):
        changed = filled.withColumn("speed_limit_mph", F.when(F.col("segment_id") == t, 25.0).otherwise(F.col("speed_limit_mph")))
        after = {r.segment_id: r.risk_score for r in model.score(model.design(changed, edges), -1.0, COEFS).collect()}
        rows = {r.affected_id: r for r in got if r.segment_id == t and r.intervention == "reduce_speed_limit_25"}
        for s in before:
            if s in rows:
                assert rows[s].updated_risk_score == pytest.approx(after[s], abs=1e-8)
                assert rows[s].baseline_risk_score == pytest.approx(before[s], abs=1e-8)
            else:
                assert after[s] == pytest.approx(before[s], abs=1e-12)
        assert rows[t].hop == 0
    assert {r.hop for r in got} == {0, 1, 2}
    hop2 = {r.affected_id for r in got if r.segment_id == "s1" and r.hop == 2}
    assert hop2 == {"s3", "s4"}
    missed = whatif.not_applied(target, names).collect()
    assert len(missed) == 6 and all(not r.applied and "crosswalk" in r.reason or "sidewalk" in r.reason or "lighting" in r.reason for r in missed)
    means = whatif.neighbor_mean_delta(spark.createDataFrame(got)).collect()
    assert {(r.segment_id, r.n_neighbors) for r in means} == {("s1", 2), ("s6", 2)}


def test_bootstrap_weights_have_mean_one(spark):
    w = spark.range(20000).select(explain.poisson_weight(F.col("id"), 1).alias("w"))
    row = w.agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert abs(row.m - 1) < 0.05 and abs(row.v - 1) < 0.08


def drawn_rows(spark, n=1500):
    rng = random.Random(5)
    rows, k = [], []
    for i in range(n):
        x, y, aadt = rng.uniform(-1, 1), rng.uniform(-1, 1), rng.uniform(50, 400)
        lam = aadt * math.exp(-5.0 + 0.8 * x - 0.5 * y)
        rows.append((f"s{i}", x, y, 1.0))
        k.append((f"s{i}", int(lam + rng.uniform(-1, 1) * math.sqrt(lam) + 0.5), aadt))
    matrix = spark.createDataFrame(rows, "segment_id string, lane_count double, lane_count_h1 double, speed_limit_mph double")
    return matrix, spark.createDataFrame(k, "segment_id string, pedcyclist_incident_count_5yr int, aadt_raw double")


def jobs_of(spark, run):
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = run()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_one_step_refits_are_near_full_refits(spark):
    matrix, segs = drawn_rows(spark)
    split = F.when(F.crc32("segment_id") % 4 == 0, "test").otherwise("train")
    fit = model.fit_poisson(matrix, segs, split)
    one = bootstrap.bootstrap_refits(matrix, segs, fit, explain.poisson_weight, 3, split)
    two = bootstrap.bootstrap_refits(matrix, segs, fit, explain.poisson_weight, 3, split, steps=2)
    slopes = lambda f: {(c.hop, c.feature): c.w for c in model.raw_coefficients(f)[1]}
    base = slopes(fit)
    for r in (1, 2, 3):
        want = slopes(model.fit_poisson(matrix, segs, split, explain.poisson_weight(F.col("segment_id"), r)))
        moved = max(abs(base[c] - want[c]) for c in want)
        assert moved > 1e-3
        for found, share in ((one, 0.1), (two, 0.005)):
            got = slopes(found[r - 1])
            assert max(abs(got[c] - want[c]) for c in want if c[1] == "lane_count") < share * moved
            # A column without variation stays without weight.
            assert abs(got[(0, "speed_limit_mph")]) < 1e-6


def test_jobs_of_the_confidence_do_not_depend_on_the_number_of_draws(spark):
    feats, edges = chain(spark, 40)
    matrix = model.design(feats, edges, include_target_history=False)
    fit = model.fit_poisson(matrix, feats, F.lit("train"), reg=1e-3)
    nodes = feats.select(F.col("segment_id").alias("node"))
    base = explain.topk_nested(explain.attribution_arrays(model.model_matrix(feats), nodes, edges, COEFS), 2)
    counts = set()
    for runs in (2, 9):
        sure = lambda runs=runs: publish.explanation_confidence(feats, edges, base, runs, 2, matrix, fit).collect()
        rows, jobs = jobs_of(spark, sure)
        assert len(rows) == 40
        counts.add(jobs)
    assert len(counts) == 1


def test_stability_equals_overlaps_taken_one_by_one(spark, tmp_path):
    feats, edges = chain(spark)
    nodes = feats.select(F.col("segment_id").alias("node"))
    matrix = model.model_matrix(feats)
    bootstrap.save_coefficient_sets(spark, [COEFS, COEFS[:3], [c._replace(w=-c.w * (1 + c.hop)) for c in COEFS]], str(tmp_path / "sets"))
    sets = bootstrap.load_coefficient_sets(spark, str(tmp_path / "sets"))
    assert sets[1] == list(COEFS[:3])
    base = explain.topk_nested(explain.attribution_arrays(matrix, nodes, edges, COEFS), 2)
    names = lambda df: {r.segment_id: [f.feature_name for f in r.top_features] for r in df.collect()}
    own = names(base)
    # A set that lacks a feature gives it no weight.
    full = [list(s) + [Coefficient(0, f, 0.0) for f in {c.feature for c in COEFS} - {c.feature for c in s}] for s in sets]
    others = [names(explain.topk_nested(explain.attribution_arrays(matrix, nodes, edges, s), 2)) for s in full]
    got = {r.segment_id: r.explanation_confidence for r in explain.topk_stability(matrix, nodes, edges, base, sets, 2).collect()}
    for s, mine in own.items():
        want = sum(len(set(mine) & set(o[s])) / len(set(mine) | set(o[s])) for o in others) / 3
        assert got[s] == pytest.approx(want)
    assert len(set(got.values())) > 1


def test_priority_list_and_confidence(spark, sf_dir):
    from kerbline.plans.catalog import QUERIES
    from kerbline.sources.demo import Stages

    rows = QUERIES["priority_list"](spark, sf_dir).collect()
    assert [r["rank"] for r in rows] == list(range(1, 26))
    assert all(len(r.top_features) == 6 and 1 <= len(r.suggested_countermeasures) <= 3 for r in rows)
    st = Stages.of(spark, sf_dir)
    matrix = model.design(st.features, st.edges, include_target_history=False)
    fit = model.fit_poisson(matrix, st.features, F.lit("train"))
    base = publish.top_of_fit(matrix, st.features, st.edges, fit, st.features)
    sure = publish.explanation_confidence(st.features, st.edges, base, runs=2).collect()
    assert len(sure) == st.features.count() and all(0 <= r.explanation_confidence <= 1 for r in sure)
