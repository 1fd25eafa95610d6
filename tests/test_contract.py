import copy
import json

import pytest

from kerbline.operators import contract

VALID = {
    "meta": {"district": "North", "timestamp": "2030-05-06T07:08:09Z", "model_checkpoint": "poisson-17"},
    "segment": {
        "segment_id": "k-2041",
        "segment_name": "Harbour Lane (0.40-1.25)",
        "county": "Eastshire",
        "rural_flag": True,
        "risk_score": 0.037,
        "risk_exposure_score": 2,
    },
    "top_features": [
        {"feature_name": "lane_count", "importance": 0.21, "value": 6.0, "modality": "infrastructure"},
        {"feature_name": "log_aadt", "importance": 0.08, "value": 9.4, "modality": "aadt"},
    ],
    "data_density_flag": True,
    "explanation_confidence": 0.35,
}


def changed(path, value=None, drop=False):
    out = copy.deepcopy(VALID)
    at = out
    for p in path[:-1]:
        at = at[p]
    if drop:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return out


def check(spark, *records):
    texts = [(r if isinstance(r, str) else json.dumps(r),) for r in records]
    df = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i int, record string")
    return [r.problems for r in contract.contract_check(df).orderBy("i").collect()]


def test_contract_cases(spark):
    got = check(
        spark,
        VALID,
        changed(["top_features"], drop=True),
        changed(["segment", "risk_score"], "n/a"),
        changed(["segment", "risk_score"], True),
        changed(["explanation_confidence"], True),
        changed(["data_density_flag"], None),
        changed(["meta"], []),
        changed(["meta", "model_checkpoint_sha256"], 5),
        changed(["meta", "model_checkpoint_sha256"], "ab"),
        changed(["top_features"], [7, {"feature_name": "x", "importance": True, "value": 1}]),
        changed(["segment", "rural_flag"], 1),
        changed(["top_features"], []),
        "{broken",
    )
    assert got == [
        [],
        ["top-level.top_features: missing"],
        ["segment.risk_score: expected number, got string"],
        ["segment.risk_score: expected number, got boolean"],
        [],
        ["top-level.data_density_flag: expected boolean, got null"],
        ["top-level.meta: expected object, got array"],
        ["meta.model_checkpoint_sha256: expected string, got number"],
        [],
        [
            "top_features[0]: expected object, got number",
            "top_features[1].importance: expected number, got boolean",
            "top_features[1].modality: missing",
        ],
        ["segment.rural_flag: expected boolean, got number"],
        [],
        ["record: not JSON"],
    ]


def test_top_level_problems_hide_nested_ones(spark):
    bad = changed(["segment", "county"], 3)
    del bad["meta"]
    assert check(spark, bad) == [["top-level.meta: missing"]]


def test_assert_valid(spark):
    df = spark.createDataFrame([(json.dumps(VALID),)], "record string")
    contract.assert_valid(df)
    with pytest.raises(ValueError, match="not JSON"):
        contract.assert_valid(spark.createDataFrame([("nope",)], "record string"))
