"""The contract of explanation records (JSON text), checked on Spark.

``contract_check`` lists what each record lacks; ``assert_valid`` ends a run over it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Required keys and their JSON types.
TOP_LEVEL = {
    "meta": "object",
    "segment": "object",
    "top_features": "array",
    "data_density_flag": "boolean",
    "explanation_confidence": "number",
}
META = {"district": "string", "timestamp": "string", "model_checkpoint": "string"}
META_OPTIONAL = {"model_checkpoint_sha256": "string"}
SEGMENT = {
    "segment_id": "string",
    "segment_name": "string",
    "county": "string",
    "rural_flag": "boolean",
    "risk_score": "number",
    "risk_exposure_score": "number",
}
TOP_FEATURE = {
    "feature_name": "string",
    "importance": "number",
    "value": "number",
    "modality": "string",
}


def _type_of(v: Column) -> Column:
    """JSON type name; null where the key is absent. ``true`` is never a number."""
    # "OBJECT<..>", "ARRAY<..>" and "DECIMAL(..)" lose what follows the first word.
    name = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    known = {"OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null"}
    pairs = [F.lit(x) for kv in known.items() for x in kv]
    mapped = F.try_element_at(F.create_map(*pairs), name)
    return F.when(v.isNotNull(), F.coalesce(mapped, F.lit("number")))


def _at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def _check(where: Column, got: Column, key: str, want: str, required: bool = True, bool_is_number: bool = False) -> Column:
    wrong = got != want
    if bool_is_number:
        wrong = wrong & (got != "boolean")
    path = F.concat(where, F.lit(f".{key}"))
    absent = F.concat(path, F.lit(": missing")) if required else F.lit(None).cast("string")
    return F.when(got.isNull(), absent).when(wrong, F.concat(path, F.lit(f": expected {want}, got "), got))


def _present(checks: list[Column]) -> Column:
    return F.array_compact(F.array(*checks))


# Every typed path outside the feature list: (prefix, key, wanted type, required).
_PATHS = (
    [("top-level", k, t, True) for k, t in TOP_LEVEL.items()]
    + [("meta", k, t, True) for k, t in META.items()]
    + [("meta", k, t, False) for k, t in META_OPTIONAL.items()]
    + [("segment", k, t, True) for k, t in SEGMENT.items()]
)


def contract_check(records: DataFrame, text: str = "record") -> DataFrame:
    """Adds ``problems`` (``array<string>``, empty when valid) and ``is_valid``.

    Top-level problems hide the nested ones. A boolean passes for the top-level
    number but not for a nested one. The record is parsed once, then its types
    are taken once; the checks only compare type names.
    """
    v = F.col("_v")
    types = F.struct(
        *[
            _type_of(_at(v, k if where == "top-level" else f"{where}.{k}")).alias(f"t{i}")
            for i, (where, k, _, _) in enumerate(_PATHS)
        ]
    )

    def feature_types(f: Column) -> Column:
        return F.struct(
            _type_of(f).alias("kind"), *[_type_of(_at(f, k)).alias(k) for k in TOP_FEATURE]
        )

    typed = (
        records.withColumn("_v", F.try_parse_json(text))
        .withColumn("_types", types)
        .withColumn(
            "_features", F.transform(F.try_variant_get(v, "$.top_features", "array<variant>"), feature_types)
        )
    )

    checks: dict[bool, list[Column]] = {True: [], False: []}
    for i, (where, k, want, required) in enumerate(_PATHS):
        outer = where == "top-level"
        checks[outer].append(
            _check(F.lit(where), F.col(f"_types.t{i}"), k, want, required, outer and want == "number")
        )

    def entry(f: Column, i: Column) -> Column:
        where = F.concat(F.lit("top_features["), i.cast("string"), F.lit("]"))
        inner = _present([_check(where, f[k], k, t) for k, t in TOP_FEATURE.items()])
        return F.when(
            f["kind"] != "object", F.array(F.concat(where, F.lit(": expected object, got "), f["kind"]))
        ).otherwise(inner)

    none = F.array().cast("array<string>")
    return (
        typed.withColumn("_top", _present(checks[True]))
        .withColumn(
            "problems",
            F.when(v.isNull(), F.array(F.lit("record: not JSON")))
            .when(F.size("_top") > 0, F.col("_top"))
            .otherwise(
                F.concat(
                    _present(checks[False]), F.coalesce(F.flatten(F.transform("_features", entry)), none)
                )
            ),
        )
        .withColumn("is_valid", F.size("problems") == 0)
        .drop("_v", "_types", "_features", "_top")
    )


def assert_valid(records: DataFrame, text: str = "record") -> None:
    """Stops a run whose records break the contract, naming what is wrong with the first few."""
    broken = contract_check(records, text).where(~F.col("is_valid")).select("problems").take(5)
    if broken:
        raise ValueError(f"{len(broken)} or more records break the contract, for instance: " + " | ".join("; ".join(r["problems"]) for r in broken))
