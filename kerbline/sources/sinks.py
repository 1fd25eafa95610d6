"""Table, CSV, JSON and GeoJSON outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

GEOMETRY_COLS = ("start_lat", "start_lon", "end_lat", "end_lon")


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


# Missing values are written as this mark, so that empty text stays empty text.
CSV_NULL = "\\N"


def write_csv(df: DataFrame, path: str) -> None:
    """Quotes and line breaks inside values survive."""
    df.write.mode("overwrite").csv(path, header=True, escape='"', nullValue=CSV_NULL)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, line_breaks: bool = True) -> DataFrame:
    """NaN becomes null. Without ``line_breaks`` inside values large files are read by many tasks."""
    rows = spark.read.schema(schema).csv(
        path, header=True, escape='"', multiLine=line_breaks, nullValue=CSV_NULL
    )
    return missing_to_null(rows)


def missing_to_null(df: DataFrame) -> DataFrame:
    """NaN is not JSON: turn it into null in every floating column."""
    fixes = {
        f.name: F.when(~F.isnan(F.col(f.name)), F.col(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(fixes) if fixes else df


def record_json(df: DataFrame) -> DataFrame:
    """``record``: one JSON object per row, missing values written as null."""
    clean = missing_to_null(df)
    return clean.select(
        F.to_json(F.struct(*clean.columns), {"ignoreNullFields": "false"}).alias("record")
    )


def write_records(df: DataFrame, path: str) -> None:
    missing_to_null(df).write.mode("overwrite").json(path, ignoreNullFields=False)


def geojson_features(scores: DataFrame) -> DataFrame:
    """``feature``: one GeoJSON Feature per row, a line between the endpoints.

    When one of the four endpoint columns is absent the rows go out as plain records.
    """
    if not set(GEOMETRY_COLS) <= set(scores.columns):
        return record_json(scores).withColumnRenamed("record", "feature")
    no = F.lit(False)

    def flag(name: str):
        return (F.coalesce(F.col(name), no) if name in scores.columns else no).alias(name)

    def text(name: str):
        return (F.col(name) if name in scores.columns else F.lit(None).cast("string")).alias(name)

    feature = F.struct(
        F.lit("Feature").alias("type"),
        F.struct(
            F.lit("LineString").alias("type"),
            F.array(
                F.array("start_lon", "start_lat"), F.array("end_lon", "end_lat")
            ).alias("coordinates"),
        ).alias("geometry"),
        F.struct(
            text("segment_id"),
            text("segment_name"),
            text("county"),
            flag("rural_flag"),
            F.col("risk_score").cast("double").alias("risk_score"),
            F.col("risk_exposure").cast("double").alias("risk_exposure"),
            flag("data_density_flag"),
            flag("ems_distance_available"),
        ).alias("properties"),
    )
    return missing_to_null(scores).select(
        F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature")
    )


def write_geojson(scores: DataFrame, path: str) -> None:
    """Newline-delimited features, written in parallel."""
    geojson_features(scores).write.mode("overwrite").text(path)


def export_meta(scores: DataFrame) -> DataFrame:
    return scores.agg(F.count("*").alias("n_segments"))


def reuse_or_build(spark: SparkSession, path: str, n: int, build: Callable[[], DataFrame]) -> DataFrame:
    """The stored top list if it exists and has exactly ``n`` rows, else a new one."""
    from pyspark.errors import AnalysisException

    try:
        stored = spark.read.parquet(path)
        if stored.count() == n:
            return stored
    except AnalysisException:
        pass
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
