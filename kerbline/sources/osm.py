"""Map ways with a free-form tag map."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "id bigint, tags map<string,string>, center struct<lat: double, lon: double>"
TAGS = ("highway", "name", "maxspeed", "lanes", "sidewalk", "cycleway")


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(path, multiLine=True)


def flatten_ways(ways: DataFrame) -> DataFrame:
    """Nine columns; a tag that is not set is null."""
    return ways.select(
        F.col("id").alias("osm_id"),
        *[F.try_element_at("tags", F.lit(t)).alias(t) for t in TAGS],
        F.col("center.lat").alias("lat"),
        F.col("center.lon").alias("lon"),
    )
