"""Emergency stations from two layers with different columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.functions.scalar import title_case

# Columns of the combined station table.
KEEP = ("station_type", "name", "county", "address", "city", "lat", "lon")
FIRE_ONLY = ("FD_ID", "STATION_NUMBER")
EMS_ONLY = ("fips", "type", "numabul", "totalpers")


def _keep(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*[c for c in cols if c in df.columns])


def fire_stations(flat: DataFrame) -> DataFrame:
    """Named coordinates where the layer has them, geometry otherwise."""
    lat = F.col("LATITUDE") if "LATITUDE" in flat.columns else F.col("_lat")
    lon = F.col("LONGITUDE") if "LONGITUDE" in flat.columns else F.col("_lon")
    out = flat.select(
        F.lit("fire").alias("station_type"),
        F.col("DEPT_NAME").alias("name"),
        F.col("COUNTY").alias("county"),
        F.col("STATION_ADDRESS").alias("address"),
        lat.alias("lat"),
        lon.alias("lon"),
        *[c for c in FIRE_ONLY if c in flat.columns],
    )
    return _keep(out, (*KEEP, *FIRE_ONLY))


def ems_stations(flat: DataFrame) -> DataFrame:
    """Coordinates come from the geometry, county names arrive in capitals."""
    out = flat.withColumns(
        {
            "station_type": F.lit("ems"),
            "county": title_case(F.col("county")),
            "lat": F.col("_lat"),
            "lon": F.col("_lon"),
        }
    )
    return _keep(out, (*KEEP, *EMS_ONLY))


def stations_union(fire: DataFrame, ems: DataFrame) -> DataFrame:
    return fire.unionByName(ems, allowMissingColumns=True)
