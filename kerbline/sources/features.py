"""Landed feature layers: JSON pages of ``{attributes, geometry}`` records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kerbline.functions import geo

GEOMETRY = T.StructType(
    [
        T.StructField("x", T.DoubleType()),
        T.StructField("y", T.DoubleType()),
        T.StructField("paths", T.ArrayType(T.ArrayType(T.ArrayType(T.DoubleType())))),
    ]
)

# Column contracts of the landed layers.
ROADS = "RouteName string, StreetName string, MaintCntyCode string, RouteClass string, FuncClass int, SpeedLimit double, DesignSpd double, ThruLaneCount double, PeakLanes double, LaneWidth double, SrfcType string, UrbanType string, AADT double, AadtDate bigint, BeginMp1 double, EndMp1 double, RouteID string"
GENERAL_CRASHES = "Crash_ID string, Date bigint, Year int, Month int, County string, City string, CrshSeverity string, NumFatalities int, NumAInjuries int, NumBInjuries int, NumCInjuries int, PedFatalities int, PedSeriousInjuries int, BikeFatalities int, BikeSeriousInjuries int, CrashType string, SpeedRelated string, PedInvolved string, BikeInvolved string"
INCIDENTS = "CrashID string, CrashDate bigint, CrashYear int, CrashSevr string, NM_Type string, NM_Age string, NM_Sex string, NM_Inj string, BikeDir string, SpeedLimit string, RdClass string, RdCharacte string, RdConditio string, LightCond string, Weather string, Latitude double, Longitude double, County string, City string"
TRAFFIC = "TSegID2025 string, RouteID string, BeginMP double, EndMP double, AADT double, AADTT double, AADT_Year int, SU_AADT double, MU_AADT double"


def record_schema(attributes: str | T.StructType) -> T.StructType:
    if isinstance(attributes, str):
        attributes = T.StructType.fromDDL(attributes)
    return T.StructType(
        [T.StructField("attributes", attributes), T.StructField("geometry", GEOMETRY)]
    )


def read_pages(spark: SparkSession, path: str, attributes: str | T.StructType) -> DataFrame:
    """One landed file is a JSON array of records; files are read in parallel.

    The schema is explicit: nothing is inferred, attributes left out of it are not
    parsed, and the geometry is parsed only when it is used.
    """
    return spark.read.schema(record_schema(attributes)).json(path, multiLine=True)


def flatten(records: DataFrame, geometry: bool = True) -> DataFrame:
    """Attributes as columns, plus ``_lon, _lat`` from a point or a polyline."""
    if not geometry:
        return records.select("attributes.*")
    g = F.col("geometry")
    mid = geo.polyline_midpoint(g["paths"])
    is_point = g["x"].isNotNull() & g["y"].isNotNull()
    return records.select(
        "attributes.*",
        F.when(is_point, g["x"]).otherwise(mid["lon"]).alias("_lon"),
        F.when(is_point, g["y"]).otherwise(mid["lat"]).alias("_lat"),
    )


def segment_geometry(records: DataFrame, attributes: Mapping[str, Column]) -> DataFrame:
    """Segments from the first path: endpoints, mean vertex, vertices.

    Lines with fewer than two vertices are dropped. ``attributes`` names the
    output columns taken from ``attributes``.
    """
    # The explode keeps the optimizer from working the path out anew for every use of it.
    held = records.select("attributes", F.explode(F.array(F.get("geometry.paths", F.lit(0)))).alias("path"))
    path = F.col("path")
    first, last = F.get(path, F.lit(0)), F.try_element_at(path, F.lit(-1))
    mean = geo.path_mean(path)
    return held.where(F.size(path) >= 2).select(
        *[c.alias(n) for n, c in attributes.items()],
        F.get(first, F.lit(0)).alias("start_lon"),
        F.get(first, F.lit(1)).alias("start_lat"),
        F.get(last, F.lit(0)).alias("end_lon"),
        F.get(last, F.lit(1)).alias("end_lat"),
        mean["lon"].alias("mid_lon"),
        mean["lat"].alias("mid_lat"),
        path.alias("vertices"),
    )


def vertices(segments: DataFrame) -> DataFrame:
    """``segment_id, lat, lon``, one row per vertex."""
    return segments.select("segment_id", F.explode("vertices").alias("v")).select(
        "segment_id", F.col("v")[1].alias("lat"), F.col("v")[0].alias("lon")
    )


def source_filter(
    df: DataFrame,
    members: Mapping[str, Sequence],
    columns: Sequence[str],
    years: tuple[str, Sequence[int]] | None = None,
) -> DataFrame:
    """``column IN (..)`` filters, a year list on a date column, and a column list.

    A year is a half-open date range, so that the filter reaches the file scan.
    """
    for col, values in members.items():
        df = df.where(F.col(col).isin(list(values)))
    if years:
        col, wanted = years
        within = F.lit(False)
        for y in sorted(wanted):
            start = F.lit(f"{y}-01-01").cast(df.schema[col].dataType)
            end = F.lit(f"{y + 1}-01-01").cast(df.schema[col].dataType)
            within = within | ((F.col(col) >= start) & (F.col(col) < end))
        df = df.where(within)
    return df.select(*columns)


def bbox_filter(df: DataFrame, bbox: Mapping[str, float], lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Keep rows inside the box; missing coordinates are outside."""
    return df.where(geo.within_bbox(F.col(lat), F.col(lon), bbox))


def drop_without_coordinates(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    return df.dropna(subset=[lat, lon])


def dropped_count(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """One row: how many records have coordinates and how many were dropped."""
    missing = F.col(lat).isNull() | F.col(lon).isNull()
    return df.agg(F.count_if(~missing).alias("kept"), F.count_if(missing).alias("dropped"))
