"""Road layers to the segment feature table and its graph."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kerbline.functions.scalar import segment_name, zero_to_null
from kerbline.operators.graph import (
    adjacency_proximity,
    edge_weights,
    induced_subgraph,
)
from kerbline.operators.routing import nearest_facility_distance
from kerbline.operators.skew import hot_keys, salted_join
from kerbline.operators.spatial import count_nearest, nearest_join
from kerbline.operators.stats import minmax, minmax_of
from kerbline.session import counted, durable_with, together
from kerbline.sources.features import vertices

# Search radii in metres.
ROAD_ATTRIBUTE_MAX_M = 500.0
COUNTY_MAX_M = 5000.0
INCIDENT_MAX_M = 200.0
STATION_MAX_M = 2000.0
ADJACENCY_TOL_M = 50.0

# The columns of the feature table.
FEATURE_COLUMNS = (
    "segment_id",
    "segment_name",
    "county",
    "rural_flag",
    "county_code",
    "speed_limit_mph",
    "lane_count",
    "road_classification",
    "aadt_raw",
    "aadt_normalized",
    "pedcyclist_incident_count_5yr",
    "general_crash_count_5yr_county",
    "ems_distance_m",
    "start_lat",
    "start_lon",
    "end_lat",
    "end_lon",
    "mid_lat",
    "mid_lon",
    "isrn_join_distance_m",
)


class Assembled(NamedTuple):
    features: DataFrame
    edges: DataFrame


def road_attributes(segments: DataFrame, roads: DataFrame) -> DataFrame:
    """County, rural flag and name from the nearest road point within 5 km; speed,
    lanes and class from the same point only when it is within 500 m.

    One search serves both radii. ``segments`` has ``segment_id, route_id, mid_lat,
    mid_lon``; ``roads`` has ``road_id, lat, lon`` and the attributes.
    """
    mids = segments.select("segment_id", "route_id", F.col("mid_lat").alias("lat"), F.col("mid_lon").alias("lon"))
    matched = counted(nearest_join(mids, roads, COUNTY_MAX_M, "road_id"), "nearest_road")
    attrs = roads.select(
        F.col("road_id").alias("target_id"), "county", "UrbanType", "StreetName", "RouteName", "SpeedLimit", "ThruLaneCount", "FuncClass"
    )
    found = F.col("target_id").isNotNull()
    near = found & (F.col("distance_m") <= ROAD_ATTRIBUTE_MAX_M)

    def local(c: Column) -> Column:
        return F.when(near, c.cast("double"))

    # One road point may be the nearest of very many segments.
    joined = salted_join(matched, attrs, ["target_id"], "left", hot_keys(matched, ["target_id"], base=matched))
    return joined.select(
        "segment_id",
        "county",
        F.when(found, F.col("UrbanType").isNull()).alias("rural_flag"),
        F.when(
            found, segment_name(F.col("StreetName"), F.col("RouteName"), F.col("route_id"), F.col("county"))
        ).alias("segment_name"),
        local(zero_to_null(F.col("SpeedLimit"))).alias("speed_limit_mph"),
        local(zero_to_null(F.col("ThruLaneCount"))).alias("lane_count"),
        local(F.col("FuncClass")).alias("road_classification"),
        F.col("distance_m").alias("isrn_join_distance_m"),
    )


def incident_counts(segments: DataFrame, incidents: DataFrame) -> DataFrame:
    """``segment_id, pedcyclist_incident_count_5yr`` for every segment."""
    hits = count_nearest(incidents, vertices(segments), INCIDENT_MAX_M, "segment_id")
    return segments.select("segment_id").join(
        hits.withColumnRenamed("target_id", "segment_id"), "segment_id", "left"
    ).select("segment_id", F.coalesce("n", F.lit(0).cast("long")).alias("pedcyclist_incident_count_5yr"))


def unmatched_incidents(segments: DataFrame, incidents: DataFrame) -> DataFrame:
    """Incidents without coordinates or beyond the radius."""
    matched = nearest_join(incidents, vertices(segments), INCIDENT_MAX_M, "segment_id")
    return matched.where(F.col("target_id").isNull()).select(*incidents.columns)


def facility_segments(segments: DataFrame, stations: DataFrame) -> DataFrame:
    """``node``: the distinct segments nearest to a station within 2 km."""
    near = count_nearest(stations, vertices(segments), STATION_MAX_M, "segment_id")
    return near.select(F.col("target_id").alias("node"))


def county_crash_counts(segments: DataFrame, crashes: DataFrame) -> DataFrame:
    """All crashes of the segment's county on every segment, 0 where there are none."""
    totals = counted(
        crashes.groupBy("county").agg(F.count("*").alias("general_crash_count_5yr_county")), "crash_totals"
    )
    return segments.join(totals, "county", "left").fillna(0, ["general_crash_count_5yr_county"])


def county_code(segments: DataFrame) -> DataFrame:
    """Adds ``county_code``: counties numbered in order of their first segment id."""
    firsts = segments.where(F.col("county").isNotNull()).groupBy("county").agg(F.min("segment_id").alias("first"))
    # One row per county: the window orders county names, not segments.
    codes = counted(
        firsts.select("county", (F.row_number().over(Window.orderBy("first")) - 1.0).alias("county_code")),
        "county_codes",
    )
    return segments.join(codes, "county", "left")


def assemble(
    segments: DataFrame,
    roads: DataFrame,
    incidents: DataFrame,
    general_crashes: DataFrame,
    stations: DataFrame,
    tol_m: float = ADJACENCY_TOL_M,
) -> Assembled:
    """The feature table and the edge list ``src, dst, weight_m``.

    Incidents, routing and the traffic range are taken over all segments; those
    without a county are dropped only afterwards, together with their edges.
    """
    # The range of the traffic values is taken while the segments are written.
    segments, traffic = durable_with(segments, "segments", **minmax_of(["aadt_raw"]))
    nodes = segments.select(F.col("segment_id").alias("node"))

    def weigh() -> DataFrame:
        linked = counted(adjacency_proximity(segments, tol_m), "adjacency")
        return counted(edge_weights(linked, segments), "edges")

    attrs, hits, weighted, facilities = together(
        segments.sparkSession,
        lambda: counted(road_attributes(segments, roads), "road_attributes"),
        lambda: counted(incident_counts(segments, incidents), "incident_counts"),
        weigh,
        lambda: counted(facility_segments(segments, stations), "facilities"),
    )
    reach = nearest_facility_distance(nodes, weighted, facilities)

    kept = (
        minmax(segments.drop("vertices"), {"aadt_raw": "aadt_normalized"}, fitted=traffic)
        .join(attrs.where(F.col("county").isNotNull()), "segment_id")
        .join(hits, "segment_id")
        .join(
            reach.select(F.col("node").alias("segment_id"), F.col("dist_m").alias("ems_distance_m")), "segment_id", "left"
        )
    )
    kept = counted(kept, "in_district")
    features = counted(
        county_code(county_crash_counts(kept, general_crashes)).select(*FEATURE_COLUMNS), "features"
    )
    inside = features.select(F.col("segment_id").alias("node"))
    return Assembled(features, counted(induced_subgraph(weighted, inside), "district_edges"))
