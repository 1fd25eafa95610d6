"""Road-domain views over the supplied star-schema tables.

The tables have no coordinates, so positions are computed from their keys on a
0.01 degree lattice. Every row of a table appears in its view.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions import scalar
from kerbline.operators.model import Coefficient
from kerbline.session import durable
from kerbline.sources import features as src
from kerbline.sources import stations as st

# Fixed values of the example model: (hop, feature, weight) and intercept.
INTERCEPT = -2.0
COEFFICIENTS = (
    Coefficient(0, "speed_limit_mph", 0.03),
    Coefficient(1, "speed_limit_mph", 0.02),
    Coefficient(2, "speed_limit_mph", 0.01),
    Coefficient(0, "lane_count", 0.12),
    Coefficient(1, "lane_count", 0.05),
    Coefficient(0, "road_classification", -0.06),
    Coefficient(0, "aadt_normalized", 0.9),
    Coefficient(1, "aadt_normalized", 0.3),
    Coefficient(2, "aadt_normalized", -0.1),
    Coefficient(0, "pedcyclist_incident_count_5yr", 0.08),
    Coefficient(1, "pedcyclist_incident_count_5yr", 0.04),
    Coefficient(0, "general_crash_count_5yr_county", 0.00001),
    Coefficient(0, "rural_flag", -0.25),
    Coefficient(2, "rural_flag", -0.05),
    Coefficient(0, "county_code", 0.01),
    Coefficient(0, "ems_distance_m", 0.0001),
)
# Five sets near these weights: each weight is scaled by 0.2, 0.6, 1, 1.4 or 1.8.
COEFFICIENT_SETS = [
    [c._replace(w=c.w * (1 + 0.4 * ((7 * place + 3 * run) % 5 - 2))) for place, c in enumerate(COEFFICIENTS)]
    for run in range(1, 6)
]
BBOX = {"min_lon": -80.9, "min_lat": 34.32, "max_lon": -80.55, "max_lat": 38.0}
YEARS = (1996, 1997, 1998, 1999, 2000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lattice(key: Column, per_row: int, rows: int = 2000) -> tuple[Column, Column]:
    """Lattice row and block (rows beyond ``rows`` continue in a block to the east)."""
    def div(a: Column, b: int) -> Column:
        return F.floor(a / b)

    return F.pmod(div(key, per_row), F.lit(rows)), F.pmod(div(key, per_row * rows), F.lit(400))


def raw_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as landed line features ``{attributes, geometry}``.

    Every seventh line lies off the lattice, every 97th has a single vertex and
    every fifth has a second path.
    """
    p = F.col("p_partkey")
    gy, blk = _lattice(p, 50)
    gx = F.pmod(p, F.lit(50))
    off = F.when(p % 7 == 0, F.lit(0.004)).otherwise(F.lit(0.0))
    north = p % 3 == 0
    lat = F.lit(34.30) + F.lit(0.01) * gy + off
    lon = F.lit(-81.0) + F.lit(0.01) * gx + F.lit(0.6) * blk
    lat0 = lat + F.pmod(p * 13, F.lit(7)) * F.lit(0.00001)
    lat1 = lat + F.when(north, F.lit(0.01)).otherwise(F.lit(0.0))
    lon1 = lon + F.when(north, F.lit(0.0)).otherwise(F.lit(0.01))
    latb = lat + F.when(north, F.lit(0.005)).otherwise(F.lit(0.001))
    lonb = lon + F.when(north, F.lit(0.001)).otherwise(F.lit(0.005))
    start, bend, end = F.array(lon, lat0), F.array(lonb, latb), F.array(lon1, lat1)
    main = F.when(p % 97 == 0, F.array(start)).otherwise(F.array(start, bend, end))
    side = F.array(end, F.array(lon1 + F.lit(0.002), lat1))
    aadt = F.when(p % 11 == 0, F.lit(None)).when(p % 17 == 0, F.lit(0.0)).otherwise(F.col("p_retailprice"))
    # A file of few row groups is few tasks, and so would be every table written from it.
    # Ranges keep neighbours together.
    return table(spark, sf_dir, "part").repartitionByRange("p_partkey").select(
        F.struct(
            p.cast("string").alias("TSegID2025"),
            F.concat(F.lit("R"), gy.cast("string")).alias("RouteID"),
            aadt.cast("double").alias("AADT"),
        ).alias("attributes"),
        F.struct(
            F.lit(None).cast("double").alias("x"),
            F.lit(None).cast("double").alias("y"),
            F.when(p % 5 == 0, F.array(main, side)).otherwise(F.array(main)).alias("paths"),
        ).alias("geometry"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.segment_geometry(
        raw_segments(spark, sf_dir),
        {
            "segment_id": F.col("attributes.TSegID2025"),
            "route_id": F.col("attributes.RouteID"),
            "aadt_raw": scalar.nonpositive_to_null(F.col("attributes.AADT")),
        },
    )


def raw_roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as road points with coded county and 0 for unknown numbers."""
    k = F.col("c_custkey")
    gy, blk = _lattice(k, 50)
    return table(spark, sf_dir, "customer").select(
        k.alias("road_id"),
        (F.lit(34.30) + F.lit(0.01) * gy + F.lit(0.0001) * F.pmod(k * 17, F.lit(50))).alias("lat"),
        (
            F.lit(-81.0)
            + F.lit(0.01) * F.pmod(k, F.lit(50))
            + F.lit(0.6) * blk
            + F.lit(0.0001) * F.pmod(k * 29, F.lit(50))
        ).alias("lon"),
        F.when(k % 4 == 0, F.lit(0)).otherwise(25 + 5 * (k % 8)).cast("double").alias("SpeedLimit"),
        F.when(k % 3 == 0, F.lit(0)).otherwise(30 + 5 * (k % 7)).cast("double").alias("DesignSpd"),
        F.when(k % 5 == 0, F.lit(0)).otherwise(1 + k % 6).cast("double").alias("ThruLaneCount"),
        F.when(k % 9 != 0, (1 + k % 8).cast("int")).alias("FuncClass"),
        F.lpad(F.col("c_nationkey").cast("string"), 3, "0").alias("MaintCntyCode"),
        F.when(~F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.col("c_mktsegment")).alias("UrbanType"),
        F.when(k % 6 == 1, F.lit(""))
        .when(k % 6 != 0, F.concat(F.lit("Street "), (k % 100).cast("string")))
        .alias("StreetName"),
        F.when(k % 10 != 0, F.concat(F.lit("SR-"), (k % 40).cast("string"))).alias("RouteName"),
    )


def counties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.lpad(F.col("n_nationkey").cast("string"), 3, "0").alias("MaintCntyCode"), F.col("n_name").alias("county")
    )


def roads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned road points: county names, class labels, 0 mph as missing."""
    raw = raw_roads(spark, sf_dir)
    return raw.join(counties(spark, sf_dir), "MaintCntyCode", "left").withColumns(
        {
            "SpeedLimit": scalar.zero_to_null(F.col("SpeedLimit")),
            "DesignSpd": scalar.zero_to_null(F.col("DesignSpd")),
            "FuncClassLabel": scalar.label_of(F.col("FuncClass"), scalar.FUNC_CLASS_LABELS),
        }
    )


def raw_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as incident points; every 41st has no coordinates."""
    o = F.col("o_orderkey")
    gy, blk = _lattice(o, 375)
    lat = F.lit(34.30) + F.lit(0.01) * gy + F.lit(0.00001) * F.pmod(o * 37, F.lit(1000))
    lon = (
        F.lit(-81.0)
        + F.lit(0.01) * F.pmod(F.col("o_custkey"), F.lit(50))
        + F.lit(0.6) * blk
        + F.lit(0.00001) * F.pmod(o * 53, F.lit(1000))
    )
    return table(spark, sf_dir, "orders").select(
        o.alias("inc_id"),
        F.when(o % 41 != 0, lat).alias("lat"),
        F.when(o % 41 != 0, lon).alias("lon"),
        F.year("o_orderdate").alias("year"),
        F.concat(F.lit("NATION_"), (F.col("o_custkey") % 25).cast("string")).alias("county"),
    )


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.drop_without_coordinates(raw_incidents(spark, sf_dir))


def _station_point(s: Column) -> tuple[Column, Column]:
    row = F.floor(s * 2 / 5)
    lat = F.lit(34.30) + F.lit(0.01) * F.pmod(row, F.lit(2000)) + F.lit(0.0005)
    blk = F.pmod(F.floor(row / 2000), F.lit(400))
    lon = F.lit(-81.0) + F.lit(0.01) * F.pmod(s * 7, F.lit(50)) + F.lit(0.6) * blk + F.lit(0.0005)
    return lat, lon


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier`` as two station layers (even and odd keys), united."""
    s = F.col("s_suppkey")
    lat, lon = _station_point(s)
    base = (
        table(spark, sf_dir, "supplier")
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select("s_suppkey", "s_name", "s_acctbal", "n_name", lat.alias("y"), lon.alias("x"))
    )
    fire = base.where(s % 2 == 0).select(
        F.col("s_name").alias("DEPT_NAME"),
        scalar.title_case(F.col("n_name")).alias("COUNTY"),
        F.concat(F.lit("Road "), s.cast("string")).alias("STATION_ADDRESS"),
        F.col("y").alias("LATITUDE"),
        F.col("x").alias("LONGITUDE"),
        s.cast("string").alias("FD_ID"),
    )
    ems = base.where(s % 2 == 1).select(
        F.col("s_name").alias("name"),
        F.col("n_name").alias("county"),
        F.when(F.col("s_acctbal") > 0, F.concat(F.lit("Base "), s.cast("string"))).alias("address"),
        F.lit("City").alias("city"),
        F.col("y").alias("_lat"),
        F.col("x").alias("_lon"),
        s.cast("string").alias("fips"),
    )
    return st.stations_union(st.fire_stations(fire), st.ems_stations(ems))


def general_crashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as crashes without geometry, county from the supplier's nation."""
    li = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity")
    return (
        li.join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("county"),
            F.year("l_shipdate").alias("year"),
            F.col("l_shipdate").alias("crash_date"),
            F.col("l_returnflag").alias("severity"),
            F.when(q > 45, "Y").when(q > 5, "N").alias("ped_involved"),
            F.when(q < 3, "Y").when(q < 40, "N").alias("bike_involved"),
        )
    )


def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as live incident records, keyed by ``user_id``."""
    return table(spark, sf_dir, "events").select(
        "event_id",
        "ts",
        F.col("user_id").alias("incident_id"),
        "event_type",
        "value",
        F.concat(F.lit("NATION_"), (F.col("user_id") % 25).cast("string")).alias("county"),
    )


class Stages:
    """Stage tables of one data folder, each built once and handed on as a written table."""

    _known: dict[tuple[str, str], "Stages"] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, object] = {}

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> "Stages":
        key = (spark.sparkContext.applicationId, sf_dir)
        return cls._known.setdefault(key, cls(spark, sf_dir))

    def _once(self, name, build):
        if name not in self._made:
            self._made[name] = build()
        return self._made[name]

    @property
    def segments(self) -> DataFrame:
        return self._once("segments", lambda: durable(segments(self.spark, self.sf_dir), "segments"))

    @property
    def assembled(self):
        from kerbline.plans.assemble import assemble

        return self._once(
            "assembled",
            lambda: assemble(
                segments(self.spark, self.sf_dir),
                roads(self.spark, self.sf_dir),
                incidents(self.spark, self.sf_dir),
                general_crashes(self.spark, self.sf_dir),
                stations(self.spark, self.sf_dir),
            ),
        )

    @property
    def features(self) -> DataFrame:
        return self.assembled.features

    @property
    def edges(self) -> DataFrame:
        return self.assembled.edges

    @property
    def scores(self) -> DataFrame:
        from kerbline.plans.publish import score_segments

        return self._once(
            "scores",
            lambda: durable(score_segments(self.features, self.edges, INTERCEPT, COEFFICIENTS), "scores"),
        )
