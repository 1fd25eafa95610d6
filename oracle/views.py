"""Common table expressions shared by the expected-result SQL."""

from __future__ import annotations

import re

from kerbline.operators.model import FEATURE_GROUPS
from kerbline.sources.demo import COEFFICIENTS, INTERCEPT

FEATURES = [c for cols in FEATURE_GROUPS.values() for c in cols]


def hav(a: str, b: str, c: str, d: str) -> str:
    """Haversine metres between (a, b) and (c, d), each (lat, lon)."""
    s1 = f"sin(radians({c} - {a}) / 2)"
    s2 = f"sin(radians({d} - {b}) / 2)"
    root = f"({s1} * {s1} + cos(radians({a})) * cos(radians({c})) * {s2} * {s2})"
    return f"12742000.0::DOUBLE * CASE WHEN {root} <= 1 THEN asin(sqrt({root})) WHEN {root} > 1 AND NOT isnan({root}) THEN pi() / 2 END"


def near(left: str, lat: str, lon: str, right: str, cell: float, metres: float, keep: str, rid: str) -> str:
    """Pairs of ``left`` and ``right`` rows within ``metres``, on square degree cells."""
    return f"""
      SELECT {keep}, r.{rid} AS target_id, {hav('l.' + lat, 'l.' + lon, 'r.lat', 'r.lon')} AS d
      FROM (SELECT *, floor({lat} / {cell}::DOUBLE)::BIGINT + dy AS cy, floor({lon} / {cell}::DOUBLE)::BIGINT + dx AS cx
            FROM {left}, (VALUES (-1), (0), (1)) a(dy), (VALUES (-1), (0), (1)) b(dx)
            WHERE {lat} IS NOT NULL AND {lon} IS NOT NULL) l
      JOIN (SELECT *, floor(lat / {cell}::DOUBLE)::BIGINT AS cy, floor(lon / {cell}::DOUBLE)::BIGINT AS cx FROM {right}) r
      USING (cy, cx)
      WHERE {hav('l.' + lat, 'l.' + lon, 'r.lat', 'r.lon')} <= {metres}"""


def first_hit(pairs: str, key: str) -> str:
    return f"SELECT * FROM ({pairs}) QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY d, target_id) = 1"


def _eta() -> str:
    terms = [f"{INTERCEPT!r}::DOUBLE"]
    for c in COEFFICIENTS:
        table = ("x", "h1", "h2")[c.hop]
        terms.append(f"{c.w!r}::DOUBLE * {table}.{c.feature}")
    return " + ".join(terms)


def _sum_hop(source: str) -> str:
    cols = ", ".join(f"sum(l.raw * v.{c}) / sum(l.raw) AS {c}" for c in FEATURES)
    return f"SELECT l.dst AS segment_id, {cols} FROM looped l JOIN {source} v ON v.segment_id = l.src GROUP BY l.dst"


VIEWS: dict[str, str] = {
    "raw_seg": """
      SELECT p, gy, blk, off, north, lat, lon,
        lat + ((p * 13) % 7) * 0.00001::DOUBLE AS lat0, lon AS lon0,
        lat + (CASE WHEN north THEN 0.01::DOUBLE ELSE 0.0::DOUBLE END) AS lat1,
        lon + (CASE WHEN north THEN 0.0::DOUBLE ELSE 0.01::DOUBLE END) AS lon1,
        lat + (CASE WHEN north THEN 0.005::DOUBLE ELSE 0.001::DOUBLE END) AS latb,
        lon + (CASE WHEN north THEN 0.001::DOUBLE ELSE 0.005::DOUBLE END) AS lonb,
        CASE WHEN p % 11 = 0 THEN NULL WHEN p % 17 = 0 THEN 0.0 ELSE p_retailprice END::DOUBLE AS aadt
      FROM (SELECT *, 34.30::DOUBLE + 0.01::DOUBLE * gy + off AS lat,
                   -81.0::DOUBLE + 0.01::DOUBLE * (p % 50) + 0.6::DOUBLE * blk AS lon
            FROM (SELECT p_partkey AS p, p_retailprice, (p_partkey // 50) % 2000 AS gy, (p_partkey // 100000) % 400 AS blk,
                         p_partkey % 3 = 0 AS north,
                         CASE WHEN p_partkey % 7 = 0 THEN 0.004::DOUBLE ELSE 0.0::DOUBLE END AS off
                  FROM part))""",
    # A line with one vertex is no segment.
    "segments": """
      SELECT p::VARCHAR AS segment_id, 'R' || gy AS route_id, CASE WHEN aadt > 0 THEN aadt END AS aadt_raw,
        lon0 AS start_lon, lat0 AS start_lat, lon1 AS end_lon, lat1 AS end_lat,
        (lon0 + lonb + lon1) / 3 AS mid_lon, (lat0 + latb + lat1) / 3 AS mid_lat, latb, lonb
      FROM raw_seg WHERE len(CASE WHEN p % 97 = 0 THEN [lat0] ELSE [lat0, latb, lat1] END) >= 2""",
    "vertices": """
      SELECT segment_id, start_lat AS lat, start_lon AS lon FROM segments
      UNION ALL SELECT segment_id, latb, lonb FROM segments
      UNION ALL SELECT segment_id, end_lat, end_lon FROM segments""",
    "raw_roads": """
      SELECT c_custkey AS road_id,
        34.30::DOUBLE + 0.01::DOUBLE * ((c_custkey // 50) % 2000) + 0.0001::DOUBLE * ((c_custkey * 17) % 50) AS lat,
        -81.0::DOUBLE + 0.01::DOUBLE * (c_custkey % 50) + 0.6::DOUBLE * ((c_custkey // 100000) % 400) + 0.0001::DOUBLE * ((c_custkey * 29) % 50) AS lon,
        (CASE WHEN c_custkey % 4 = 0 THEN 0 ELSE 25 + 5 * (c_custkey % 8) END)::DOUBLE AS SpeedLimit,
        (CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE 30 + 5 * (c_custkey % 7) END)::DOUBLE AS DesignSpd,
        (CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE 1 + c_custkey % 6 END)::DOUBLE AS ThruLaneCount,
        CASE WHEN c_custkey % 9 <> 0 THEN (1 + c_custkey % 8)::INTEGER END AS FuncClass,
        lpad(c_nationkey::VARCHAR, 3, '0') AS MaintCntyCode,
        CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY') THEN c_mktsegment END AS UrbanType,
        CASE WHEN c_custkey % 6 = 1 THEN '' WHEN c_custkey % 6 <> 0 THEN 'Street ' || (c_custkey % 100) END AS StreetName,
        CASE WHEN c_custkey % 10 <> 0 THEN 'SR-' || (c_custkey % 40) END AS RouteName
      FROM customer""",
    "roads": """
      SELECT r.* REPLACE (nullif(SpeedLimit, 0) AS SpeedLimit, nullif(DesignSpd, 0) AS DesignSpd),
        n_name AS county,
        CASE FuncClass WHEN 1 THEN 'Interstate' WHEN 2 THEN 'Other Freeway/Expressway' WHEN 3 THEN 'Other Principal Arterial'
          WHEN 4 THEN 'Minor Arterial' WHEN 5 THEN 'Major Collector' WHEN 6 THEN 'Minor Collector' WHEN 7 THEN 'Local' END AS FuncClassLabel
      FROM raw_roads r LEFT JOIN nation ON lpad(n_nationkey::VARCHAR, 3, '0') = MaintCntyCode""",
    "raw_incidents": """
      SELECT o_orderkey AS inc_id,
        CASE WHEN o_orderkey % 41 <> 0 THEN 34.30::DOUBLE + 0.01::DOUBLE * ((o_orderkey // 375) % 2000) + 0.00001::DOUBLE * ((o_orderkey * 37) % 1000) END AS lat,
        CASE WHEN o_orderkey % 41 <> 0 THEN -81.0::DOUBLE + 0.01::DOUBLE * (o_custkey % 50) + 0.6::DOUBLE * ((o_orderkey // 750000) % 400) + 0.00001::DOUBLE * ((o_orderkey * 53) % 1000) END AS lon,
        year(o_orderdate)::INTEGER AS year, 'NATION_' || (o_custkey % 25) AS county
      FROM orders""",
    "incidents": "SELECT * FROM raw_incidents WHERE lat IS NOT NULL AND lon IS NOT NULL",
    "stations": """
      SELECT CASE WHEN s % 2 = 0 THEN 'fire' ELSE 'ems' END AS station_type, s_name AS name,
        upper(n_name[1]) || lower(n_name[2:]) AS county,
        CASE WHEN s % 2 = 0 THEN 'Road ' || s WHEN s_acctbal > 0 THEN 'Base ' || s END AS address,
        CASE WHEN s % 2 = 1 THEN 'City' END AS city, lat, lon,
        CASE WHEN s % 2 = 0 THEN s::VARCHAR END AS FD_ID, CASE WHEN s % 2 = 1 THEN s::VARCHAR END AS fips, s AS station_id
      FROM (SELECT s_suppkey AS s, s_name, s_acctbal, n_name,
              34.30::DOUBLE + 0.01::DOUBLE * (((s_suppkey * 2) // 5) % 2000) + 0.0005::DOUBLE AS lat,
              -81.0::DOUBLE + 0.01::DOUBLE * ((s_suppkey * 7) % 50) + 0.6::DOUBLE * ((((s_suppkey * 2) // 5) // 2000) % 400) + 0.0005::DOUBLE AS lon
            FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "general_crashes": """
      SELECT n_name AS county, year(l_shipdate)::INTEGER AS year, l_shipdate AS crash_date, l_returnflag AS severity,
        CASE WHEN l_quantity > 45 THEN 'Y' WHEN l_quantity > 5 THEN 'N' END AS ped_involved,
        CASE WHEN l_quantity < 3 THEN 'Y' WHEN l_quantity < 40 THEN 'N' END AS bike_involved
      FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
    "overlay": """
      SELECT event_id, ts, user_id AS incident_id, event_type, value, 'NATION_' || (user_id % 25) AS county FROM events""",
    "latest": """
      SELECT * FROM overlay QUALIFY row_number() OVER (PARTITION BY incident_id ORDER BY ts DESC, event_id DESC) = 1""",
    "road_hit": first_hit(
        near("segments", "mid_lat", "mid_lon", "roads", 0.06, 5000.0, "l.segment_id", "road_id"), "segment_id"
    ),
    "road_attrs": """
      SELECT s.segment_id, r.county, CASE WHEN h.d IS NOT NULL THEN r.UrbanType IS NULL END AS rural_flag,
        coalesce(nullif(r.StreetName, ''), nullif(r.RouteName, ''), 'Route ' || s.route_id) || ' (' || r.county || ')' AS segment_name,
        CASE WHEN h.d <= 500 THEN nullif(r.SpeedLimit, 0) END AS speed_limit_mph,
        CASE WHEN h.d <= 500 THEN nullif(r.ThruLaneCount, 0) END AS lane_count,
        CASE WHEN h.d <= 500 THEN r.FuncClass::DOUBLE END AS road_classification,
        h.d AS isrn_join_distance_m
      FROM segments s LEFT JOIN road_hit h USING (segment_id) LEFT JOIN roads r ON r.road_id = h.target_id""",
    "incident_hit": first_hit(
        near("raw_incidents", "lat", "lon", "vertices", 0.0025, 200.0, "l.inc_id", "segment_id"), "inc_id"
    ),
    "incident_n": """
      SELECT s.segment_id, count(h.inc_id) AS pedcyclist_incident_count_5yr
      FROM segments s LEFT JOIN incident_hit h ON h.target_id = s.segment_id GROUP BY s.segment_id""",
    "facilities": "SELECT DISTINCT target_id AS node FROM ("
    + first_hit(near("stations", "lat", "lon", "vertices", 0.025, 2000.0, "l.station_id", "segment_id"), "station_id")
    + ")",
    "ends": """
      SELECT segment_id, start_lat AS lat, start_lon AS lon FROM segments
      UNION SELECT segment_id, end_lat, end_lon FROM segments""",
    "adjacency": "SELECT DISTINCT src, target_id AS dst FROM ("
    + near("ends", "lat", "lon", "ends", 0.0007, 50.0, "l.segment_id AS src", "segment_id")
    + ") WHERE src <> target_id",
    "weights": f"""
      SELECT src, dst, {hav('a.mid_lat', 'a.mid_lon', 'b.mid_lat', 'b.mid_lon')} AS weight_m
      FROM adjacency JOIN segments a ON a.segment_id = src JOIN segments b ON b.segment_id = dst""",
    "ems": """
      SELECT node, min(dist) AS dist_m FROM (
        WITH RECURSIVE reach(node, dist, hops) AS (
          SELECT node, 0.0::DOUBLE, 0 FROM facilities
          UNION SELECT w.dst, r.dist + w.weight_m, r.hops + 1 FROM reach r JOIN weights w ON w.src = r.node WHERE r.hops < 12)
        SELECT * FROM reach) GROUP BY node""",
    "crash_totals": "SELECT county, count(*) AS n FROM general_crashes GROUP BY county",
    "features": """
      SELECT s.segment_id, a.segment_name, a.county, a.rural_flag, cc.code AS county_code,
        a.speed_limit_mph, a.lane_count, a.road_classification, s.aadt_raw,
        (s.aadt_raw - t.lo) / (t.hi - t.lo) AS aadt_normalized,
        i.pedcyclist_incident_count_5yr, coalesce(ct.n, 0) AS general_crash_count_5yr_county, e.dist_m AS ems_distance_m,
        s.start_lat, s.start_lon, s.end_lat, s.end_lon, s.mid_lat, s.mid_lon, a.isrn_join_distance_m
      FROM segments s JOIN road_attrs a USING (segment_id) JOIN incident_n i USING (segment_id)
      LEFT JOIN ems e ON e.node = s.segment_id LEFT JOIN crash_totals ct ON ct.county = a.county
      JOIN (SELECT county, (row_number() OVER (ORDER BY min(segment_id)) - 1)::DOUBLE AS code
            FROM road_attrs WHERE county IS NOT NULL GROUP BY county) cc ON cc.county = a.county,
      (SELECT min(aadt_raw) AS lo, max(aadt_raw) AS hi FROM segments) t
      WHERE a.county IS NOT NULL""",
    "edges": "SELECT w.* FROM weights w SEMI JOIN features a ON a.segment_id = w.src SEMI JOIN features b ON b.segment_id = w.dst",
    "looped": "SELECT src, dst, 1.0::DOUBLE AS raw FROM edges UNION ALL SELECT segment_id, segment_id, 2.0::DOUBLE FROM features",
    "degrees": """
      SELECT f.segment_id, count(e.dst) AS degree FROM features f LEFT JOIN edges e ON e.src = f.segment_id GROUP BY f.segment_id""",
    "x": "SELECT segment_id, "
    + ", ".join(f"coalesce({c}::DOUBLE, avg({c}::DOUBLE) OVER (), 0.0::DOUBLE) AS {c}" for c in FEATURES)
    + " FROM (SELECT * REPLACE (rural_flag::INTEGER AS rural_flag) FROM features)",
    "h1": _sum_hop("x"),
    "h2": _sum_hop("h1"),
    "scored": f"""
      SELECT segment_id, eta, exp(eta) AS risk_score
      FROM (SELECT x.segment_id, {_eta()} AS eta FROM x JOIN h1 USING (segment_id) JOIN h2 USING (segment_id))""",
    "flags": """
      SELECT f.segment_id, speed_limit_mph IS NULL OR lane_count IS NULL OR ems_distance_m IS NULL OR t.n < 15 AS data_density_flag
      FROM features f JOIN (SELECT county, sum(pedcyclist_incident_count_5yr) AS n FROM features GROUP BY county) t USING (county)""",
    "scores": """
      SELECT *, CASE WHEN ems_norm IS NULL THEN risk_norm ELSE risk_norm * (1 + ems_norm) END AS risk_exposure
      FROM (
        SELECT f.*, s.eta, s.risk_score, g.data_density_flag, f.ems_distance_m IS NOT NULL AS ems_distance_available,
          (s.risk_score - m.rlo) / (m.rhi - m.rlo) AS risk_norm, (f.ems_distance_m - m.elo) / (m.ehi - m.elo) AS ems_norm
        FROM features f JOIN scored s USING (segment_id) JOIN flags g USING (segment_id),
          (SELECT min(risk_score) AS rlo, max(risk_score) AS rhi, min(ems_distance_m) AS elo, max(ems_distance_m) AS ehi
           FROM scored JOIN features USING (segment_id)) m)""",
    "top": """
      SELECT *, (row_number() OVER (ORDER BY risk_exposure DESC, segment_id))::INTEGER AS rank FROM scores
      QUALIFY row_number() OVER (ORDER BY risk_exposure DESC, segment_id) <= 25""",
}


def with_views(body: str) -> str:
    """Prefix ``body`` with the views it uses, in order, each computed once."""
    known = list(VIEWS)

    def used(sql: str) -> set[str]:
        return {v for v in known if re.search(rf"\b(FROM|JOIN|,)\s*{v}\b", sql)}

    need, todo = set(), used(body)
    while todo:
        need |= todo
        todo = set().union(*(used(VIEWS[v]) for v in todo)) - need
    ctes = ",\n".join(f"{v} AS MATERIALIZED ({VIEWS[v]})" for v in known if v in need)
    return f"WITH {ctes}\n{body}" if ctes else body
