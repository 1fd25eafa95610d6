"""Expected result of each query as one SQL statement."""

from __future__ import annotations

from kerbline.operators import contract
from kerbline.operators.explain import NO_RULE, RULES
from kerbline.operators.model import FEATURE_GROUPS
from kerbline.operators.whatif import INTERVENTIONS
from kerbline.sources.demo import BBOX, COEFFICIENT_SETS, COEFFICIENTS, YEARS

from oracle.views import FEATURES, hav, with_views


def _rounded(*cols: str, digits: int = 6) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in cols)


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


BUCKET = "((((segment_id::BIGINT % 1000003) * 7919 + 42) % 1000003) % 1000)"
SPLIT = f"CASE WHEN {BUCKET} < 700 THEN 'train' WHEN {BUCKET} < 850 THEN 'val' ELSE 'test' END"

MEASURES = """count(*) AS n_segments, round(avg(risk_exposure), 6) AS mean_risk_exposure,
  round(quantile_cont(risk_exposure, 0.5), 6) AS median_risk_exposure,
  round(quantile_cont(risk_exposure, 0.9), 6) AS p90_risk_exposure, round(avg(risk_score), 6) AS mean_risk_score,
  round(100.0 * avg(ems_distance_available::INTEGER), 6) AS pct_ems_distance_available,
  round(100.0 * avg(data_density_flag::INTEGER), 6) AS pct_low_confidence"""


# --- attribution --------------------------------------------------------------

def _attribution(base: str, coefs=COEFFICIENTS) -> str:
    """Rows of every segment and feature; ``base`` is the value compared with."""
    by: dict[str, list] = {}
    for c in coefs:
        by.setdefault(c.feature, []).append(c)
    group = {c: g for g, cols in FEATURE_GROUPS.items() for c in cols}
    passed = ("1.0::DOUBLE", "b.back_1", "b.back_2")
    parts = []
    for f, cs in by.items():
        own = " + ".join(f"{c.w!r}::DOUBLE * {passed[c.hop]}" for c in cs)
        ref = "0.0::DOUBLE" if base == "zero" else f"avg(x.{f}) OVER ()"
        parts.append(
            f"SELECT x.segment_id, '{f}' AS feature_name, '{group[f]}' AS modality, x.{f} AS value, "
            f"({own}) * (x.{f} - {ref}) AS contribution FROM x JOIN back b USING (segment_id)"
        )
    return f"""
      WITH back AS (
        SELECT d.segment_id, 2.0::DOUBLE / (d.degree + 2) AS back_1,
          pow(2.0::DOUBLE / (d.degree + 2), 2) + coalesce(sum(1.0::DOUBLE / (n.degree + 2)), 0) / (d.degree + 2) AS back_2
        FROM degrees d LEFT JOIN edges e ON e.src = d.segment_id LEFT JOIN degrees n ON n.segment_id = e.dst
        GROUP BY d.segment_id, d.degree),
      parts AS ({' UNION ALL '.join(parts)})
      SELECT *, CASE WHEN sum(abs(contribution)) OVER (PARTITION BY segment_id) > 0
        THEN abs(contribution) / sum(abs(contribution)) OVER (PARTITION BY segment_id) ELSE 0.0 END AS importance
      FROM parts"""


def _topk(base: str = "zero", k: int = 6, coefs=COEFFICIENTS) -> str:
    return f"""
      SELECT segment_id, (row_number() OVER w)::INTEGER AS feature_rank, feature_name,
        round(importance, 4) AS importance, round(value, 4) AS value, modality
      FROM ({_attribution(base, coefs)})
      WINDOW w AS (PARTITION BY segment_id ORDER BY round(importance, 12) DESC, feature_name)
      QUALIFY row_number() OVER w <= {k}"""


def _countermeasures() -> str:
    rules = ", ".join(
        f"({i}, {_lit(r.feature_contains)}, {_lit(r.op)}, {r.threshold}::DOUBLE, {_lit(r.category)}, {_lit(r.fhwa_reference)}, {_lit(r.rationale)})"
        for i, r in enumerate(RULES)
    )
    none = ", ".join(_lit(s) for s in NO_RULE)
    return f"""
      WITH rules(rule_order, needle, op, threshold, category, fhwa_reference, rationale) AS (VALUES {rules}),
      top6 AS ({_topk()}),
      hits AS (
        SELECT t.segment_id, t.feature_rank, r.category, r.fhwa_reference, r.rationale
        FROM top6 t JOIN rules r ON contains(lower(t.feature_name), r.needle)
          AND CASE r.op WHEN '>=' THEN t.value >= r.threshold WHEN '<' THEN t.value < r.threshold ELSE t.value > r.threshold END
        QUALIFY row_number() OVER (PARTITION BY t.segment_id, r.category ORDER BY t.feature_rank) = 1),
      ranked AS (
        SELECT segment_id, (row_number() OVER (PARTITION BY segment_id ORDER BY feature_rank))::INTEGER AS suggestion_rank,
          category, fhwa_reference, rationale
        FROM hits)
      SELECT * FROM ranked WHERE suggestion_rank <= 3
      UNION ALL
      SELECT segment_id, 1, {none} FROM features WHERE segment_id NOT IN (SELECT segment_id FROM hits)"""


def _counterfactual() -> str:
    speed = [c for c in COEFFICIENTS if c.feature == "speed_limit_mph"]
    gain = " + ".join(f"{c.w!r}::DOUBLE * u{c.hop}" for c in speed)
    effects = " UNION ALL ".join(
        f"SELECT {_lit(i.key)} AS intervention, {_lit(i.label)} AS label, m.target, m.node, m.hop, s.eta, "
        f"s.eta + ({i.set_value}::DOUBLE - x.speed_limit_mph) * ({gain}) AS eta2 "
        "FROM moved m JOIN x ON x.segment_id = m.target JOIN scored s ON s.segment_id = m.node"
        for i in INTERVENTIONS
        if i.feature_contains == "speed_limit"
    )
    return f"""
      WITH a AS (SELECT l.src, l.dst, l.raw / (d.degree + 2) AS w FROM looped l JOIN degrees d ON d.segment_id = l.dst),
      c1 AS (SELECT t.segment_id AS target, a.dst AS node, a.w AS u FROM top t JOIN a ON a.src = t.segment_id),
      c2 AS (SELECT c1.target, a.dst AS node, sum(c1.u * a.w) AS u FROM c1 JOIN a ON a.src = c1.node GROUP BY ALL),
      moved AS (
        SELECT c2.target, c2.node, (c2.target = c2.node)::INTEGER::DOUBLE AS u0, coalesce(c1.u, 0.0) AS u1, c2.u AS u2,
          CASE WHEN c2.target = c2.node THEN 0 WHEN c1.u IS NOT NULL THEN 1 ELSE 2 END AS hop
        FROM c2 LEFT JOIN c1 USING (target, node)),
      result AS ({effects})
      SELECT target AS segment_id, intervention, label, node AS affected_id, hop, round(exp(eta), 4) AS baseline_risk_score,
        round(exp(eta2), 4) AS updated_risk_score, round(exp(eta2) - exp(eta), 4) + 0.0 AS delta
      FROM result"""


def _not_applied() -> str:
    names = [f for f in FEATURES]
    missed = [i for i in INTERVENTIONS if not any(i.feature_contains in f for f in names)]
    rows = ", ".join(
        f"({_lit(i.key)}, {_lit(f'No feature matching {chr(39)}{i.feature_contains}{chr(39)} found for this segment — intervention not simulated.')})"
        for i in missed
    )
    return f"SELECT segment_id, intervention, false AS applied, reason FROM top, (VALUES {rows}) v(intervention, reason)"


# --- contract -----------------------------------------------------------------

def _json_type(path: str) -> str:
    return (
        f"CASE json_type(record, {path}) WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' "
        f"WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE CASE WHEN json_type(record, {path}) IS NOT NULL THEN 'number' END END"
    )


def _check(prefix: str, path: str, key: str, want: str, required: bool = True, boolean_ok: bool = False) -> str:
    t = _json_type(path)
    missing = f"WHEN ({t}) IS NULL THEN {prefix} || '.{key}: missing' " if required else ""
    wrong = f"({t}) <> '{want}'" + (f" AND ({t}) <> 'boolean'" if boolean_ok else "")
    return f"CASE {missing}WHEN {wrong} THEN {prefix} || '.{key}: expected {want}, got ' || ({t}) END"


def _contract() -> str:
    top = [_check("'top-level'", f"'$.{k}'", k, t, boolean_ok=t == "number") for k, t in contract.TOP_LEVEL.items()]
    nested = [_check("'meta'", f"'$.meta.{k}'", k, t) for k, t in contract.META.items()]
    nested += [_check("'meta'", f"'$.meta.{k}'", k, t, required=False) for k, t in contract.META_OPTIONAL.items()]
    nested += [_check("'segment'", f"'$.segment.{k}'", k, t) for k, t in contract.SEGMENT.items()]
    for i in (0, 1):
        where = f"'top_features[{i}]'"
        kind = _json_type(f"'$.top_features[{i}]'")
        nested.append(f"CASE WHEN ({kind}) <> 'object' THEN {where} || ': expected object, got ' || ({kind}) END")
        nested += [
            f"CASE WHEN ({kind}) = 'object' THEN {_check(where, f'{chr(39)}$.top_features[{i}].{k}{chr(39)}', k, t)} END"
            for k, t in contract.TOP_FEATURE.items()
        ]
    return f"""
      WITH records AS (
        SELECT p_partkey::VARCHAR AS segment_id, '{{"meta":'
          || CASE WHEN k = 8 THEN '[1]' ELSE '{{"district":"D"' || CASE WHEN k = 6 THEN '' ELSE ',"timestamp":"t"' END
             || ',"model_checkpoint":"m"' || CASE WHEN k = 9 THEN ',"model_checkpoint_sha256":7' ELSE '' END || '}}' END
          || ',"segment":{{"segment_id":"' || p_partkey || '","segment_name":"' || p_name || '","county":"' || p_brand
          || '","rural_flag":' || CASE WHEN k = 2 THEN 'null' ELSE 'false' END || ',"risk_score":'
          || CASE WHEN k = 4 THEN '"high"' WHEN k = 5 THEN 'true' ELSE p_partkey::VARCHAR END || ',"risk_exposure_score":0.5}}'
          || CASE WHEN k = 3 THEN '' ELSE ',"top_features":[{{"feature_name":"speed_limit_mph","importance":0.5,"value":45,"modality":"infrastructure"}},'
             || CASE WHEN k = 9 THEN '3' ELSE '{{"feature_name":"aadt_normalized","importance":0.25,"value":' || CASE WHEN k = 6 THEN '"x"' ELSE '0.7' END || '}}' END || ']' END
          || ',"data_density_flag":true,"explanation_confidence":' || CASE WHEN k = 7 THEN 'true' ELSE '0.8' END || '}}' AS record
        FROM (SELECT *, p_partkey % 10 AS k FROM part)),
      checked AS (
        SELECT segment_id, list_filter([{', '.join(top)}], lambda s: s IS NOT NULL) AS top,
          list_filter([{', '.join(nested)}], lambda s: s IS NOT NULL) AS nested
        FROM records)
      SELECT segment_id, len(top) = 0 AND len(nested) = 0 AS is_valid,
        array_to_string(CASE WHEN len(top) > 0 THEN top ELSE nested END, '; ') AS problems
      FROM checked"""


# --- all queries --------------------------------------------------------------

_YEARS = ", ".join(str(y) for y in YEARS)
_FEATURE_TABLE = """
  SELECT segment_id, segment_name, county, rural_flag, county_code, speed_limit_mph, lane_count, road_classification, aadt_raw,
    round(aadt_normalized, 6) AS aadt_normalized, pedcyclist_incident_count_5yr, general_crash_count_5yr_county,
    round(ems_distance_m, 3) AS ems_distance_m, {coords}, round(isrn_join_distance_m, 3) AS isrn_join_distance_m
  FROM features""".format(coords=_rounded("start_lat", "start_lon", "end_lat", "end_lon", "mid_lat", "mid_lon"))

_BODIES: dict[str, str] = {
    "src_filter_in": f"""SELECT o_orderkey, o_custkey, o_totalprice FROM orders
      WHERE o_orderstatus IN ('F', 'O') AND year(o_orderdate) IN ({_YEARS})""",
    "bbox_filter": f"""SELECT road_id, {_rounded('lat', 'lon')} FROM raw_roads
      WHERE lat BETWEEN {BBOX['min_lat']} AND {BBOX['max_lat']} AND lon BETWEEN {BBOX['min_lon']} AND {BBOX['max_lon']}""",
    "raw_flatten": """
      SELECT p::VARCHAR AS "TSegID2025", 'R' || gy AS "RouteID", aadt AS "AADT",
        round(list_sum(xs) / len(xs), 6) AS _lon, round(list_sum(ys) / len(ys), 6) AS _lat
      FROM (SELECT *, (CASE WHEN p % 97 = 0 THEN [lon0] ELSE [lon0, lonb, lon1] END) || (CASE WHEN p % 5 = 0 THEN [lon1, lon1 + 0.002::DOUBLE] ELSE [] END) AS xs,
                      (CASE WHEN p % 97 = 0 THEN [lat0] ELSE [lat0, latb, lat1] END) || (CASE WHEN p % 5 = 0 THEN [lat1, lat1] ELSE [] END) AS ys
            FROM raw_seg)""",
    "raw_pages": """
      SELECT p::VARCHAR AS "TSegID2025", 'R' || gy AS "RouteID", aadt AS "AADT",
        round(list_sum(xs) / len(xs), 6) AS _lon, round(list_sum(ys) / len(ys), 6) AS _lat
      FROM (SELECT *, (CASE WHEN p % 97 = 0 THEN [lon0] ELSE [lon0, lonb, lon1] END) || (CASE WHEN p % 5 = 0 THEN [lon1, lon1 + 0.002::DOUBLE] ELSE [] END) AS xs,
                      (CASE WHEN p % 97 = 0 THEN [lat0] ELSE [lat0, latb, lat1] END) || (CASE WHEN p % 5 = 0 THEN [lat1, lat1] ELSE [] END) AS ys
            FROM raw_seg)""",
    "topn_reused": "SELECT rank, segment_id FROM top",
    "polyline_midpoint": """
      SELECT p::VARCHAR AS segment_id, round(list_sum(xs) / len(xs), 6) AS lon, round(list_sum(ys) / len(ys), 6) AS lat
      FROM (SELECT *, (CASE WHEN p % 97 = 0 THEN [lon0] ELSE [lon0, lonb, lon1] END) || (CASE WHEN p % 5 = 0 THEN [lon1, lon1 + 0.002::DOUBLE] ELSE [] END) AS xs,
                      (CASE WHEN p % 97 = 0 THEN [lat0] ELSE [lat0, latb, lat1] END) || (CASE WHEN p % 5 = 0 THEN [lat1, lat1] ELSE [] END) AS ys
            FROM raw_seg)""",
    "segment_geometry": f"""SELECT segment_id, {_rounded('start_lon', 'start_lat', 'end_lon', 'end_lat', 'mid_lon', 'mid_lat')},
      3 AS n_vertices FROM segments""",
    "stations_union": f"""SELECT station_type, name, county, address, city, {_rounded('lat', 'lon')}, "FD_ID", fips FROM stations""",
    "osm_ways": """
      SELECT c_custkey AS osm_id, lower(c_mktsegment) AS highway, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS name,
        CASE WHEN c_custkey % 4 <> 0 THEN (25 + 5 * (c_custkey % 8)) || ' mph' END AS maxspeed,
        CASE WHEN c_custkey % 5 <> 0 THEN (1 + c_custkey % 6)::VARCHAR END AS lanes,
        NULL::VARCHAR AS sidewalk, NULL::VARCHAR AS cycleway, round(lat, 6) AS lat, round(lon, 6) AS lon
      FROM customer JOIN raw_roads ON road_id = c_custkey""",
    "csv_round_trip": """SELECT road_id, county, StreetName AS "StreetName", SpeedLimit AS "SpeedLimit", FuncClass AS "FuncClass" FROM roads""",
    "records_json": """SELECT road_id, county, SpeedLimit AS "SpeedLimit", UrbanType AS "UrbanType", 4 AS n_keys FROM roads""",
    "haversine": f"""SELECT segment_id, round({hav('start_lat', 'start_lon', 'end_lat', 'end_lon')}, 3) AS length_m FROM segments""",
    "haversine_missing": f"""SELECT road_id, CASE WHEN road_id % 7 <> 0 AND road_id % 11 <> 0
      THEN round({hav('lat', 'lon', BBOX['min_lat'], BBOX['min_lon'])}, 3) END AS distance_m FROM raw_roads""",
    "sentinel_to_null": """SELECT road_id, nullif(SpeedLimit, 0) AS "SpeedLimit", nullif(DesignSpd, 0) AS "DesignSpd",
      nullif(ThruLaneCount, 0) AS "ThruLaneCount" FROM raw_roads""",
    "aadt_clean": "SELECT p::VARCHAR AS segment_id, CASE WHEN aadt > 0 THEN aadt END AS aadt FROM raw_seg",
    "epoch_ms": """
      SELECT l_orderkey, l_linenumber AS line, CASE WHEN l_linenumber < 6 THEN year(l_shipdate)::INTEGER END AS year,
        CASE WHEN l_linenumber < 6 THEN floor(epoch(l_shipdate))::BIGINT END AS seconds FROM lineitem""",
    "code_labels": """SELECT road_id, MaintCntyCode AS "MaintCntyCode", county, FuncClass AS "FuncClass", FuncClassLabel AS "FuncClassLabel" FROM roads""",
    "flag_fill": """SELECT county, coalesce(ped_involved, 'N') AS ped_involved, coalesce(bike_involved, 'N') AS bike_involved, count(*) AS n
      FROM general_crashes GROUP BY ALL""",
    "drop_no_coords": """SELECT count(*) FILTER (lat IS NOT NULL AND lon IS NOT NULL) AS kept,
      count(*) FILTER (lat IS NULL OR lon IS NULL) AS dropped FROM raw_incidents""",
    "minmax_norm": """SELECT segment_id, round((aadt_raw - min(aadt_raw) OVER ()) / (max(aadt_raw) OVER () - min(aadt_raw) OVER ()), 6) AS aadt_normalized
      FROM segments""",
    "log_offset": "SELECT segment_id, round(ln(greatest(coalesce(aadt_raw, 1.0), 1.0)), 6) AS log_offset FROM segments",
    "hash_split": f"SELECT segment_id, {SPLIT} AS split FROM segments",
    "road_attr_join": """SELECT segment_id, county, rural_flag, speed_limit_mph, lane_count, road_classification,
      round(isrn_join_distance_m, 3) AS isrn_join_distance_m FROM road_attrs""",
    "segment_name": "SELECT segment_id, segment_name FROM road_attrs",
    "nearest_segment": """SELECT i.inc_id, h.target_id AS segment_id, round(h.d, 3) AS distance_m
      FROM raw_incidents i LEFT JOIN incident_hit h USING (inc_id)""",
    "incident_counts": "SELECT * FROM incident_n",
    "unmatched_incidents": "SELECT inc_id, year FROM raw_incidents ANTI JOIN incident_hit USING (inc_id)",
    "facility_segments": "SELECT node FROM facilities",
    "adjacency_proximity": "SELECT src, dst FROM adjacency",
    "adjacency_exact": """
      WITH e AS (SELECT p_partkey::VARCHAR AS segment_id, CASE WHEN p_partkey % 7 = 0 THEN 'b' ELSE 'a' END || k AS junction
                 FROM part, unnest([p_partkey, p_partkey + CASE WHEN p_partkey % 3 = 0 THEN 50 ELSE 1 END]) u(k))
      SELECT DISTINCT a.segment_id AS src, b.segment_id AS dst FROM e a JOIN e b USING (junction) WHERE a.segment_id <> b.segment_id""",
    "feature_table": _FEATURE_TABLE,
    "county_code": "SELECT DISTINCT county, county_code FROM features",
    "county_crash_broadcast": "SELECT segment_id, county, general_crash_count_5yr_county FROM features",
    "edge_weights": "SELECT src, dst, round(weight_m, 3) AS weight_m FROM weights",
    "ems_distance": "SELECT node AS segment_id, round(dist_m, 3) AS ems_distance_m FROM ems",
    "induced_subgraph": "SELECT src, dst FROM edges",
    "row_norm_adj": "SELECT l.src, l.dst, round(l.raw / (d.degree + 2), 6) AS weight FROM looped l JOIN degrees d ON d.segment_id = l.src",
    "graph_diffusion_k1": f"SELECT segment_id, {_rounded(*FEATURES)} FROM h1",
    "graph_diffusion_k2": f"SELECT segment_id, {_rounded(*FEATURES)} FROM h2",
    "graph_diffusion_places": f"SELECT segment_id, {_rounded(*FEATURES)} FROM h1",
    "graph_diffusion_places_k2": f"SELECT segment_id, {_rounded(*FEATURES)} FROM h2",
    "khop_neighbors": """
      WITH two AS (SELECT DISTINCT a.src AS target, b.dst AS node FROM edges a JOIN edges b ON b.src = a.dst WHERE a.src <> b.dst)
      SELECT src AS target, dst AS node, 1 AS hop FROM edges
      UNION ALL SELECT target, node, 2 FROM two ANTI JOIN edges e ON e.src = two.target AND e.dst = two.node""",
    "assembly_report": """
      SELECT count(*) AS n_segments, count(DISTINCT county) AS n_counties, count(*) FILTER (rural_flag) AS n_rural,
        round(100.0 * avg(rural_flag::INTEGER), 2) AS rural_pct,
        round(100.0 * avg((speed_limit_mph IS NULL)::INTEGER), 2) AS missing_speed_limit_mph_pct,
        round(100.0 * avg((lane_count IS NULL)::INTEGER), 2) AS missing_lane_count_pct,
        round(100.0 * avg((aadt_raw IS NULL)::INTEGER), 2) AS missing_aadt_raw_pct,
        round(100.0 * avg((ems_distance_m IS NULL)::INTEGER), 2) AS missing_ems_distance_m_pct,
        sum(pedcyclist_incident_count_5yr)::BIGINT AS n_incidents,
        count(*) FILTER (pedcyclist_incident_count_5yr > 0) AS n_segments_hit,
        round(100.0 * avg((pedcyclist_incident_count_5yr > 0)::INTEGER), 2) AS segments_hit_pct,
        (SELECT count(*) FROM edges) AS n_edges
      FROM features""",
    "data_density_flag": "SELECT segment_id, data_density_flag FROM flags",
    "target_summary": """
      SELECT count(*) AS n_segments, round(100.0 * avg((pedcyclist_incident_count_5yr = 0)::INTEGER), 6) AS pct_zero_incidents,
        round(avg(pedcyclist_incident_count_5yr), 6) AS mean_incidents, max(pedcyclist_incident_count_5yr)::DOUBLE AS max_incidents,
        count(DISTINCT county) AS n_counties FROM features""",
    "profile_value_counts": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c}::VARCHAR AS value, count(*) AS n FROM general_crashes WHERE {c} IS NOT NULL GROUP BY {c}"
        for c in ("county", "year", "severity", "ped_involved")
    ),
    "profile_value_counts_with_null": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM roads GROUP BY {c}" for c in ("FuncClassLabel", "UrbanType")
    ),
    "profile_missing": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, round(100.0 * avg(({c} IS NULL)::INTEGER), 2) AS missing_pct FROM roads"
        for c in ("SpeedLimit", "DesignSpd", "FuncClass", "FuncClassLabel", "UrbanType", "StreetName", "RouteName")
    ),
    "profile_range": """SELECT round(min(aadt_raw), 6) AS min_value, round(median(aadt_raw), 6) AS median_value,
      round(max(aadt_raw), 6) AS max_value FROM segments""",
    "profile_date_range": """SELECT strftime(min(crash_date), '%Y-%m-%d') AS first_date, strftime(max(crash_date), '%Y-%m-%d') AS last_date
      FROM general_crashes""",
    "station_crosstab": """SELECT county, count(*) FILTER (station_type = 'fire') AS fire, count(*) FILTER (station_type = 'ems') AS ems
      FROM stations GROUP BY county""",
    "involvement_counts": """SELECT county, count(*) AS n_crashes, count(*) FILTER (ped_involved = 'Y') AS n_ped,
      count(*) FILTER (bike_involved = 'Y') AS n_bike FROM general_crashes GROUP BY county""",
    "source_crosscheck": """
      SELECT county, coalesce(a.n, 0) AS count_a, coalesce(b.n, 0) AS count_b,
        CASE WHEN b.n > 0 THEN round(100.0::DOUBLE * (coalesce(a.n, 0) - b.n) / b.n, 2) END AS divergence_pct
      FROM (SELECT county, count(*) AS n FROM general_crashes WHERE ped_involved = 'Y' OR bike_involved = 'Y' GROUP BY county) a
      FULL JOIN (SELECT county, count(*) AS n FROM incidents GROUP BY county) b USING (county)""",
    "mean_impute": f"SELECT segment_id, {_rounded(*FEATURES)} FROM x",
    "zscore_train": "WITH fit AS (SELECT "
    + ", ".join(
        f"avg({c}) FILTER ({BUCKET} < 700) AS m_{c}, stddev_pop({c}) FILTER ({BUCKET} < 700) AS s_{c}"
        for c in ("speed_limit_mph", "lane_count", "aadt_normalized")
    )
    + " FROM x) SELECT segment_id, "
    + ", ".join(
        f"round(({c} - m_{c}) / CASE WHEN s_{c} >= 1e-6 THEN s_{c} ELSE 1 END, 6) + 0.0 AS {c}"
        for c in ("speed_limit_mph", "lane_count", "aadt_normalized")
    )
    + " FROM x, fit",
    "score_with_coefs": f"SELECT segment_id, {_rounded('eta', 'risk_score')} FROM scored",
    "poisson_nll": f"""
      SELECT split, count(*) AS n, round(avg(exp(ll) - k * ll), 4) AS nll
      FROM (SELECT {SPLIT} AS split, pedcyclist_incident_count_5yr AS k,
              ln(risk_score + 1e-6) + ln(greatest(coalesce(aadt_raw, 1.0), 1.0)) AS ll FROM scores)
      GROUP BY split""",
    "poisson_fit_balance": """SELECT sum(pedcyclist_incident_count_5yr)::BIGINT AS observed,
      round(sum(pedcyclist_incident_count_5yr)::DOUBLE, 1) AS fitted FROM features""",
    "risk_exposure": f"SELECT segment_id, ems_distance_available, {_rounded('risk_norm', 'ems_norm', 'risk_exposure')} FROM scores",
    "risk_exposure_w0": f"""SELECT segment_id, ems_distance_available, {_rounded('risk_norm', 'ems_norm')},
      round(risk_norm, 6) AS risk_exposure FROM scores""",
    "score_summary": """
      SELECT count(*) AS n_segments, round(avg(risk_score), 6) AS mean_risk_score, round(avg(risk_exposure), 6) AS mean_risk_exposure,
        round(100.0 * avg(data_density_flag::INTEGER), 6) AS pct_low_confidence,
        round(100.0 * avg(ems_distance_available::INTEGER), 6) AS pct_ems_distance_available FROM scores""",
    "disparity_by_county": f"SELECT county, {MEASURES} FROM scores GROUP BY county",
    "disparity_by_rural": f"SELECT rural_flag, {MEASURES} FROM scores GROUP BY rural_flag",
    "disparity_by_county_rural": f"SELECT county, rural_flag, {MEASURES} FROM scores GROUP BY county, rural_flag",
    "disparity_grouping_sets": f"""
      SELECT CASE WHEN grouping(rural_flag) = 1 THEN 'county' WHEN grouping(county) = 1 THEN 'rural_flag' ELSE 'county_rural_flag' END AS cut,
        county, rural_flag, {MEASURES}
      FROM scores GROUP BY GROUPING SETS ((county), (rural_flag), (county, rural_flag))""",
    "disparity_gap": """
      SELECT round(avg(risk_exposure) FILTER (rural_flag) / nullif(avg(risk_exposure) FILTER (NOT rural_flag), 0), 6) AS rural_vs_suburban_exposure_ratio,
        round(100.0 * avg(data_density_flag::INTEGER) FILTER (rural_flag) - 100.0 * avg(data_density_flag::INTEGER) FILTER (NOT rural_flag), 6)
          AS rural_vs_suburban_confidence_gap_pct
      FROM scores""",
    "disparity_pivot": """SELECT county, round(avg(risk_exposure) FILTER (rural_flag), 6) AS rural,
      round(avg(risk_exposure) FILTER (NOT rural_flag), 6) AS suburban FROM scores GROUP BY county""",
    "quantile_stops": """
      WITH s AS (SELECT risk_exposure AS v, row_number() OVER (ORDER BY risk_exposure) - 1 AS i, count(*) OVER () AS n FROM scores)
      SELECT position, stop, round(v, 6) AS value
      FROM (VALUES (0, 'p0', 0.0), (1, 'p50', 0.5), (2, 'p75', 0.75), (3, 'p90', 0.9), (4, 'p99', 0.99), (5, 'max', 1.0)) t(position, stop, p)
      JOIN s ON i = least(n - 1, floor(n * p::DOUBLE)::BIGINT)""",
    "priority_topn": """
      SELECT rank, CASE WHEN rank <= 3 THEN 'Critical' WHEN rank <= 10 THEN 'High' ELSE 'Elevated' END AS tier,
        segment_id, segment_name, county, rural_flag, round(risk_exposure, 6) AS risk_exposure FROM top""",
    "attribution": f"""SELECT segment_id, feature_name, modality, round(value, 6) AS value, round(contribution, 6) + 0.0 AS contribution,
      round(importance, 6) AS importance FROM ({_attribution('zero')})""",
    "attribution_places": f"""SELECT segment_id, feature_name, modality, round(value, 6) AS value, round(contribution, 6) + 0.0 AS contribution,
      round(importance, 6) AS importance FROM ({_attribution('zero')})""",
    "topk_features": _topk(),
    "explanation_confidence_stored": f"""
      SELECT a.segment_id, round(avg(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s)))), 6) AS explanation_confidence
      FROM (SELECT segment_id, list(feature_name) AS s FROM ({_topk('zero', 4)}) GROUP BY segment_id) a
      JOIN ({" UNION ALL ".join(f"SELECT segment_id, list(feature_name) AS s FROM ({_topk('zero', 4, coefs)}) GROUP BY segment_id" for coefs in COEFFICIENT_SETS)}) b
      USING (segment_id) GROUP BY a.segment_id""",
    "topk_jaccard": f"""
      SELECT a.segment_id, round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard
      FROM (SELECT segment_id, list(feature_name) AS s FROM ({_topk('zero', 4)}) GROUP BY segment_id) a
      JOIN (SELECT segment_id, list(feature_name) AS s FROM ({_topk('mean', 4)}) GROUP BY segment_id) b USING (segment_id)""",
    "countermeasures": _countermeasures(),
    "counterfactual": _counterfactual(),
    "counterfactual_not_applied": _not_applied(),
    "whatif_neighbor_mean": f"""SELECT segment_id, intervention, count(*) AS n_neighbors, round(avg(delta), 5) + 0.0 AS mean_delta
      FROM ({_counterfactual()}) WHERE hop = 1 GROUP BY segment_id, intervention""",
    "priority_list_rows": f"""
      SELECT t.rank, t.segment_id, round(t.risk_score, 4) AS risk_score, round(t.risk_exposure, 4) AS risk_exposure_score,
        t.data_density_flag, f.feature_names, c.suggestion_rank, c.category
      FROM top t JOIN (SELECT segment_id, string_agg(feature_name, ',' ORDER BY feature_rank) AS feature_names FROM ({_topk()}) GROUP BY segment_id) f
        USING (segment_id) JOIN ({_countermeasures()}) c USING (segment_id)""",
    "contract_check": _contract(),
    "contract_check_own": "SELECT segment_id, true AS is_valid, '' AS problems FROM scores",
    "explanation_records_own": f"""
      SELECT segment_id, coalesce(segment_name, '') AS segment_name, coalesce(rural_flag, false) AS rural_flag,
        round(risk_score, 6) AS risk_score, round(risk_exposure, 6) AS risk_exposure_score, data_density_flag, f.feature_names
      FROM scores JOIN (SELECT segment_id, string_agg(feature_name, ',' ORDER BY feature_rank) AS feature_names FROM ({_topk()}) GROUP BY segment_id) f
        USING (segment_id)""",
    "poisson_score_equations": f"""
      SELECT feature, observed, true AS balanced
      FROM (SELECT sum(pedcyclist_incident_count_5yr)::DOUBLE AS observed FROM features),
        (SELECT unnest({['(intercept)'] + [c + h for h in ('', '_h1', '_h2') for c in FEATURES if c != 'pedcyclist_incident_count_5yr']}) AS feature)""",
    "priority_list_fitted": """
      SELECT rank, CASE WHEN rank <= 3 THEN 'Critical' WHEN rank <= 10 THEN 'High' ELSE 'Elevated' END AS tier,
        true AS county_is_known, 6 AS n_features, true AS has_measures, true AS has_confidence
      FROM (SELECT unnest(range(1, 1 + least(25, (SELECT count(*) FROM features)))) AS rank)""",
    "geojson_round_trip": """
      SELECT segment_id, 'Feature' AS feature_type, 'LineString' AS geometry_type, round(start_lon, 6) AS lon0, round(start_lat, 6) AS lat0,
        round(end_lon, 6) AS lon1, round(end_lat, 6) AS lat1, round(risk_exposure, 6) AS risk_exposure, ems_distance_available FROM scores""",
    "geojson_collection": """
      SELECT segment_id, 'Feature' AS feature_type, 'LineString' AS geometry_type, round(start_lon, 6) AS lon0, round(start_lat, 6) AS lat0,
        round(end_lon, 6) AS lon1, round(end_lat, 6) AS lat1, round(risk_exposure, 6) AS risk_exposure, ems_distance_available FROM scores""",
    "export_meta": "SELECT count(*) AS n_segments FROM scores",
    "overlay_snapshot": "SELECT incident_id, event_id, event_type, value, county FROM latest",
    "overlay_counts": "SELECT county, event_type, count(*) AS n FROM latest GROUP BY county, event_type",
    "overlay_stream": "SELECT incident_id, event_id, event_type, value, county FROM latest",
    "overlay_active": """SELECT incident_id, event_id, event_type, value, county FROM latest
      WHERE floor(epoch(ts)) + floor(value) * 3600 > (SELECT epoch(max(ts)) FROM overlay)""",
    "overlay_pulls": """SELECT incident_id, event_id, event_type, value, county FROM latest
      WHERE ts::DATE = (SELECT max(ts)::DATE FROM overlay)""",
    "overlay_redelivered": "SELECT incident_id, event_id, event_type, value, county FROM latest",
}


def _merge(body: str) -> str:
    """Put the shared views in front of a body that may have a WITH of its own."""
    text = body.strip()
    full = with_views(text)
    if full.startswith("WITH") and text.startswith("WITH") and full != text:
        shared = full[: -len(text)].rstrip()
        return shared + ",\n" + text[len("WITH") :].lstrip()
    return full


EXPECTED: dict[str, str] = {name: _merge(body) for name, body in _BODIES.items()}
