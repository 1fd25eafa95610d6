"""Named queries over a folder of the supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbline.functions import geo, scalar
from kerbline.operators import bootstrap, contract, disparity, explain, graph, model, profile, risk, routing, stats, whatif
from kerbline.operators.spatial import nearest_join
from kerbline.plans import assemble, publish
from kerbline.session import durable, new_path
from kerbline.sources import demo, geojson, osm, sinks
from kerbline.sources import features as src
from kerbline.streaming import overlay as live

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _r(name: str, digits: int = 6, out: str | None = None) -> Column:
    return F.round(name, digits).alias(out or name)


def _nodes(features: DataFrame) -> DataFrame:
    return features.select(F.col("segment_id").alias("node"))


def _bucket() -> Column:
    return stats.integer_bucket(F.col("segment_id").cast("long"))


# --- sources ------------------------------------------------------------------


@query
def src_filter_in(spark, sf):
    orders = demo.table(spark, sf, "orders")
    return src.source_filter(
        orders, {"o_orderstatus": ["F", "O"]}, ["o_orderkey", "o_custkey", "o_totalprice"], ("o_orderdate", demo.YEARS)
    )


@query
def bbox_filter(spark, sf):
    return src.bbox_filter(demo.raw_roads(spark, sf), demo.BBOX).select("road_id", _r("lat"), _r("lon"))


@query
def raw_flatten(spark, sf):
    text = demo.raw_segments(spark, sf).select(F.to_json(F.struct("attributes", "geometry")).alias("j"))
    schema = src.record_schema("TSegID2025 string, RouteID string, AADT double")
    parsed = text.select(F.from_json("j", schema).alias("r")).select("r.*")
    return src.flatten(parsed).select("TSegID2025", "RouteID", "AADT", _r("_lon"), _r("_lat"))


@query
def raw_pages(spark, sf):
    """The same from landed files: one file per page, each a JSON array of 500 records."""
    path = new_path(spark, "pages")
    records = demo.raw_segments(spark, sf).select(
        F.floor(F.col("attributes.TSegID2025").cast("long") / 500).alias("page"),
        F.to_json(F.struct("attributes", "geometry")).alias("j"),
    )
    pages = records.groupBy("page").agg(F.concat(F.lit("["), F.concat_ws(",", F.collect_list("j")), F.lit("]")).alias("text"))
    pages.write.partitionBy("page").text(path)
    landed = src.read_pages(spark, path, "TSegID2025 string, RouteID string, AADT double")
    return src.flatten(landed).select("TSegID2025", "RouteID", "AADT", _r("_lon"), _r("_lat"))


@query
def topn_reused(spark, sf):
    """The stored top list is built once and read the second time."""
    path = new_path(spark, "stored_top")
    scores = demo.Stages.of(spark, sf).scores
    build = lambda: risk.priority_topn(scores).select("rank", "segment_id")
    n = sinks.reuse_or_build(spark, path, 25, build).count()
    return sinks.reuse_or_build(spark, path, n, lambda: build().limit(0)).select("rank", "segment_id")


@query
def polyline_midpoint(spark, sf):
    raw = demo.raw_segments(spark, sf).select(
        F.col("attributes.TSegID2025").alias("segment_id"), geo.polyline_midpoint(F.col("geometry.paths")).alias("m")
    )
    return raw.select("segment_id", _r("m.lon", out="lon"), _r("m.lat", out="lat"))


@query
def segment_geometry(spark, sf):
    cols = ("start_lon", "start_lat", "end_lon", "end_lat", "mid_lon", "mid_lat")
    return demo.segments(spark, sf).select("segment_id", *[_r(c) for c in cols], F.size("vertices").alias("n_vertices"))


@query
def stations_union(spark, sf):
    return demo.stations(spark, sf).select(
        "station_type", "name", "county", "address", "city", _r("lat"), _r("lon"), "FD_ID", "fips"
    )


@query
def osm_ways(spark, sf):
    """``customer`` as tagged map ways, flattened."""
    k = F.col("c_custkey")
    tags = F.map_filter(
        F.create_map(
            F.lit("highway"), F.lower("c_mktsegment"),
            F.lit("name"), F.when(k % 3 != 0, F.col("c_name")),
            F.lit("maxspeed"), F.when(k % 4 != 0, F.concat((25 + 5 * (k % 8)).cast("string"), F.lit(" mph"))),
            F.lit("lanes"), F.when(k % 5 != 0, (1 + k % 6).cast("string")),
            F.lit("surface"), F.lit("asphalt"),
        ),
        lambda _, v: v.isNotNull(),
    )
    roads = demo.raw_roads(spark, sf).select(F.col("road_id").alias("c_custkey"), "lat", "lon")
    ways = demo.table(spark, sf, "customer").join(roads, "c_custkey").select(
        k.alias("id"), tags.alias("tags"), F.struct("lat", "lon").alias("center")
    )
    return osm.flatten_ways(ways).withColumns({"lat": F.round("lat", 6), "lon": F.round("lon", 6)})


@query
def csv_round_trip(spark, sf):
    """Flat table written as CSV and read back with its schema."""
    flat = demo.roads(spark, sf).select("road_id", "county", "StreetName", "SpeedLimit", "FuncClass")
    path = new_path(spark, "roads_csv")
    sinks.write_csv(flat, path)
    return sinks.read_csv(spark, path, flat.schema)


@query
def records_json(spark, sf):
    """Record export read back: missing values are present as JSON null."""
    rows = demo.roads(spark, sf).select("road_id", "county", "SpeedLimit", "UrbanType")
    path = new_path(spark, "records")
    sinks.write_records(rows, path)
    text = spark.read.text(path)
    keys = F.json_object_keys("value")
    parsed = F.from_json("value", rows.schema)
    return text.select(parsed.alias("r"), F.size(keys).alias("n_keys")).select("r.*", "n_keys")


# --- cleaning -------------------------------------------------------------------


@query
def haversine(spark, sf):
    d = geo.haversine_m(F.col("start_lat"), F.col("start_lon"), F.col("end_lat"), F.col("end_lon"))
    return demo.segments(spark, sf).select("segment_id", F.round(d, 3).alias("length_m"))


@query
def haversine_missing(spark, sf):
    """Distances of road points whose coordinates are partly missing or not a number: null."""
    number = F.col("road_id")
    lat = F.when(F.pmod(number, F.lit(7)) != 0, F.col("lat"))
    lon = F.when(F.pmod(number, F.lit(11)) == 0, F.lit(float("nan"))).otherwise(F.col("lon"))
    d = geo.haversine_m(lat, lon, F.lit(demo.BBOX["min_lat"]), F.lit(demo.BBOX["min_lon"]))
    return demo.raw_roads(spark, sf).select("road_id", F.round(d, 3).alias("distance_m"))


@query
def sentinel_to_null(spark, sf):
    return demo.raw_roads(spark, sf).select(
        "road_id",
        *[scalar.zero_to_null(F.col(c)).alias(c) for c in ("SpeedLimit", "DesignSpd", "ThruLaneCount")],
    )


@query
def aadt_clean(spark, sf):
    return demo.raw_segments(spark, sf).select(
        F.col("attributes.TSegID2025").alias("segment_id"),
        scalar.nonpositive_to_null(F.col("attributes.AADT")).alias("aadt"),
    )


@query
def epoch_ms(spark, sf):
    line = F.col("l_linenumber")
    ms = F.unix_millis(F.col("l_shipdate").cast("timestamp"))
    landed = F.when(line == 7, F.lit("n/a")).when(line != 6, ms.cast("string"))
    parsed = demo.table(spark, sf, "lineitem").select(
        "l_orderkey", line.alias("line"), scalar.epoch_ms(landed).alias("t")
    )
    return parsed.select("l_orderkey", "line", F.year("t").alias("year"), F.unix_seconds("t").alias("seconds"))


@query
def code_labels(spark, sf):
    return demo.roads(spark, sf).select("road_id", "MaintCntyCode", "county", "FuncClass", "FuncClassLabel")


@query
def flag_fill(spark, sf):
    flags = ("ped_involved", "bike_involved")
    filled = demo.general_crashes(spark, sf).withColumns({c: scalar.flag_or_no(F.col(c)) for c in flags})
    return filled.groupBy("county", *flags).agg(F.count("*").alias("n"))


@query
def drop_no_coords(spark, sf):
    return src.dropped_count(demo.raw_incidents(spark, sf))


@query
def minmax_norm(spark, sf):
    scaled = stats.minmax(demo.Stages.of(spark, sf).segments, {"aadt_raw": "aadt_normalized"})
    return scaled.select("segment_id", _r("aadt_normalized"))


@query
def log_offset(spark, sf):
    return demo.segments(spark, sf).select(
        "segment_id", F.round(scalar.log_exposure(F.col("aadt_raw")), 6).alias("log_offset")
    )


@query
def hash_split(spark, sf):
    return demo.segments(spark, sf).select(
        "segment_id", stats.hash_split(F.col("segment_id"), bucket=_bucket()).alias("split")
    )


# --- spatial joins --------------------------------------------------------------


@query
def road_attr_join(spark, sf):
    st = demo.Stages.of(spark, sf)
    return assemble.road_attributes(st.segments, demo.roads(spark, sf)).select(
        "segment_id",
        "county",
        "rural_flag",
        "speed_limit_mph",
        "lane_count",
        "road_classification",
        _r("isrn_join_distance_m", 3),
    )


@query
def segment_name(spark, sf):
    st = demo.Stages.of(spark, sf)
    return assemble.road_attributes(st.segments, demo.roads(spark, sf)).select("segment_id", "segment_name")


@query
def nearest_segment(spark, sf):
    st = demo.Stages.of(spark, sf)
    hit = nearest_join(
        demo.raw_incidents(spark, sf), src.vertices(st.segments), assemble.INCIDENT_MAX_M, "segment_id"
    )
    return hit.select("inc_id", F.col("target_id").alias("segment_id"), _r("distance_m", 3))


@query
def incident_counts(spark, sf):
    return assemble.incident_counts(demo.Stages.of(spark, sf).segments, demo.raw_incidents(spark, sf))


@query
def unmatched_incidents(spark, sf):
    return assemble.unmatched_incidents(demo.Stages.of(spark, sf).segments, demo.raw_incidents(spark, sf)).select(
        "inc_id", "year"
    )


@query
def facility_segments(spark, sf):
    return assemble.facility_segments(demo.Stages.of(spark, sf).segments, demo.stations(spark, sf))


@query
def adjacency_proximity(spark, sf):
    return graph.adjacency_proximity(demo.Stages.of(spark, sf).segments, assemble.ADJACENCY_TOL_M)


@query
def adjacency_exact(spark, sf):
    """Shared lattice node; lines off the lattice have nodes of their own."""
    p = F.col("p_partkey")
    step = F.when(p % 3 == 0, F.lit(50)).otherwise(F.lit(1))
    side = F.when(p % 7 == 0, F.lit("b")).otherwise(F.lit("a"))
    ends = demo.table(spark, sf, "part").select(
        p.cast("string").alias("segment_id"),
        F.concat(side, p.cast("string")).alias("from_id"),
        F.concat(side, (p + step).cast("string")).alias("to_id"),
    )
    return graph.adjacency_exact(ends)


# --- assembled table and graph --------------------------------------------------


@query
def feature_table(spark, sf):
    f = demo.Stages.of(spark, sf).features
    digits = {"aadt_normalized": 6, "ems_distance_m": 3, "isrn_join_distance_m": 3}
    coords = ("start_lat", "start_lon", "end_lat", "end_lon", "mid_lat", "mid_lon")
    return f.select(*[_r(c, digits.get(c, 6)) if c in digits or c in coords else F.col(c) for c in f.columns])


@query
def county_code(spark, sf):
    return demo.Stages.of(spark, sf).features.select("county", "county_code").distinct()


@query
def county_crash_broadcast(spark, sf):
    st = demo.Stages.of(spark, sf)
    return assemble.county_crash_counts(
        st.features.select("segment_id", "county"), demo.general_crashes(spark, sf)
    )


@query
def edge_weights(spark, sf):
    st = demo.Stages.of(spark, sf)
    linked = durable(graph.adjacency_proximity(st.segments, assemble.ADJACENCY_TOL_M), "adjacency")
    return graph.edge_weights(linked, st.segments).select("src", "dst", _r("weight_m", 3))


@query
def ems_distance(spark, sf):
    """Distance from every segment, district or not, to its nearest station segment."""
    st = demo.Stages.of(spark, sf)
    linked = durable(graph.adjacency_proximity(st.segments, assemble.ADJACENCY_TOL_M), "adjacency")
    weighted = durable(graph.edge_weights(linked, st.segments), "edges")
    reach = routing.nearest_facility_distance(
        _nodes(st.segments), weighted, assemble.facility_segments(st.segments, demo.stations(spark, sf))
    )
    return reach.select(F.col("node").alias("segment_id"), _r("dist_m", 3, "ems_distance_m"))


@query
def induced_subgraph(spark, sf):
    st = demo.Stages.of(spark, sf)
    linked = durable(graph.adjacency_proximity(st.segments, assemble.ADJACENCY_TOL_M), "adjacency")
    return graph.induced_subgraph(linked, _nodes(st.features))


@query
def row_norm_adj(spark, sf):
    st = demo.Stages.of(spark, sf)
    return graph.row_norm_adjacency(_nodes(st.features), st.edges).select("src", "dst", _r("weight"))


def _diffused(spark, sf, order: int) -> DataFrame:
    st = demo.Stages.of(spark, sf)
    cols = [c for _, c in model.present_features(st.features)]
    x = durable(model.model_matrix(st.features).withColumnRenamed("segment_id", "node"), "matrix")
    hop = graph.diffuse(x, st.edges, cols, order)[-1]
    return hop.select(F.col("node").alias("segment_id"), *[_r(c) for c in cols])


@query
def graph_diffusion_k1(spark, sf):
    return _diffused(spark, sf, 1)


@query
def graph_diffusion_k2(spark, sf):
    return _diffused(spark, sf, 2)


def _at_places(spark, sf, order: int) -> DataFrame:
    st = demo.Stages.of(spark, sf)
    cols = [c for _, c in model.present_features(st.features)]
    x = durable(model.model_matrix(st.features).withColumnRenamed("segment_id", "node"), "matrix")
    places = graph.places_proximity(st.features, assemble.ADJACENCY_TOL_M)
    hop = graph.diffuse_at_places(x, places, cols, order)[-1]
    return hop.select(F.col("node").alias("segment_id"), *[_r(c) for c in cols])


@query
def graph_diffusion_places(spark, sf):
    """One hop as in ``graph_diffusion_k1``, from shared places instead of edges."""
    return _at_places(spark, sf, 1)


@query
def graph_diffusion_places_k2(spark, sf):
    """Two hops as in ``graph_diffusion_k2``, from shared places instead of edges."""
    return _at_places(spark, sf, 2)


@query
def khop_neighbors(spark, sf):
    st = demo.Stages.of(spark, sf)
    return graph.khop_neighbors(st.features.select(F.col("segment_id").alias("target")), st.edges)


@query
def assembly_report(spark, sf):
    st = demo.Stages.of(spark, sf)
    return profile.assembly_report(st.features, st.edges)


@query
def data_density_flag(spark, sf):
    return risk.data_density_flag(demo.Stages.of(spark, sf).features).select("segment_id", "data_density_flag")


@query
def target_summary(spark, sf):
    row = profile.target_summary(demo.Stages.of(spark, sf).features)
    return row.withColumns({c: F.round(c, 6) for c in ("pct_zero_incidents", "mean_incidents")})


# --- profiles -------------------------------------------------------------------


@query
def profile_value_counts(spark, sf):
    return profile.value_counts(demo.general_crashes(spark, sf), ["county", "year", "severity", "ped_involved"])


@query
def profile_value_counts_with_null(spark, sf):
    return profile.value_counts(demo.roads(spark, sf), ["FuncClassLabel", "UrbanType"], keep_null=True)


@query
def profile_missing(spark, sf):
    cols = ["SpeedLimit", "DesignSpd", "FuncClass", "FuncClassLabel", "UrbanType", "StreetName", "RouteName"]
    return profile.missing_pct(demo.roads(spark, sf), cols)


@query
def profile_range(spark, sf):
    row = profile.numeric_range(demo.segments(spark, sf), "aadt_raw")
    return row.select(*[_r(c) for c in row.columns])


@query
def profile_date_range(spark, sf):
    row = profile.date_range(demo.general_crashes(spark, sf), "crash_date")
    return row.select(*[F.date_format(c, "yyyy-MM-dd").alias(c) for c in row.columns])


@query
def station_crosstab(spark, sf):
    return profile.crosstab(demo.stations(spark, sf), "county", "station_type", ["fire", "ems"])


@query
def involvement_counts(spark, sf):
    flags = {
        "n_crashes": F.lit(True),
        "n_ped": F.col("ped_involved") == "Y",
        "n_bike": F.col("bike_involved") == "Y",
    }
    return profile.involvement_counts(demo.general_crashes(spark, sf), flags, "county")


@query
def source_crosscheck(spark, sf):
    general = demo.general_crashes(spark, sf).where((F.col("ped_involved") == "Y") | (F.col("bike_involved") == "Y"))
    return profile.source_crosscheck(general, demo.incidents(spark, sf), "county")


# --- model ----------------------------------------------------------------------


@query
def mean_impute(spark, sf):
    m = model.model_matrix(demo.Stages.of(spark, sf).features)
    return m.select("segment_id", *[_r(c) for c in m.columns if c != "segment_id"])


@query
def zscore_train(spark, sf):
    cols = ["speed_limit_mph", "lane_count", "aadt_normalized"]
    m = model.model_matrix(demo.Stages.of(spark, sf).features).select("segment_id", *cols)
    train = stats.hash_split(F.col("segment_id"), bucket=_bucket()) == "train"
    scaled = stats.apply_zscore(m, cols, stats.fit_zscore(m, cols, train))
    return scaled.select("segment_id", *[_r(c) for c in cols])


@query
def score_with_coefs(spark, sf):
    st = demo.Stages.of(spark, sf)
    wide = model.design(st.features, st.edges, 2)
    scored = model.score(wide, demo.INTERCEPT, demo.COEFFICIENTS)
    return scored.select("segment_id", _r("eta"), _r("risk_score"))


@query
def poisson_nll(spark, sf):
    st = demo.Stages.of(spark, sf)
    split = stats.hash_split(F.col("segment_id"), bucket=_bucket())
    return model.poisson_nll(st.scores, st.features, split).select("split", "n", _r("nll", 4))


def _fitted(spark, sf):
    st = demo.Stages.of(spark, sf)
    matrix = durable(model.design(st.features, st.edges, 2, include_target_history=False), "design")
    split = stats.hash_split(F.col("segment_id"))
    return st, matrix, split, model.fit_poisson(matrix, st.features, split)


@query
def poisson_fit_scores(spark, sf):
    st, matrix, split, fit = _fitted(spark, sf)
    scored = model.score_fit(matrix, fit)
    return publish.with_exposure(st.features, scored).select(
        "segment_id", "risk_score", "risk_norm", "risk_exposure", "data_density_flag", split.alias("split")
    )


@query
def poisson_fit_balance(spark, sf):
    """At the optimum the fitted counts of the training rows add up to the observed ones."""
    st, matrix, _, fit = _fitted_all(spark, sf)
    expected = F.col("risk_score") * F.exp(scalar.log_exposure(F.col("aadt_raw")))
    rows = model.score_fit(matrix, fit).join(st.features.select("segment_id", "aadt_raw", model.TARGET), "segment_id")
    return rows.agg(
        F.sum(model.TARGET).alias("observed"), F.round(F.sum(expected), 1).alias("fitted")
    )


@query
def poisson_score_equations(spark, sf):
    """One row per column of the unpenalised fit: its score equation holds."""
    st, matrix, _, fit = _fitted_all(spark, sf)
    rows = model.score_equations(matrix, st.features, fit)
    return rows.select("feature", "observed", (F.abs("imbalance") < 1e-4).alias("balanced"))


def _fitted_run(spark, sf):
    st = demo.Stages.of(spark, sf)
    path = new_path(spark, "model")
    return publish.fit_and_publish(st.features, st.edges, stats.hash_split(F.col("segment_id")), path)


@query
def priority_list_fitted(spark, sf):
    """The list of a run from the fit on, by the facts that do not depend on the fit."""
    listed = _fitted_run(spark, sf).priority
    facts = demo.Stages.of(spark, sf).features.select("segment_id", F.col("county").alias("known_county"))
    rows = listed.join(facts, "segment_id")
    return rows.select(
        "rank",
        "tier",
        F.col("county").eqNullSafe(F.col("known_county")).alias("county_is_known"),
        F.size("top_features").alias("n_features"),
        F.size("suggested_countermeasures").between(1, 3).alias("has_measures"),
        F.col("explanation_confidence").between(0.0, 1.0).alias("has_confidence"),
    )


def _fitted_all(spark, sf):
    st = demo.Stages.of(spark, sf)
    matrix = durable(model.design(st.features, st.edges, 2, include_target_history=False), "design")
    return st, matrix, None, model.fit_poisson(matrix, st.features, F.lit("train"), reg=0.0)


# --- risk and disparity ---------------------------------------------------------


def _exposure(spark, sf, w_ems: float) -> DataFrame:
    scores = demo.Stages.of(spark, sf).scores.select("segment_id", "risk_score", "ems_distance_m")
    out = risk.risk_exposure(scores, w_ems)
    return out.select("segment_id", "ems_distance_available", _r("risk_norm"), _r("ems_norm"), _r("risk_exposure"))


@query
def risk_exposure(spark, sf):
    return _exposure(spark, sf, 1.0)


@query
def risk_exposure_w0(spark, sf):
    return _exposure(spark, sf, 0.0)


@query
def score_summary(spark, sf):
    row = profile.score_summary(demo.Stages.of(spark, sf).scores)
    return row.select("n_segments", *[_r(c) for c in row.columns if c != "n_segments"])


def _rounded(df: DataFrame) -> DataFrame:
    doubles = [f.name for f in df.schema.fields if f.dataType.typeName() == "double"]
    return df.withColumns({c: F.round(c, 6) for c in doubles})


@query
def disparity_by_county(spark, sf):
    return _rounded(disparity.disparity_by_county(demo.Stages.of(spark, sf).scores))


@query
def disparity_by_rural(spark, sf):
    return _rounded(disparity.disparity_by_rural(demo.Stages.of(spark, sf).scores))


@query
def disparity_by_county_rural(spark, sf):
    return _rounded(disparity.disparity_by_county_rural(demo.Stages.of(spark, sf).scores))


@query
def disparity_grouping_sets(spark, sf):
    return _rounded(disparity.disparity_grouping_sets(demo.Stages.of(spark, sf).scores))


@query
def disparity_gap(spark, sf):
    return _rounded(disparity.disparity_gap(demo.Stages.of(spark, sf).scores))


@query
def disparity_pivot(spark, sf):
    return _rounded(disparity.disparity_pivot(demo.Stages.of(spark, sf).scores))


@query
def quantile_stops(spark, sf):
    return _rounded(disparity.quantile_stops(demo.Stages.of(spark, sf).scores))


@query
def priority_topn(spark, sf):
    top = risk.priority_topn(demo.Stages.of(spark, sf).scores)
    return top.select("rank", "tier", "segment_id", "segment_name", "county", "rural_flag", _r("risk_exposure"))


# --- explanations ---------------------------------------------------------------


def _attributed(spark, sf, base=None) -> DataFrame:
    st = demo.Stages.of(spark, sf)
    matrix = model.model_matrix(st.features)
    return explain.attribution_arrays(matrix, _nodes(st.features), st.edges, demo.COEFFICIENTS, base)


@query
def attribution(spark, sf):
    return _attributed(spark, sf).select("segment_id", F.inline_outer("parts")).select(
        "segment_id", "feature_name", "modality", _r("value"), _r("contribution"), _r("importance")
    )


@query
def attribution_places(spark, sf):
    """The same contributions, what returns through the graph taken from shared places."""
    st = demo.Stages.of(spark, sf)
    places = graph.places_proximity(st.features, assemble.ADJACENCY_TOL_M)
    rows = explain.attribution(model.model_matrix(st.features), _nodes(st.features), places, demo.COEFFICIENTS)
    return rows.select("segment_id", "feature_name", "modality", _r("value"), _r("contribution"), _r("importance"))


@query
def topk_features(spark, sf):
    return explain.topk_features(_attributed(spark, sf))


@query
def topk_jaccard(spark, sf):
    """Top-4 features measured from zero against those measured from the column mean."""
    features = demo.Stages.of(spark, sf).features
    cols = [c for _, c in model.present_features(features)]
    means = stats.fit_zscore(model.model_matrix(features), cols, F.lit(True))
    base = {c: means[f"mean_{c}"] for c in cols}
    a = explain.topk_nested(_attributed(spark, sf), 4)
    b = explain.topk_nested(_attributed(spark, sf, base), 4)
    return explain.topk_jaccard(a, b).select("segment_id", _r("jaccard"))


@query
def countermeasures(spark, sf):
    nested = explain.topk_nested(_attributed(spark, sf))
    return explain.countermeasure_rows(explain.countermeasures(nested))


@query
def counterfactual(spark, sf):
    st = demo.Stages.of(spark, sf)
    return publish.what_if(st.scores, st.features, st.edges, demo.COEFFICIENTS)


@query
def counterfactual_not_applied(spark, sf):
    st = demo.Stages.of(spark, sf)
    top = risk.priority_topn(st.scores).select(F.col("segment_id").alias("target"))
    return whatif.not_applied(top, [c for _, c in model.present_features(st.features)])


@query
def whatif_neighbor_mean(spark, sf):
    rows = whatif.neighbor_mean_delta(counterfactual(spark, sf))
    return rows.withColumn("mean_delta", F.round("mean_delta", 5))


@query
def explanation_confidence(spark, sf):
    st, matrix, split, fit = _fitted(spark, sf)
    base = durable(publish.top_of_fit(matrix, st.features, st.edges, fit, st.features), "base_top")
    return publish.explanation_confidence(st.features, st.edges, base, matrix=matrix, fit=fit, split=split)


@query
def explanation_confidence_stored(spark, sf):
    """Overlap of the top features with those under several stored sets of weights."""
    st = demo.Stages.of(spark, sf)
    path = new_path(spark, "coefficient-sets")
    bootstrap.save_coefficient_sets(spark, demo.COEFFICIENT_SETS, path)
    sets = bootstrap.load_coefficient_sets(spark, path)
    base = explain.topk_nested(_attributed(spark, sf), 4)
    matrix = model.model_matrix(st.features)
    sure = explain.topk_stability(matrix, _nodes(st.features), st.edges, base, sets, 4)
    return sure.select("segment_id", _r("explanation_confidence"))


@query
def priority_list(spark, sf):
    st = demo.Stages.of(spark, sf)
    return publish.priority_list(st.scores, st.features, st.edges, demo.COEFFICIENTS)


@query
def priority_list_rows(spark, sf):
    """The nested priority list, one row per suggestion."""
    rows = priority_list(spark, sf).select(
        "rank",
        "segment_id",
        "risk_score",
        "risk_exposure_score",
        "data_density_flag",
        F.concat_ws(",", F.col("top_features.feature_name")).alias("feature_names"),
        F.posexplode_outer("suggested_countermeasures").alias("p", "s"),
    )
    return rows.select(
        "rank", "segment_id", "risk_score", "risk_exposure_score", "data_density_flag", "feature_names",
        (F.col("p") + 1).alias("suggestion_rank"), F.col("s.category").alias("category"),
    )


def explanation_records(spark: SparkSession, sf: str) -> DataFrame:
    """One explanation record per ``part`` row as JSON text; seven in ten are damaged."""
    p = F.col("p_partkey")
    kind = p % 10
    pick = lambda k, bad, good: F.when(kind == k, F.lit(bad)).otherwise(F.lit(good))
    meta = F.when(kind == 8, F.lit("[1]")).otherwise(
        F.concat(
            F.lit('{"district":"D"'),
            pick(6, "", ',"timestamp":"t"'),
            F.lit(',"model_checkpoint":"m"'),
            pick(9, ',"model_checkpoint_sha256":7', ""),
            F.lit("}"),
        )
    )
    score = F.when(kind == 4, F.lit('"high"')).when(kind == 5, F.lit("true")).otherwise(p.cast("string"))
    segment = F.concat(
        F.lit('{"segment_id":"'), p.cast("string"), F.lit('","segment_name":"'), F.col("p_name"),
        F.lit('","county":"'), F.col("p_brand"), F.lit('","rural_flag":'), pick(2, "null", "false"),
        F.lit(',"risk_score":'), score, F.lit(',"risk_exposure_score":0.5}'),
    )
    feats = F.concat(
        F.lit('[{"feature_name":"speed_limit_mph","importance":0.5,"value":45,"modality":"infrastructure"},'),
        F.when(kind == 9, F.lit("3")).otherwise(
            F.concat(F.lit('{"feature_name":"aadt_normalized","importance":0.25,"value":'), pick(6, '"x"', "0.7"), F.lit("}"))
        ),
        F.lit("]"),
    )
    text = F.concat(
        F.lit('{"meta":'), meta, F.lit(',"segment":'), segment,
        F.when(kind == 3, F.lit("")).otherwise(F.concat(F.lit(',"top_features":'), feats)),
        F.lit(',"data_density_flag":true,"explanation_confidence":'), pick(7, "true", "0.8"), F.lit("}"),
    )
    return demo.table(spark, sf, "part").select(p.cast("string").alias("segment_id"), text.alias("record"))


@query
def contract_check(spark, sf):
    checked = contract.contract_check(durable(explanation_records(spark, sf), "landed_records"))
    return checked.select("segment_id", "is_valid", F.concat_ws("; ", "problems").alias("problems"))


def _own_records(spark, sf) -> DataFrame:
    """The engine's own explanation record of every segment."""
    st = demo.Stages.of(spark, sf)
    nested = explain.topk_nested(_attributed(spark, sf))
    return publish.explanation_records(st.scores, nested, "D1", "2030-01-01T00:00:00Z", "coefficients")


@query
def explanation_records_own(spark, sf):
    """The records read back from their JSON text."""
    shape = (
        "meta STRUCT<district: STRING>, segment STRUCT<segment_id: STRING, segment_name: STRING, rural_flag: BOOLEAN, "
        "risk_score: DOUBLE, risk_exposure_score: DOUBLE>, top_features ARRAY<STRUCT<feature_name: STRING>>, data_density_flag BOOLEAN"
    )
    r = _own_records(spark, sf).select(F.from_json("record", shape).alias("r"))
    return r.select(
        "r.segment.segment_id",
        "r.segment.segment_name",
        "r.segment.rural_flag",
        "r.segment.risk_score",
        "r.segment.risk_exposure_score",
        F.col("r.data_density_flag").alias("data_density_flag"),
        F.concat_ws(",", F.col("r.top_features.feature_name")).alias("feature_names"),
    )


@query
def contract_check_own(spark, sf):
    checked = contract.contract_check(durable(_own_records(spark, sf), "own_records"))
    return checked.select("segment_id", "is_valid", F.concat_ws("; ", "problems").alias("problems"))


# --- exports and live overlay ---------------------------------------------------


@query
def geojson_features(spark, sf):
    return sinks.geojson_features(demo.Stages.of(spark, sf).scores)


_FEATURE = (
    "type: string, geometry: struct<type: string, coordinates: array<array<double>>>, properties: struct<"
    "segment_id: string, segment_name: string, county: string, rural_flag: boolean, risk_score: double, "
    "risk_exposure: double, data_density_flag: boolean, ems_distance_available: boolean>"
)


def _feature_columns(f: DataFrame) -> DataFrame:
    xy = F.col("geometry.coordinates")
    return f.select(
        F.col("properties.segment_id").alias("segment_id"),
        F.col("type").alias("feature_type"),
        F.col("geometry.type").alias("geometry_type"),
        F.round(xy[0][0], 6).alias("lon0"),
        F.round(xy[0][1], 6).alias("lat0"),
        F.round(xy[1][0], 6).alias("lon1"),
        F.round(xy[1][1], 6).alias("lat1"),
        _r("properties.risk_exposure", out="risk_exposure"),
        F.col("properties.ems_distance_available").alias("ems_distance_available"),
    )


@query
def geojson_round_trip(spark, sf):
    """The exported features, read back as columns."""
    return _feature_columns(geojson_features(spark, sf).select(F.from_json("feature", f"struct<{_FEATURE}>").alias("f")).select("f.*"))


@query
def geojson_collection(spark, sf):
    """The same from documents that are FeatureCollections, written in parallel and published together."""
    path = new_path(spark, "segments-geojson")
    geojson.write_collection(demo.Stages.of(spark, sf).scores, path)
    return _feature_columns(geojson.read_collection(spark, path, f"struct<{_FEATURE}>").select("feature.*"))


@query
def export_meta(spark, sf):
    return sinks.export_meta(demo.Stages.of(spark, sf).scores)


@query
def overlay_snapshot(spark, sf):
    now = live.latest_per_key(demo.overlay(spark, sf), "incident_id", ["ts", "event_id"])
    return now.select("incident_id", "event_id", "event_type", "value", "county")


@query
def overlay_counts(spark, sf):
    now = live.latest_per_key(demo.overlay(spark, sf), "incident_id", ["ts", "event_id"])
    return live.overlay_counts(now, "county", "event_type")


@query
def overlay_stream(spark, sf):
    """The snapshot kept by a stream that receives the records in several batches."""
    landed, root, state = (new_path(spark, n) for n in ("landed", "snapshot", "stream_state"))
    records = demo.overlay(spark, sf)
    records.repartition(4, "event_id").write.parquet(landed)
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    running = live.start_overlay(stream, root, state, "incident_id", ["ts", "event_id"])
    running.awaitTermination()
    return live.current(spark, root).select("incident_id", "event_id", "event_type", "value", "county")


@query
def overlay_redelivered(spark, sf):
    """The same snapshot when every third record is delivered twice, in another batch."""
    landed, root, state = (new_path(spark, n) for n in ("landed", "snapshot", "stream_state"))
    records = demo.overlay(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    again = records.where(F.pmod(F.col("event_id"), F.lit(3)) == 0)
    records.unionByName(again).repartition(3).write.parquet(landed)
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    running = live.start_overlay(
        stream, root, state, "incident_id", ["ts", "event_id"], ids=["event_id"], ts="ts", delay="3650 days"
    )
    running.awaitTermination()
    return live.current(spark, root).select("incident_id", "event_id", "event_type", "value", "county")


def _received(spark, records, batches, **over) -> DataFrame:
    """The snapshot of a stream that receives the records in so many batches, some of them late and twice."""
    landed, root, state = (new_path(spark, n) for n in ("landed", "snapshot", "stream_state"))
    number = F.pmod(F.col("event_id"), F.lit(batches))
    # Every fifth record comes once more with another batch, older ones then follow newer ones.
    again = records.where(F.pmod(F.col("event_id"), F.lit(5)) == 0)
    sent = records.withColumn("file", number).unionByName(again.withColumn("file", F.pmod(number + 1, F.lit(batches))))
    sent.repartition(batches, "file").drop("file").write.parquet(landed)
    stream = spark.readStream.schema(records.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    live.start_overlay(stream, root, state, "incident_id", ["ts", "event_id"], ts="ts", **over).awaitTermination()
    return live.current(spark, root).select("incident_id", "event_id", "event_type", "value", "county")


@query
def overlay_active(spark, sf):
    """Incidents whose newest record does not end before the newest time of all; others have left."""
    records = demo.overlay(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    hours = F.floor(F.col("value")).cast("int")
    ended = records.withColumn("ended", F.timestamp_seconds(F.unix_seconds("ts") + hours * 3600))
    return _received(spark, ended, 6, end="ended", retain_s=3650 * 86_400.0)


@query
def overlay_pulls(spark, sf):
    """Records as daily pulls, received in several batches: what the newest pull lacks has left."""
    records = demo.overlay(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    landed, root, state = (new_path(spark, n) for n in ("landed", "snapshot", "stream_state"))
    pulled = records.withColumn("pull", F.date_trunc("day", "ts"))
    pulled.repartition(6, "pull").write.parquet(landed)
    stream = spark.readStream.schema(pulled.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    live.start_overlay(stream, root, state, "incident_id", ["ts", "event_id"], ts="ts", pull="pull", retain_s=3650 * 86_400.0).awaitTermination()
    return live.current(spark, root).select("incident_id", "event_id", "event_type", "value", "county")
