import json

import pytest
from pyspark.sql import functions as F

from kerbline.sources import features as src
from kerbline.sources import demo, geojson, osm, sinks
from kerbline.sources import stations as st


def landed(tmp_path, name, records, per_file=2):
    folder = tmp_path / name
    folder.mkdir()
    for i in range(0, len(records), per_file):
        (folder / f"page_{i:04d}.json").write_text(json.dumps(records[i : i + per_file], indent=1))
    return str(folder)


LINES = [
    {"attributes": {"TSegID2025": "1", "RouteID": "R", "AADT": 5}, "geometry": {"paths": [[[0, 10], [2, 12]], [[4, 14]]]}},
    {"attributes": {"TSegID2025": "2", "AADT": None}, "geometry": {"paths": [[[1, 1]]]}},
    {"attributes": {"TSegID2025": "3"}, "geometry": {"paths": []}},
    {"attributes": {"TSegID2025": "4"}},
    {"attributes": {"TSegID2025": "5"}, "geometry": {"x": -80.5, "y": 35.5}},
    {"attributes": {"TSegID2025": "6"}, "geometry": {"paths": [[[0, 0], [1, 0], [5, 3]]]}},
]


def test_pages_are_read_and_flattened(spark, tmp_path):
    pages = src.read_pages(spark, landed(tmp_path, "traffic", LINES), src.TRAFFIC)
    rows = {r.TSegID2025: r for r in src.flatten(pages).collect()}
    assert len(rows) == 6 and rows["1"].AADT == 5.0
    assert (rows["1"]._lon, rows["1"]._lat) == (2.0, 12.0)
    assert (rows["2"]._lon, rows["2"]._lat) == (1.0, 1.0)
    assert rows["3"]._lon is None and rows["4"]._lat is None
    assert (rows["5"]._lon, rows["5"]._lat) == (-80.5, 35.5)
    assert "_lon" not in src.flatten(pages, geometry=False).columns


def test_segments_come_from_the_first_path(spark, tmp_path):
    pages = src.read_pages(spark, landed(tmp_path, "traffic", LINES), src.TRAFFIC)
    segs = src.segment_geometry(pages, {"segment_id": F.col("attributes.TSegID2025")})
    rows = {r.segment_id: r for r in segs.collect()}
    assert set(rows) == {"1", "6"}
    assert (rows["1"].start_lon, rows["1"].end_lat, rows["1"].mid_lon, rows["1"].mid_lat) == (0.0, 12.0, 1.0, 11.0)
    assert (rows["6"].mid_lon, rows["6"].mid_lat) == (2.0, 1.0)
    assert src.vertices(segs).count() == 5


def test_geometry_is_parsed_only_when_used(spark, tmp_path):
    pages = src.read_pages(spark, landed(tmp_path, "traffic", LINES), src.TRAFFIC)
    plan = src.flatten(pages, geometry=False)._jdf.queryExecution().toString()
    schema = plan[plan.rindex("ReadSchema") :]
    assert "attributes" in schema and "geometry" not in schema


def test_source_filter_reaches_the_parquet_scan(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    got = src.source_filter(orders, {"o_orderstatus": ["F"]}, ["o_orderkey"], ("o_orderdate", [1996, 1998]))
    want = orders.where("o_orderstatus = 'F' and year(o_orderdate) in (1996, 1998)").count()
    assert got.count() == want > 0
    plan = got._jdf.queryExecution().toString()
    pushed = plan[plan.rindex("PushedFilters") :].split("\n")[0]
    assert "o_orderstatus" in pushed and "o_orderdate" in pushed and "o_totalprice" not in plan[plan.rindex("ReadSchema") :]


def test_bbox_filter_is_pushed_down(spark, tmp_path):
    rows = [(1, 34.5, -80.5), (2, 36.0, -80.5), (3, None, -80.5)]
    spark.createDataFrame(rows, "i int, lat double, lon double").write.parquet(str(tmp_path / "p"))
    box = {"min_lat": 34.0, "max_lat": 35.0, "min_lon": -81.0, "max_lon": -80.0}
    got = src.bbox_filter(spark.read.parquet(str(tmp_path / "p")), box)
    assert [r.i for r in got.collect()] == [1]
    assert "GreaterThanOrEqual(lat,34.0)" in got._jdf.queryExecution().toString()


def test_stations_keep_their_columns(spark):
    fire = spark.createDataFrame([("D", "Union", "Addr", 35.0, -80.0, "F1")], "DEPT_NAME string, COUNTY string, STATION_ADDRESS string, LATITUDE double, LONGITUDE double, FD_ID string")
    ems = spark.createDataFrame([("E", "STANLY", "A2", "C", "fp", 35.1, -80.1)], "name string, county string, address string, city string, fips string, _lat double, _lon double")
    out = st.stations_union(st.fire_stations(fire), st.ems_stations(ems))
    assert out.columns == ["station_type", "name", "county", "address", "lat", "lon", "FD_ID", "city", "fips"]
    rows = {r.station_type: r for r in out.collect()}
    assert rows["fire"].county == "Union" and rows["fire"].fips is None
    assert rows["ems"].county == "Stanly" and rows["ems"].lat == 35.1 and rows["ems"].FD_ID is None


def test_osm_ways(spark, tmp_path):
    ways = [
        {"id": 1, "tags": {"highway": "primary", "maxspeed": "35 mph", "x": "y"}, "center": {"lat": 35.0, "lon": -80.0}},
        {"id": 2},
    ]
    rows = {r.osm_id: r for r in osm.flatten_ways(osm.read_ways(spark, landed(tmp_path, "osm", ways))).collect()}
    assert (rows[1].highway, rows[1].maxspeed, rows[1].lanes, rows[1].lat) == ("primary", "35 mph", None, 35.0)
    assert rows[2].highway is None and rows[2].lon is None


def test_csv_keeps_text_and_gaps(spark, tmp_path):
    rows = [(1, 'a "quoted", text'), (2, "two\nlines"), (3, ""), (4, None), (5, "back\\slash")]
    df = spark.createDataFrame(rows, "i int, s string")
    sinks.write_csv(df, str(tmp_path / "c"))
    got = sinks.read_csv(spark, str(tmp_path / "c"), df.schema).collect()
    assert sorted((r.i, r.s) for r in got) == rows


def test_json_sinks_write_null(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), None), (2, 0.5, "x")], "i int, v double, s string")
    sinks.write_records(df, str(tmp_path / "j"))
    got = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "j")).collect()), key=lambda r: r["i"])
    assert got == [{"i": 1, "v": None, "s": None}, {"i": 2, "v": 0.5, "s": "x"}]
    assert [json.loads(r.record)["v"] for r in sinks.record_json(df).orderBy("record").collect()] == [None, 0.5]


def test_geojson_and_its_fallback(spark, tmp_path):
    df = spark.createDataFrame(
        [("s", 34.0, -81.0, 34.1, -80.9, 0.5, 0.25, None)],
        "segment_id string, start_lat double, start_lon double, end_lat double, end_lon double, risk_score double, risk_exposure double, rural_flag boolean",
    )
    sinks.write_geojson(df, str(tmp_path / "g"))
    feature = json.loads(spark.read.text(str(tmp_path / "g")).first().value)
    assert feature["geometry"] == {"type": "LineString", "coordinates": [[-81.0, 34.0], [-80.9, 34.1]]}
    assert len(feature["properties"]) == 8 and feature["properties"]["rural_flag"] is False
    assert feature["properties"]["county"] is None
    plain = json.loads(sinks.geojson_features(df.drop("end_lat")).first().feature)
    assert "geometry" not in plain and plain["segment_id"] == "s"


def test_stored_top_list_is_reused_only_at_its_size(spark, tmp_path):
    path, built = str(tmp_path / "top"), []

    def build(n):
        built.append(n)
        return spark.range(n)

    assert sinks.reuse_or_build(spark, path, 3, lambda: build(3)).count() == 3
    assert sinks.reuse_or_build(spark, path, 3, lambda: build(3)).count() == 3
    assert built == [3]
    assert sinks.reuse_or_build(spark, path, 5, lambda: build(5)).count() == 5
    assert built == [3, 5]


def test_table_round_trip(spark, tmp_path):
    sinks.write_table(spark.range(4), str(tmp_path / "t"))
    assert sinks.read_table(spark, str(tmp_path / "t")).count() == 4
    assert sinks.export_meta(spark.range(4)).first().n_segments == 4


def test_schema_contracts_parse():
    for ddl in (src.ROADS, src.GENERAL_CRASHES, src.INCIDENTS, src.TRAFFIC):
        assert len(src.record_schema(ddl)["attributes"].dataType.fields) == ddl.count(",") + 1


def test_shared_folder_must_be_named_on_a_cluster(spark, monkeypatch):
    from kerbline import session

    class Context:
        master = "yarn"

    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.shared_dir(Cluster())


def test_local_session_without_a_named_folder_gets_one(spark, monkeypatch):
    from kerbline import session

    class Conf:
        def get(self, *_):
            return None

    class Local:
        conf, sparkContext = Conf(), spark.sparkContext

    first = session.shared_dir(Local())
    assert first == session.shared_dir(Local()) != ""


def test_intermediates_can_be_dropped(spark, monkeypatch, tmp_path):
    from kerbline import session

    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    table = session.durable(spark.range(5), "five")
    assert table.count() == 5 and list(tmp_path.rglob("*.parquet"))
    session.drop_intermediates(spark)
    assert not list(tmp_path.rglob("*.parquet"))


def located(spark, n, bad=None):
    rows = [(f"s{i}", None if i == 3 else "Main \"St\"\n", 35.0 + i, -80.0, 35.5, -80.5, 0.1 * i, float(i), i == bad) for i in range(n)]
    schema = "segment_id string, segment_name string, start_lat double, start_lon double, end_lat double, end_lon double, risk_score double, risk_exposure double, bad boolean"
    df = spark.createDataFrame(rows, schema).repartition(3)
    return df if bad is None else df.withColumn("risk_score", F.when(F.col("bad"), F.raise_error(F.lit("lost"))).otherwise(F.col("risk_score")))


def test_collections_are_whole_documents_published_together(spark, tmp_path):
    path = tmp_path / "out"
    geojson.write_collection(located(spark, 20), str(path))
    documents = [json.loads(p.read_text()) for p in path.glob("*.geojson")]
    assert len(documents) == 3 and {d["type"] for d in documents} == {"FeatureCollection"}
    got = sorted(json.dumps(f, sort_keys=True) for d in documents for f in d["features"])
    want = [r.feature for r in sinks.geojson_features(located(spark, 20)).collect()]
    assert got == sorted(json.dumps(json.loads(f), sort_keys=True) for f in want)
    before = sorted(p.name for p in path.iterdir())
    with pytest.raises(Exception):
        geojson.write_collection(located(spark, 20, bad=7), str(path))
    assert sorted(p.name for p in path.iterdir()) == before
    geojson.write_collection(located(spark, 2), str(path))
    assert sum(len(json.loads(p.read_text())["features"]) for p in path.iterdir()) == 2
    geojson.write_collection(located(spark, 2).limit(0), str(path))
    assert [json.loads(p.read_text()) for p in path.iterdir()] == [{"type": "FeatureCollection", "features": []}]
    geojson.write_collection(located(spark, 2).drop("end_lon"), str(path))
    assert {json.loads(p.read_text())["type"] for p in path.iterdir()} == {"RecordList"}


def test_line_is_worked_out_once_and_one_file_is_spread(spark, sf_dir):
    plan = demo.segments(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "paths[0][0]" not in plan and plan.count("Repartition") == 1
