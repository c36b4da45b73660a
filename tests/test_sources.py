"""Documents, paged layers, map extracts, streams, and observations from a document."""

import json
import random

import pytest
from pyspark.sql import functions as F

from penumbra.operators import graph, observations, shadows
from penumbra.sources import arcgis, documents, json_parts
from penumbra.streaming.buckets import solar_buckets


def test_data_set_document(spark, tmp_path):
    tree = {"source_id": 1, "point_wgs84": [-96.34, 30.62], "point_m": [1.0, 2.0], "height_m": 3.0, "canopy_radius_m": 1.0, "shade_ready": True, "quality_flags": []}
    building = {"source_id": "b", "footprint_wgs84": [[[0, 0], [1, 0], [1, 1], [0, 0]]], "footprint_m": [[[0, 0], [1, 0], [1, 1], [0, 0]]], "shade_ready": True, "quality_flags": ["x"]}
    path = str(tmp_path / "data.json")
    with open(path, "w") as f:
        json.dump({"trees": [tree, tree], "buildings": [building]}, f)
    t = documents.scan_trees(spark, path).collect()
    assert [r.pos for r in t] == [0, 1] and t[0].point_m.x == 1.0 and t[0].source_id == "1"
    b = documents.scan_buildings(spark, path).first()
    assert b.footprint_m[0][1].x == 1.0 and b.quality_flags == ["x"]
    with open(path, "w") as f:
        json.dump({"buildings": []}, f)
    with pytest.raises(Exception, match="no list of trees"):
        documents.scan_trees(spark, path).collect()


def test_malformed_features_are_rows_that_are_left_out(spark, tmp_path):
    """Each element by itself: a bad one neither fails the document nor passes."""
    tree = {"source_id": 1, "point_wgs84": [-96.34, 30.62], "point_m": [1.0, 2.0], "height_m": 3.0, "canopy_radius_m": 1.0, "shade_ready": True, "quality_flags": ["a", 3]}
    trees = [tree, tree | {"height_m": "tall"}, tree | {"height_m": "3.5"}, tree | {"shade_ready": 1}, tree | {"shade_ready": "true"}, 7, None, [], "x", tree | {"point_m": [1]}, tree | {"point_m": [1, "a"]}, tree | {"source_id": [1]}, tree | {"source_id": None}, tree | {"point_m": "12"}, {}, tree | {"source_id": "t,[\"{"}]
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    building = {"source_id": "b", "estimated_height_m": 9, "height_source": "floor_count", "footprint_wgs84": [ring], "footprint_m": [ring], "shade_ready": True}
    buildings = [building, building | {"source_id": "c", "footprint_m": [[[0, 0], [1, "x"], [1, 1], [0, 0]]]}, building | {"source_id": "d", "estimated_height_m": {}}, 5, building | {"source_id": "e", "footprint_m": ring}]
    path = str(tmp_path / "data.json")
    with open(path, "w") as f:
        json.dump({"meta": {"n": [1, 2]}, "buildings": buildings, "empty": [], "trees": trees}, f, indent=1)
    found = documents.scan_trees(spark, path)
    assert sorted(r.pos for r in found.collect()) == list(range(len(trees)))
    assert sorted(r.pos for r in shadows.eligible_trees(found).collect()) == [0, 2, 15]
    rows = {r.pos: r for r in found.collect()}
    assert rows[2].height_m == 3.5 and rows[0].quality_flags == ["a"] and rows[15].source_id == 't,[\"{' and rows[5].source_id is None
    standing = documents.scan_buildings(spark, path)
    assert sorted(r.source_id for r in shadows.eligible_buildings(standing).collect()) == ["b"]
    assert standing.count() == 5


def test_lists_are_read_in_ranges(spark, tmp_path):
    """The same elements whatever the size of a range, with commas, quotes and brackets in texts."""
    rng = random.Random(6)

    def value(depth=0):
        kind = rng.random()
        if depth < 3 and kind < 0.25:
            return {rng.choice(["a", "b,", 'c"', "d\\", "é[{"]): value(depth + 1) for _ in range(rng.randint(0, 4))}
        if depth < 3 and kind < 0.5:
            return [value(depth + 1) for _ in range(rng.randint(0, 4))]
        return rng.choice([1, 2.5, True, None, "", "x,y", "[", "}", '{"a":[1,2]}', 'q"uo,te', "back\\", '\\",[', "é,日本", ", ,"])

    made = [value() for _ in range(60)]
    path = str(tmp_path / "list.json")
    with open(path, "w") as f:
        json.dump({"n": "1,0", "meta": {"a": [1, "],"]}, "made": made, "none": []}, f, ensure_ascii=False, indent=1)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        ranges = json_parts._fragments(spark, path).select("start").distinct().count()
        got = sorted((r.pos, r.j) for r in json_parts.elements(spark, path, "made").select("pos", F.to_json("value").alias("j")).collect())
        assert json_parts.member(spark, path, "n") == '"1,0"' and json_parts.member(spark, path, "meta") == "{" and json_parts.member(spark, path, "none") == "[" and json_parts.member(spark, path, "no") is None
        assert json_parts.elements(spark, path, "none").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert ranges > 5 and [json.loads(j) for _, j in got] == made and [p for p, _ in got] == list(range(60))


def test_graph_document(spark, tmp_path):
    path = str(tmp_path / "graph.json")
    with open(path, "w") as f:
        json.dump({"nodes": [[1, 30.0, -96.0], [2, 30.1, -96.0]], "edges": [[1, 2, 12.5, "path"]]}, f)
    nodes, edges = documents.scan_graph(spark, path)
    assert nodes.count() == 2 and edges.first().asDict() == {"lo": 1, "hi": 2, "distance_m": 12.5, "highway": "path"}


OSM = """<osm><node id="1" lat="30.0" lon="-96.0"/><node id="2" lat="30.001" lon="-96.0"/><node id="3" lat="30.002" lon="-96.0"/>
<way id="9"><nd ref="1"/><nd ref="2"/><nd ref="2"/><nd ref="7"/><tag k="highway" v="road"/><tag k="highway" v="footway"/></way>
<way id="10"><nd ref="2"/><nd ref="3"/><tag k="highway" v="cycleway"/></way>
<way id="11"><nd ref="2"/><nd ref="3"/><tag k="highway" v="cycleway"/><tag k="foot" v="yes"/></way>
<way id="12"><nd ref="1"/><nd ref="3"/><tag k="highway" v="steps"/><tag k="access" v="private"/></way></osm>"""


def test_map_extract(spark, tmp_path):
    path = str(tmp_path / "map.osm")
    with open(path, "w") as f:
        f.write(OSM)
    ways, nodes = documents.scan_osm(spark, path)
    got = {(r.lo, r.hi): r.highway for r in graph.edges_from_ways(ways, nodes).collect()}
    assert got == {(1, 2): "footway", (2, 3): "cycleway"}


PAGES = {0: {"features": [{"attributes": {"OBJECTID": 1}}, {"attributes": {"OBJECTID": 2}}], "exceededTransferLimit": True}, 2: {"features": [{"attributes": {"OBJECTID": 2}}, {"attributes": {}}]}}


class Options(dict):
    pass


def pages(url):
    from urllib.parse import parse_qs, urlparse

    q = parse_qs(urlparse(url).query)
    if "returnCountOnly" in q:
        return b'{"count": 4}'
    assert q["orderByFields"] == ["OBJECTID"]
    return json.dumps(PAGES[int(q["resultOffset"][0])]).encode()


def test_paged_layer(spark, monkeypatch):
    monkeypatch.setattr(arcgis, "transport_of", lambda options: pages)
    reader = arcgis.ArcGISReader({"url": "http://example/x", "layer": "4", "page_size": "2", "bbox": "-1,-1,1,1"})
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    df = spark.createDataFrame(rows, arcgis.ArcGISSource({}).schema())
    kept = arcgis.distinct_features(df)
    assert sorted((r.object_id is None, r.object_id or 0) for r in kept.collect()) == [(False, 1), (False, 2), (True, 0)]


@pytest.mark.parametrize("total", [None, "3"])
def test_service_with_a_cap_below_the_page(monkeypatch, total):
    """A service that gives three features at most; the caller's total may be too low."""

    def capped(url):
        from urllib.parse import parse_qs, urlparse

        q = parse_qs(urlparse(url).query)
        if "returnCountOnly" in q:
            return b'{"count": 23}'
        at, asked = int(q["resultOffset"][0]), int(q["resultRecordCount"][0])
        got = [{"attributes": {"OBJECTID": i}} for i in range(at, min(23, at + min(3, asked)))]
        return json.dumps({"features": got, "exceededTransferLimit": at + len(got) < 23}).encode()

    monkeypatch.setattr(arcgis, "transport_of", lambda options: capped)
    options = {"url": "http://example/x", "layer": "4", "page_size": "8"} | ({"total": total} if total else {})
    reader = arcgis.ArcGISReader(options)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert [r[1] for r in rows] == list(range(23)) and len({r[2:] for r in rows}) == 23
    for stalled in (b'{"features": [], "exceededTransferLimit": true}', b'{"features": [{"attributes": {"OBJECTID": 1}}], "exceededTransferLimit": true}'):
        monkeypatch.setattr(arcgis, "transport_of", lambda options, stalled=stalled: lambda url: stalled)
        with pytest.raises(arcgis.ArcGISError, match="stalled"):
            list(reader.read(arcgis.Page(0, None)))


@pytest.mark.parametrize("answer, message", [(b"nonsense", "unreadable"), (b"[]", "no object"), (b'{"error": {"message": "Layer unavailable"}}', "Layer unavailable")])
def test_bad_answers(answer, message):
    with pytest.raises(arcgis.ArcGISError, match=message):
        arcgis.asked(lambda url: answer, "u")


def test_no_answer_is_an_error_of_the_service():
    def gone(url):
        raise TimeoutError("timed out")

    with pytest.raises(arcgis.ArcGISError, match="could not be reached: timed out"):
        arcgis.asked(gone, "u")


def test_filters_narrow_the_requests(spark):
    """A service that records what it is asked for: fewer features come, and the rows are those of a filter on everything."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    layer = [{"attributes": {"OBJECTID": i}, "geometry": {"x": -96.0 + i / 100, "y": 30.0 + i % 7 / 10}} for i in range(60)] + [{"attributes": {"OBJECTID": 60}, "geometry": {"rings": []}}]
    asked, given = [], []

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            west, south, east, north = map(float, q["geometry"].split(","))
            asked.append((q["where"], (west, south, east, north)))
            inside = [f for f in layer if "x" not in f["geometry"] or (west <= f["geometry"]["x"] <= east and south <= f["geometry"]["y"] <= north)]
            for rule in q["where"].split(" AND "):
                if rule.startswith("OBJECTID"):
                    _, sign, value = rule.split(" ", 2)
                    test = {"IN": lambda n, v=value: n in json.loads(v.replace("(", "[").replace(")", "]")), ">=": lambda n, v=value: n >= int(v), "<": lambda n, v=value: n < int(v), "=": lambda n, v=value: n == int(v)}[sign]
                    inside = [f for f in inside if test(f["attributes"]["OBJECTID"])]
            if "returnCountOnly" in q:
                said = {"count": len(inside)}
            else:
                at, size = int(q["resultOffset"]), int(q["resultRecordCount"])
                said = {"features": inside[at : at + size], "exceededTransferLimit": at + size < len(inside)}
                given.extend(said["features"])
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(said).encode())

        def log_message(self, *args):
            pass

    service = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=service.serve_forever, daemon=True).start()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        spark.dataSource.register(arcgis.ArcGISSource)
        rows = spark.read.format("arcgis").option("url", f"http://127.0.0.1:{service.server_port}").option("layer", 4).option("page_size", 8).option("pushdown", "true").load()
        whole = rows.collect()
        assert len(whole) == 61 and {a for a in asked} == {("1=1", (-180.0, -90.0, 180.0, 90.0))}
        for condition, where, box in (
            ("lon >= -95.8 AND lon < -95.7 AND lat <= 30.4", "1=1", (-95.8, -90.0, -95.7, 30.4)),
            ("object_id IN (3, 5, 60)", "OBJECTID IN (3, 5, 60)", (-180.0, -90.0, 180.0, 90.0)),
            ("object_id >= 20 AND object_id < 30 AND lat > 30.2", "OBJECTID >= 20 AND OBJECTID < 30", (-180.0, 30.2, 180.0, 90.0)),
        ):
            asked.clear()
            given.clear()
            got = sorted(map(tuple, rows.filter(condition).collect()), key=lambda r: r[1])
            want = sorted((tuple(r) for r in spark.createDataFrame(whole, rows.schema).filter(condition).collect()), key=lambda r: r[1])
            # page and place count what the service gave
            assert [(r[0], r[1], r[4:]) for r in got] == [(r[0], r[1], r[4:]) for r in want] and want
            assert set(asked) == {(where, box)} and len(given) < 61 / 2
        asked.clear()
        assert rows.filter("lon > 5 AND lon < 3").count() == 0 and not [a for a in asked if a[1][0] <= a[1][2]]
    finally:
        service.shutdown()
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_bad_box():
    with pytest.raises(arcgis.ArcGISError):
        arcgis.ArcGISReader({"url": "u", "layer": "1", "bbox": "1,0,-1,2"})


def observation(number, kind, observed, predicted):
    return {"observation_id": number, "observation_type": kind, "observed_at": "2026-06-21T13:00:00-05:00", "location": {"latitude": 30.6, "longitude": -96.3, "gps_accuracy_m": 3}, "conditions": {"cloud_condition": "clear"}, "evidence": {"photo_files": ["a"]}, "subject": {"object_type": "tree", "source_feature_id": "1"}, "route": {"origin_id": "x", "destination_id": "y", "preference": "fastest"}, "observed": observed, "predicted": predicted}


def shadow(b, m, f):
    return {"shadow_bearing_degrees": b, "shadow_length_m": m, "walkway_shade_fraction": f}


def route(m, s, f):
    return {"distance_m": m, "duration_seconds": s, "shade_fraction": f}


def test_observation_report(spark, tmp_path):
    rows = [observation("a", "shadow", shadow(358, 10, 0.4), shadow(2, 12, 0.5)), observation("b", "shadow", shadow(100, 20, 0.7), shadow(110, 18, 0.65)), observation("c", "route", route(1000, 800, 0.3), route(1100, 900, 0.4)), observation("d", "route", route(1200, 1000, 0.6), route(1150, 950, 0.55))]
    path = str(tmp_path / "obs.json")
    with open(path, "w") as f:
        json.dump({"schema_version": "1.0", "observations": rows}, f)
    o = documents.scan_observations(spark, path)
    assert observations.violations(o).count() == 0
    s = observations.means(observations.shadow_errors(o)).first()
    assert tuple(s) == (2, 7.0, 2.0, 15.0, 7.5)
    r = observations.means(observations.route_errors(o)).first()
    # the mean of 10 and 4.167 is written 7.0835, whose half goes up
    assert tuple(r) == (2, 75.0, 7.084, 75.0, 8.75, 7.5)
    documents.write_document(observations.report(o), str(tmp_path / "report"))
    said = json.loads(spark.read.text(str(tmp_path / "report")).first().value)
    assert said["schema_version"] == "1.0" and said["observation_count"] == 4 and said["route_summary"]["mean_absolute_duration_error_percent"] == 8.75
    rows += [rows[0], observation("e", "shadow", shadow(400, 1, 0.1), shadow(1, 1, 1)), observation("f", "photo", {}, {})]
    with open(path, "w") as f:
        json.dump({"schema_version": "1.0", "observations": rows}, f)
    bad = {r.pos: r.message for r in observations.violations(documents.scan_observations(spark, path)).collect()}
    assert bad == {4: "duplicate observation_id: a", 5: "observation[e].observed.shadow_bearing_degrees must be at most 360", 6: "observation[f].observation_type must be one of ['route', 'shadow']"}
    with open(path, "w") as f:
        json.dump({"schema_version": "2", "observations": []}, f)
    with pytest.raises(Exception, match="schema_version"):
        documents.scan_observations(spark, path).collect()


def test_whole_report_in_pieces(spark, tmp_path):
    rows = [observation("a", "shadow", shadow(358, 10, 0.4), shadow(2, 12, 0.5)), observation("c", "route", route(1000, 800, 0.3), route(1100, 900, 0.4)), observation("b,\"", "shadow", shadow(100, 0, 0.7), shadow(110, 18, 0.65)), observation("d", "route", route(1200, 1000, 0.6), route(1150, 950, 0.55))]
    path, out = str(tmp_path / "obs.json"), tmp_path / "out" / "report.json"
    for kept in (rows, rows[:1], []):
        with open(path, "w") as f:
            json.dump({"schema_version": "1.0", "observations": kept}, f)
        o = documents.scan_observations(spark, path)
        documents.write_pieces(observations.report_pieces(o), str(out))
        said = json.loads(out.read_text())
        assert said["observation_count"] == len(kept) and [r["observation_id"] for r in said["shadow_observations"]] == [r["observation_id"] for r in kept if r["observation_type"] == "shadow"]
        assert [p.name for p in out.parent.iterdir() if not p.name.startswith(".")] == ["report.json"]
        if kept is rows:
            assert said["shadow_observations"][0] == {"observation_id": "a", "object_type": "tree", "bearing_error_degrees": 4.0, "length_error_m": 2.0, "length_error_percent": 20.0, "walkway_shade_error_percentage_points": 10.0}
            assert said["shadow_observations"][1]["length_error_percent"] is None
            assert said["route_observations"][1] == {"observation_id": "d", "preference": "fastest", "distance_error_m": 50.0, "distance_error_percent": 4.167, "duration_error_seconds": 50.0, "duration_error_percent": 5.0, "shade_error_percentage_points": 5.0}
            assert said["shadow_summary"]["count"] == 2 and said["route_summary"]["mean_absolute_distance_error_m"] == 75.0
    before = out.read_text()
    broken = observations.report_pieces(o).withColumn("text", F.when(F.col("section") == 2, F.raise_error(F.lit("stop"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stop"):
        documents.write_pieces(broken, str(out))
    assert out.read_text() == before and [p.name for p in out.parent.iterdir() if not p.name.startswith(".")] == ["report.json"]


def test_messages_of_observations(spark, tmp_path):
    fine = observation("a", "route", route(1, 1, 0.3), route(1, 1, 0.4))
    changes = [
        ({"observation_id": None}, "observation.observation_id must be a non-empty string"),
        ({"observation_id": 12}, "observation.observation_id must be a non-empty string"),
        ({"location": {"latitude": True, "longitude": 0, "gps_accuracy_m": 0}}, "observation[{}].location.latitude must be a number"),
        ({"location": {"latitude": "30", "longitude": 0, "gps_accuracy_m": 0}}, "observation[{}].location.latitude must be a number"),
        ({"location": {"latitude": None, "longitude": 0, "gps_accuracy_m": 0}}, "observation[{}].location.latitude must be a number"),
        ({"location": {"longitude": 0, "gps_accuracy_m": 0}}, "observation[{}].location.latitude is required"),
        ({"location": [30, -96]}, "observation[{}].location must be an object"),
        ({"conditions": None}, "observation[{}].conditions must be an object"),
        ({"conditions": {"cloud_condition": 3}}, "observation[{}].conditions.cloud_condition must be a non-empty string"),
        ({"evidence": {"photo_files": "a.jpg"}}, "observation[{}].evidence.photo_files must contain at least one filename"),
        ({"evidence": {"photo_files": [1]}}, "observation[{}].evidence.photo_files must contain at least one filename"),
        ({"evidence": {"photo_files": []}}, "observation[{}].evidence.photo_files must contain at least one filename"),
        ({"observed": "none"}, "observation[{}].observed must be an object"),
        ({"observed_at": 5}, "observation[{}].observed_at must be a non-empty string"),
        ({"observation_id": " "}, "observation.observation_id must be a non-empty string"),
        ({"observed_at": "soon"}, "observation[{}].observed_at must be ISO 8601"),
        ({"observed_at": "2026-06-21T13:00:00"}, "observation[{}].observed_at must include a timezone offset"),
        ({"location": {"latitude": 91, "longitude": 0, "gps_accuracy_m": 0}}, "observation[{}].location.latitude must be at most 90"),
        ({"location": {"latitude": 9, "longitude": 0, "gps_accuracy_m": -1}}, "observation[{}].location.gps_accuracy_m must be at least 0"),
        ({"conditions": {"cloud_condition": "fog"}}, "observation[{}].conditions.cloud_condition must be one of ['clear', 'overcast', 'partly_cloudy']"),
        ({"evidence": {"photo_files": ["a", ""]}}, "observation[{}].evidence.photo_files must contain at least one filename"),
        ({"evidence": {}}, "observation[{}].evidence.photo_files is required"),
        ({"route": {"origin_id": "x", "destination_id": " ", "preference": "fastest"}}, "observation[{}].route.destination_id must be a non-empty string"),
        ({"route": {"origin_id": "x", "destination_id": "y", "preference": "scenic"}}, "observation[{}].route.preference must be one of ['fastest', 'shadiest']"),
        ({"predicted": route(1, 1, 1.5)}, "observation[{}].predicted.shade_fraction must be at most 1"),
        ({"observation_type": "shadow", "subject": {"object_type": "pole"}}, "observation[{}].subject.object_type must be one of ['building', 'tree']"),
    ]
    path = str(tmp_path / "obs.json")
    with open(path, "w") as f:
        rows = [fine | {"observation_id": f"n{i}"} | change for i, (change, _) in enumerate(changes)]
        unnamed = {k: v for k, v in fine.items() if k != "observation_id"}
        others = [({k: v for k, v in fine.items() if k != "route"} | {"observation_id": "z"}, "observation[z].route is required"), (unnamed, "observation.observation_id is required"), (5, "each observation must be an object"), ("x", "each observation must be an object"), (None, "each observation must be an object"), ([], "each observation must be an object")]
        changes += [(None, said) for _, said in others]
        json.dump({"schema_version": "1.0", "observations": rows + [o for o, _ in others]}, f)
    got = {r.pos: r.message for r in observations.violations(documents.scan_observations(spark, path)).collect()}
    assert got == {i: said.format(f"n{i}") for i, (_, said) in enumerate(changes)}


def test_layer_through_the_reader(spark):
    """A service over HTTP that gives three of the five features asked for, and some things that are no features."""
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from urllib.parse import parse_qs, urlparse

    layer = [{"attributes": {"OBJECTID": i}, "geometry": {"x": i, "y": 0}} for i in range(23)]
    layer[4], layer[9] = "nothing", {"attributes": "none"}

    class Service(BaseHTTPRequestHandler):
        def do_GET(self):
            q = parse_qs(urlparse(self.path).query)
            if "returnCountOnly" in q:
                said = {"count": 23}
            else:
                at, asked = int(q["resultOffset"][0]), int(q["resultRecordCount"][0])
                got = layer[at : at + min(3, asked)]
                said = {"features": got, "exceededTransferLimit": at + len(got) < 23}
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps(said).encode())

        def log_message(self, *args):
            pass

    service = ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=service.serve_forever, daemon=True).start()
    try:
        spark.dataSource.register(arcgis.ArcGISSource)
        rows = spark.read.format("arcgis").option("url", f"http://127.0.0.1:{service.server_port}").option("layer", 4).option("page_size", 5).load()
        found = sorted((r.object_id is None, r.object_id or 0) for r in arcgis.distinct_features(rows).collect())
    finally:
        service.shutdown()
    assert found == [(False, i) for i in range(23) if i not in (4, 9)] + [(True, 0)]


def test_stream_of_buckets(spark, tmp_path):
    rows = [(i, f"2026-06-21 12:{i:02d}:00") for i in range(40)] + [(99, "2026-06-21 15:00:00")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "id long, t string").select("id", F.col("t").cast("timestamp").alias("ts")).write.parquet(source)
    stream = spark.readStream.schema("id long, ts timestamp").parquet(source)
    q = solar_buckets(stream).writeStream.format("memory").queryName("solar_buckets").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {str(r.bucket_start): r.n_events for r in spark.table("solar_buckets").collect()}
    assert got == {"2026-06-21 12:00:00": 15, "2026-06-21 12:15:00": 15, "2026-06-21 12:30:00": 10}
