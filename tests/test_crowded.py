"""Work where much lies on one spot grows with the rows, not with their pairs."""

import random

from pyspark.sql import functions as F

from penumbra.operators import paths, shade, shadows
from penumbra.plans import ingest, shade as plans


def test_edges_under_many_shadows_meet_none_of_them(spark, monkeypatch):
    suns = plans.suns(spark, plans.INSTANTS[1:])
    trees = spark.createDataFrame([(i, 8.0, 9.0 + i / 100, 755000.0, 3390000.0) for i in range(60)], "source_id long, height_m double, canopy_radius_m double, x double, y double")
    trees = trees.select("source_id", "height_m", "canopy_radius_m", F.lit(True).alias("shade_ready"), F.struct("x", "y").alias("point_m"), F.struct(F.lit(-96.3).alias("x"), F.lit(30.6).alias("y")).alias("point_wgs84"))
    buildings = spark.createDataFrame([], "source_id long, height_m double, footprint_m array<array<struct<x:double,y:double>>>")
    rows = [(1, 2, 4.0, 754998.0, 3389999.0, 755002.0, 3389999.0), (3, 4, 20.0, 755000.0, 3390000.0, 755000.0, 3389980.0), (5, 6, 4.0, 754998.0, 3389900.0, 755002.0, 3389900.0), (7, 8, 0.0, 755000.0, 3390000.0, 755000.0, 3390000.0)]
    lines = spark.createDataFrame(rows, "lo long, hi long, distance_m double, x0 double, y0 double, x1 double, y1 double")
    met, real = [], shade.meetings
    monkeypatch.setattr(shade, "meetings", lambda lines, *rest: met.extend((r.lo, r.hi) for r in lines.collect()) or real(lines, *rest))
    pieces = shade.pieces(trees, buildings, suns)
    got = {(r.bucket_start, r.lo): r.fraction for r in shade.edge_shade(lines, pieces, suns).collect()}
    noon = suns.orderBy("bucket_start").first().bucket_start
    assert got[noon, 1] == 1.0 and 0.4 < got[noon, 3] < 0.6 and got[noon, 5] == 0.0
    assert (1, 2) not in met and (3, 4) in met
    # what the dark cells say is what all pieces say
    whole = real(lines, shade.strips(pieces)).select("bucket_start", "lo", F.explode("spans").alias("s")).select("bucket_start", "lo", "s.t0", "s.t1")
    plain = {(r.bucket_start, r.lo): round(r.fraction, 9) for r in shade.covered(whole, ["bucket_start", "lo"]).collect()}
    assert all(round(got[k], 9) == v for k, v in plain.items() if k[1] != 7)


def test_edges_that_leave_the_dark_are_those_of_a_plain_search(spark):
    """Cells are told and passed by arithmetic on whole batches, without a row for a piece's or an edge's line; what isn't dark at an instant is what single cells and pieces say."""
    rng = random.Random(4)
    suns = plans.suns(spark, plans.INSTANTS[1:3])
    trees = spark.createDataFrame([(i, 6.0 + rng.random() * 6, 3.0 + rng.random() * 4, 755000.0 + rng.random() * 30, 3390000.0 + rng.random() * 30) for i in range(25)], "source_id long, height_m double, canopy_radius_m double, x double, y double")
    trees = trees.select("source_id", "height_m", "canopy_radius_m", F.lit(True).alias("shade_ready"), F.struct("x", "y").alias("point_m"), F.struct(F.lit(-96.3).alias("x"), F.lit(30.6).alias("y")).alias("point_wgs84"))
    rows = [(i, i + 1, 1.0, x, y, x + rng.random() * 6 - 3, y + (rng.random() * 6 - 3) * (i % 10 > 0)) for i in range(300) for x, y in [(755000.0 + rng.random() * 30, 3390000.0 + rng.random() * 30)]]
    lines = spark.createDataFrame(rows, "lo long, hi long, distance_m double, x0 double, y0 double, x1 double, y1 double")
    drawn = shade.strips(shade.pieces(trees, spark.createDataFrame([], "source_id long, height_m double, footprint_m array<array<struct<x:double,y:double>>>"), suns))
    lit = suns.filter("daylight").select("bucket_start")
    found = shade.lit_edges(lines, drawn, lit)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    pieces = [(r.bucket_start, [(s.p.x, s.p.y, s.q.x, s.q.y) for s in r.sides]) for r in drawn.select("bucket_start", "sides").collect()]

    def held(at, cx, cy):
        spots = [(x, y) for x in (2 * cx - 0.01, 2 * cx + 2.01) for y in (2 * cy - 0.01, 2 * cy + 2.01)]
        turns = lambda sides: [(c - a) * (y - b) - (d - b) * (x - a) for a, b, c, d in sides for x, y in spots]
        return any(all(t > 0 for t in v) or all(t < 0 for t in v) for of, sides in pieces if of == at for v in [turns(sides)])

    known, want = {}, set()
    for at in {of for of, _ in pieces}:
        for lo, _, _, x0, y0, x1, y1 in rows:
            cells = {((x0 + (x1 - x0) * t / 500) // 2, (y0 + (y1 - y0) * t / 500) // 2) for t in range(501)}
            if not all(known.setdefault((at, *c), held(at, *c)) for c in cells):
                want.add((at, lo))
    got = {(r.bucket_start, r.lo) for r in found.collect()}
    # a plain walk of steps may miss a corner of a cell
    assert want <= got and len(got - want) < 10 and len(want) < 0.97 * 300 * len({of for of, _ in pieces})


def test_a_cell_is_searched_as_far_as_something_new_leads(spark):
    """What comes into a cell that was searched before ends where it meets what was there; a round reads the folders of the cells it searches."""
    import pyarrow as pa

    n = 1000
    there, back = list(range(n - 1)), list(range(1, n))
    arcs = {"src": there + back, "dst": back + there, "cost": [1.0] * (2 * n - 2), "metres": [1.0] * (2 * n - 2), "shaded_m": [0.0] * (2 * n - 2), "out": []}
    cell = paths._Cell(pa.table({k: pa.array([v], pa.list_(pa.int64() if k in ("src", "dst") else pa.float64())) for k, v in arcs.items()}), [])
    by, done, new = cell.search([(0.0, 0), (400.0, 600)], float("inf"), [False, True])
    assert [i for i in range(n) if new[i]] == list(range(501, n)) and all(done[:500])
    by, done, new = cell.search([(0.0, 0), (50.0, 60)], float("inf"), [False, True])
    assert sum(new) == n - 56 and sum(done) == n
    by, done, new = cell.search([(0.0, 0), (70.0, 60)], float("inf"), [False, True])
    assert not any(new) and sum(done) < 100
    made = spark.createDataFrame([(i, -96.3 + 1e-4 * i, 30.6) for i in range(200)], "node_id long, lon double, lat double")
    net = paths.overlay(spark.createDataFrame([("plain", a, b, 1.0, 1.0, 0.0) for i in range(199) for a, b in ((i, i + 1), (i + 1, i))], "variant string, src long, dst long, cost double, metres double, shaded_m double"), made)
    shelves = {r.shelf for r in net.cells.select("shelf").distinct().collect()}
    assert len(shelves) > 3 and len({f.split("shelf=")[1].split("/")[0] for f in net.cells.inputFiles()}) == len(shelves)
    assert paths.shortest_ways(spark.createDataFrame([(1, "plain", 0, 199)], "request long, variant string, origin long, destination long"), net).ways.first().cost == 199.0


def test_edges_meet_shadows_in_bounded_parts(spark, sf, monkeypatch):
    """A row for an edge and a shadow is made where they meet, with nothing moved or added up afterwards, and is the same however small the parts of a cell."""
    rows = lambda found: sorted(tuple(map(str, r)) for r in found.collect())
    whole = rows(plans.edge_shadow_join(spark, sf))
    monkeypatch.setattr(shade, "EDGES", 3)
    monkeypatch.setattr(shade, "PIECES", 2)
    found = plans.edge_shadow_join(spark, sf)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FlatMapCoGroupsInArrow") == 1 and "HashAggregate" not in plan and "SortMergeJoin" not in plan
    assert len(whole) > 10 and rows(found) == whole


def test_rows_of_a_small_table_are_spread_over_tasks(spark, sf):
    for rows in (ingest.trees(spark, sf), ingest.buildings(spark, sf)):
        assert rows.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_document_is_read_once(spark, tmp_path, monkeypatch):
    """However many levels its parts are found by, and whatever is asked of it."""
    from penumbra.sources import documents, json_parts

    path = str(tmp_path / "one.json")
    with open(path, "w") as f:
        f.write('{"schema_version":"1.0","observations":[{"observation_id":"a"},{"observation_id":"b, c"}]}')
    seen, real = [], json_parts._fragments
    monkeypatch.setattr(json_parts, "_fragments", lambda *a: seen.append(a) or real(*a))
    found = documents.scan_observations(spark, path)
    assert [r.observation_id for r in found.orderBy("pos").collect()] == ["a", "b, c"] and len(seen) == 1
    plan = json_parts.parts(spark, path)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(text#") <= 4 and "_metadata" not in plan


def test_what_is_sorted_of_a_document_is_blocks_and_elements(spark, tmp_path, monkeypatch):
    """Commas inside of elements are no rows, and an element's members are looked up once each, in tasks that share the elements in ranges."""
    from penumbra.sources import documents, json_parts

    path = str(tmp_path / "one.json")
    with open(path, "w") as f:
        f.write('{"schema_version":"1.0","observations":[%s]}' % ",".join('{"observation_id":"a%d, b","x":[%s]}' % (i, ",".join("7" * 200)) for i in range(40)))
    written, real = [], json_parts.kept
    monkeypatch.setattr(json_parts, "kept", lambda df, name: written.append(real(df, name)) or written[-1])
    assert json_parts.parts(spark, path).count() == 41 and sum(w.count() for w in written) < 100
    found = documents.scan_observations(spark, path)
    assert [(r.pos, r.observation_id) for r in found.collect()] == [(i, f"a{i}, b") for i in range(40)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("schema_of_variant") + plan.count("SchemaOfVariant") < 120 and plan.count("try_variant_get") < 60
    assert "rangepartitioning" in found._jdf.queryExecution().executedPlan().toString()


def test_cells_are_cut_where_neighbourhoods_are(spark):
    """Nodes that lie across one another by ten times their distance don't make half of a graph the borders of its cells, and a crowded cell is cut."""
    rng, side = random.Random(5), 50
    nodes = [(r * side + c, -96.3 + 2e-5 * c + rng.random() * 2e-4, 30.6 + 2e-5 * r + rng.random() * 2e-4) for r in range(side) for c in range(side)]
    pairs = [(k, k + d) for k in range(side * side) for d in (1, side) if k + d < side * side and (d > 1 or (k + 1) % side)]
    arcs = spark.createDataFrame([("plain", x, y, 1.0 + rng.random(), 1.0, 0.0) for a, b in pairs for x, y in ((a, b), (b, a))], "variant string, src long, dst long, cost double, metres double, shaded_m double")
    made = spark.createDataFrame(nodes, "node_id long, lon double, lat double")
    net = paths.overlay(arcs, made, 0.0006)
    assert net.roads.select("src").distinct().count() < 0.25 * side * side
    cut = paths.overlay(arcs, made, 0.01, 400)
    assert cut.place.groupBy("cell").count().agg({"count": "max"}).first()[0] <= 400
    # one with all nodes in a cell and one with many find the same ways
    asked = spark.createDataFrame([(1, "plain", 0, side * side - 1), (2, "plain", side - 1, 7)], "request long, variant string, origin long, destination long")
    costs = [{r.request: round(r.cost, 9) for r in paths.shortest_ways(asked, n).ways.collect()} for n in (cut, paths.overlay(arcs, made, 0.01))]
    assert costs[0] == costs[1] and len(costs[0]) == 2


def test_a_tree_is_cleaned_and_drawn_once(spark, sf):
    """However many conditions are asked of it: filters and explodes don't have its texts read or its outline computed again."""
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(shadows.eligible_trees(ingest.trees(spark, sf))).count("regexp_extract") == 4
    assert plan(ingest.tree_eligible(spark, sf)).count("regexp_extract") <= 8
    assert "size(" not in plan(plans.tree_shadow_polygon(spark, sf)) and "size(" not in plan(plans.metric_to_wgs84(spark, sf))


def test_lines_of_swept_ground_are_no_rows(spark, sf):
    """Lengths along lines are added up where a building's pieces are: its rows are as many as its instants, not as its lines, and its area is measured once."""
    found = shadows.swept_area(shadows.building_pieces(plans.ready_buildings(spark, sf), plans.suns(spark)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "sequence(" not in plan and plan.count("ArrowEvalPython") == 1
    # a yard, ground that two pieces share, and a piece between two lines
    side = lambda a, b: ((a[0] + 0.0, a[1] + 0.0), (b[0] + 0.0, b[1] + 0.0))
    ring = lambda x0, y0, x1, y1: [side(a, b) for a, b in (((x0, y0), (x1, y0)), ((x1, y0), (x1, y1)), ((x1, y1), (x0, y1)), ((x0, y1), (x0, y0)))]
    rows = [(1, 1, -2, ring(0, 0, 10, 10) + ring(4, 4, 6, 6)), (1, 1, 1, ring(5, 0, 20, 10)), (1, 2, 1, ring(0, 0.01, 9, 0.02)), (1, 3, 1, ring(0, 0, 1, 1)), (1, 3, 2, ring(2, 0, 3, 1))]
    made = spark.createDataFrame(rows, "bucket_start int, source_id int, piece int, sides array<struct<p:struct<x:double,y:double>,q:struct<x:double,y:double>>>")
    assert {r.source_id: round(r.area_m2, 9) for r in shadows.swept_area(made).collect()} == {1: 198.0, 3: 2.0}
