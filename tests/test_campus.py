"""Search by an index, numbers by ranges, and components with a hub."""

import random

from pyspark.sql import functions as F

from penumbra.functions.geo import haversine
from penumbra.operators import campus, graph

PLACE = "id string, name string, short_name string, abbreviation string, building_number string"


def plain(places, query, most=8):
    wanted, found = query.strip().lower(), []
    if not wanted:
        return [], 0
    for place in places:
        scores = []
        for v in (x.lower() for x in (place[1], place[2], place[3], place[4], place[0]) if x is not None):
            if wanted in v:
                scores.append(0 if v == wanted else 1 if v.startswith(wanted) else 2 if any(w.startswith(wanted) for w in v.split()) else 3)
        if scores:
            found.append((min(scores), place[1], place[0]))
    return [(s, i) for s, _, i in sorted(found)[:most]], len(found)


def test_search_equals_looking_at_all_places(spark):
    rng, syllables = random.Random(4), ["hall", "zach", "ry ", "é", "st", "a", "b1", " of ", "lib", "EVANS", "日本"]
    places = [(f"p{i}", "".join(rng.choice(syllables) for _ in range(rng.randint(1, 6))), rng.choice([None, "h", "Zachry"]), rng.choice([None, "A.B", "HALL"]), rng.choice([None, f"{i:04}"])) for i in range(120)]
    queries = ["", "  ", "h", "ha", "hall", " HALL ", "zachry", "zachzach", "of st", "p1", "0", "no such thing", "é", "日本", "a.b", "ry h", "l l"]
    got = {}
    df = graph.kept(spark.createDataFrame(places, PLACE), "places")
    found = campus.search(df, spark.createDataFrame([(q,) for q in queries], "query string"))
    for r in found.collect():
        got.setdefault(r.query, []).append((r["rank"], r.score, r.id, r.matches))
    for q in queries:
        want, n = plain(places, q)
        own = sorted(got.get(q, []))
        assert [(s, i) for _, s, i, _ in own] == want and all(m == n for *_, m in own) and [k for k, *_ in own] == list(range(1, len(want) + 1)), q
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_nearest_in_a_crowd_and_far_off(spark):
    """Nodes crowded in one spot of the map, on equal places, and few elsewhere."""
    rng = random.Random(9)
    nodes = [(i, -96.34 + rng.random() * 1e-4, 30.61 + rng.random() * 1e-4) for i in range(700)]
    nodes += [(1000 + i, nodes[i][1], nodes[i][2]) for i in range(300)] + [(5000 + i, -96.3 + i / 50, 30.6) for i in range(5)]
    points = [(i, -96.34 + rng.random() * 1e-4, 30.61 + rng.random() * 1e-4) for i in range(40)] + [(100 + i, -96.5 + rng.random(), 30.2 + rng.random()) for i in range(20)]
    df = spark.createDataFrame(nodes, "node_id long, lon double, lat double")
    spots = df.groupBy("lon", "lat").agg(F.min("node_id").alias("node_id"))
    size = campus.cell_size(spots)
    x, y = campus.cell(F.col("lon"), F.col("lat"), size)
    assert size < campus.CELL_DEGREES and spots.groupBy(x, y).count().agg(F.max("count")).first()[0] <= campus.CROWD
    found = campus.nearest(spark.createDataFrame(points, "id long, lon double, lat double"), df, "id").collect()
    whole = spark.createDataFrame(points, "id long, plon double, plat double").crossJoin(df)
    away = F.struct(haversine(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")).alias("d"), "node_id")
    want = {r.id: (r.best.node_id, r.best.d) for r in whole.groupBy("id").agg(F.min(away).alias("best")).collect()}
    assert {r.id: (r.node_id, r.snap_m) for r in found} == want


def test_numbers_follow_the_order(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice("abc"), rng.random()) for i in range(500)]
    got = graph.numbered(spark.createDataFrame(rows, "id long, g string, v double"), [F.col("g"), F.desc("v")], "n").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.n)] == [r[0] for r in sorted(rows, key=lambda r: (r[1], -r[2]))] and sorted(r.n for r in got) == list(range(1, 501))
    assert graph.numbered(spark.createDataFrame([], "id long"), [F.col("id")], "n").count() == 0


def test_components_of_a_star_and_a_chain(spark):
    edges = [(1000, i) for i in range(200)] + [(2000 + i, 2001 + i) for i in range(60)] + [(5, 5), (7000, 7001)]
    got = {r.node_id: r.component for r in graph.connected(spark.createDataFrame(edges, "lo long, hi long")).collect()}
    assert got == {**dict.fromkeys([*range(200), 1000], 0), **dict.fromkeys(range(2000, 2061), 2000), 7000: 7000, 7001: 7000}


def test_components_of_neighbours_take_no_rounds(spark, monkeypatch):
    """A way through hundreds of nodes and a graph whose ids say nothing: looked at whole, piece by piece, and in rounds alone, with the same components. The first writes a fixed number of tables."""
    rng = random.Random(1)
    long_way = [(i, i + 1) for i in range(400) if i != 170]
    scattered = [(rng.randrange(400) * 7, rng.randrange(400) * 7) for _ in range(300)]
    written = []
    kept = graph.kept
    monkeypatch.setattr(graph, "kept", lambda df, name: written.append(name) or kept(df, name))
    for edges in (long_way, scattered):
        df = spark.createDataFrame(edges, "lo long, hi long")
        least = {x: x for e in edges if e[0] != e[1] for x in e}
        for _ in range(len(least)):
            before = dict(least)
            for a, b in edges:
                if a != b:
                    least[a] = least[b] = min(least[a], least[b])
            if least == before:
                break
        del written[:]
        assert {r.node_id: r.component for r in graph.connected(df).collect()} == least
        assert len(written) <= 4
        got = [tuple(r) for r in graph.connected(df, most=20).collect()]
        assert len(got) == len(least) and dict(got) == least
    assert graph.connected(spark.createDataFrame([(3, 3)], "lo long, hi long")).count() == 0
