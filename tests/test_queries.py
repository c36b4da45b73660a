"""Every query that has SQL gives the same rows as it."""

import pytest
from compare import check

from penumbra import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, name):
    check(spark, sf, QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", ["tree_geojson", "shadow_outline", "building_map", "building_geojson"])
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_path_nodes_are_ways(spark, sf):
    """Consecutive nodes of a path are joined by an edge."""
    from penumbra.plans.tables import edges

    joined = {(r.lo, r.hi) for r in edges(spark, sf).collect()}
    steps = {}
    for r in QUERIES["path_nodes"](spark, sf).collect():
        steps.setdefault(r.request, []).append((r.steps, r.node_id))
    assert steps
    for way in steps.values():
        nodes = [n for _, n in sorted(way)]
        assert [s for s, _ in sorted(way)] == list(range(len(way)))
        assert all((min(p), max(p)) in joined for p in zip(nodes, nodes[1:], strict=False))
