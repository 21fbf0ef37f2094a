"""What must not grow with the input: plans and partitions, on small graphs."""

import pytest

from motifloom import queries


@pytest.mark.parametrize("name", ["oriented_edges", "graph_stats", "triangles_by_vertex", "motif3_census", "work_by_root", "work_by_degree"])
def test_edges_are_not_broadcast(spark, data, name):
    plan = queries.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "BroadcastHashJoin" not in plan


def test_edges_are_not_broadcast_beside_ranks(spark, data):
    # Only the partitions' offsets are.
    for name in ("degree_relabel", "dense_ids"):
        plan = queries.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("SortMergeJoin") == 2


def test_rows_go_once_to_each_block(spark, monkeypatch):
    """A row with many ids is looked up by blocks: more than one of them, and ids in pieces, give what a join does."""
    from pyspark.sql import functions as F

    from motifloom import Graph, Pattern
    from motifloom.operators import lookup
    from motifloom.operators.match import match

    # A wheel with many spokes, and two cliques that share vertices.
    pairs = [(0, k) for k in range(1, 60)] + [(k, k % 59 + 1) for k in range(1, 60)] + [(a, b) for b in range(106) for a in range(100, b)] + [(a, b) for b in range(5) for a in range(b)]
    edges = spark.createDataFrame(pairs, "src long, dst long")
    shapes = [("triangle", "edge"), ("p1", "vertex"), ("rectangle", "edge"), ("diamond", "vertex"), ("house", "edge")]
    want = {s: match(Graph.from_edges(edges), Pattern.named(s[0]), s[1], executor="join").first()["n"] for s in shapes}
    for size in (512 << 20, 6_000):
        monkeypatch.setattr(lookup, "BLOCK_BYTES", size)
        monkeypatch.setattr(lookup, "PIECE", 7)
        g = Graph.from_edges(edges)
        assert (g.lists().blocks > 1) == (size == 6_000)
        for s in shapes:
            assert match(g, Pattern.named(s[0]), s[1]).first()["n"] == want[s], s
        assert g.triangles_by_vertex().agg(F.sum("triangles")).first()[0] == 3 * want["triangle", "edge"]
    plan = match(Graph.from_edges(edges), Pattern.named("triangle"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 2 and "v1" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)


def test_more_input_is_dealt_into_more_partitions(spark, monkeypatch):
    """A task's share of edges, neighbour lists and changes doesn't grow with the input."""
    from pyspark.sql import functions as F

    from motifloom import Graph
    from motifloom.sources import edges as sources

    monkeypatch.setattr(sources, "PART_BYTES", 8_000)  # a thousand ids
    for n in (20_000, 80_000):
        pairs = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1).alias("add"))
        g = Graph.from_edges(pairs, "a", "b")
        for df in (g.edges, g.adj(), sources.changes(pairs)):
            assert f", {n // 1000}), REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()
        assert g.edges.count() == 2 * n and sources.changes(pairs).count() == n
    local = spark.createDataFrame([(1, 2)], "src long, dst long")  # of unknown size
    assert "REPARTITION_BY_NUM" not in Graph.from_edges(local).edges._jdf.queryExecution().executedPlan().toString()
