"""Counting and enumerating, against golden counts, closed forms, identities and brute force."""

import itertools
import math
import random

import pytest

from motifloom import Graph, Pattern, count, enumerate_matches
from motifloom.operators.delta import delta_count
from motifloom.operators.graph import global_rank
from motifloom.operators.match import count_all, motif_census, worth_narrowing
from motifloom.operators.profile import timed, work_by
from motifloom.plans.planner import GraphStats, make_plan, unrestricted
from motifloom.plans.symmetry import automorphisms
from motifloom.queries import graph as query_graph
from motifloom.sources import edges as sources

GOLD = {"triangle": (226, 226), "p1": (43, 43), "p2": (102, 5), "p3": (200, 44), "p4": (5, 5), "p5": (24, 0), "p6": (103, 31), "p7": (345, 187), "p8": (0, 0), "rectangle": (353, 127), "diamond": (355, 97), "pentagon": (1316, 499), "house": (1392, 522), "hourglass": (1, 1)}


@pytest.fixture(scope="module")
def q(spark, data):
    return query_graph(spark, data).persist()


def edges_of(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def brute(pairs, p, induced, labels=None):
    near = {frozenset(e) for e in pairs if e[0] != e[1]}
    ids = sorted({x for e in near for x in e})
    n = 0
    for f in itertools.permutations(ids, p.n):
        ok = all((frozenset((f[a], f[b])) in near) if p.has(a, b) else (induced == "edge" or frozenset((f[a], f[b])) not in near) for a in range(p.n) for b in range(a))
        n += ok and all(p.label(a) is None or labels[f[a]] == p.label(a) for a in range(p.n))
    return n // len(automorphisms(p))


@pytest.mark.parametrize("name", ["triangle", "p2", "p3", "p5", "p7", "house", "hourglass"])
def test_golden(q, name):
    edge, vertex = GOLD[name]
    p = Pattern.named(name)
    assert count(q, p) == edge
    assert count(q, p, induced="vertex") == vertex
    assert count(q, p, iep=True) == edge


@pytest.mark.parametrize("name", ["p3", "house", "p6"])
def test_executors_and_pruning_agree(q, name):
    p = Pattern.named(name)
    assert count(q, p, executor="join") == GOLD[name][0]
    assert count(q, p, executor="join", induced="vertex") == GOLD[name][1]
    hubs = GraphStats(1000, 20_000, 5_000, 900)
    for pruning, stats in (("none", None), ("static", None), ("eager", None), ("online", None), ("cost", None), ("cost", hubs)):
        assert count(q, p, pruning=pruning, induced="vertex", stats=stats) == GOLD[name][1]


def test_narrowing_pays_by_vertex(q):
    """The cost rule decides apart for each vertex, and its plans differ."""
    plan = make_plan(Pattern.named("p6"))
    sparse, dense, hubs = GraphStats(20_000, 120_000, 17_000, 23), GraphStats(2000, 230_000, 410_000, 206), GraphStats(1000, 20_000, 5_000, 900)
    pays = [{t for t in range(plan.pattern.n) if worth_narrowing(plan, t, s)} for s in (sparse, dense, hubs)]
    assert pays[0] < pays[2] == set(range(plan.pattern.n)) and pays[0] <= pays[1]
    from motifloom.operators.match import run_plan

    text = lambda **o: run_plan(q, plan, **o)._jdf.queryExecution().optimizedPlan().toString().count("array_intersect")
    assert text(pruning="eager") >= text(pruning="online") and text(pruning="cost", stats=sparse) != text(pruning="cost", stats=hubs)


def test_cost_based_plan_and_unrestricted(q):
    from motifloom.operators.match import run_plan

    p = Pattern.named("p3")
    assert count(q, p, stats=q.stats()) == GOLD["p3"][0]
    assert run_plan(q, unrestricted(p), executor="array").first()["n"] == GOLD["p3"][0]


def test_complete_graph(spark):
    g = Graph.complete(spark, 7).persist()
    for name in ("triangle", "p2", "p4", "p6", "p8", "house"):
        p = Pattern.named(name)
        want = math.factorial(7) // math.factorial(7 - p.n) // len(automorphisms(p))
        assert count(g, p) == want
        assert count(g, p, induced="vertex") == (want if len(p.edges) == p.n * (p.n - 1) // 2 else 0)


def test_random_graphs(spark):
    rng = random.Random(5)
    pairs = [(a, b) for a in range(9) for b in range(a) if rng.random() < 0.5]
    g = Graph.from_edges(edges_of(spark, pairs)).persist()
    for p in (Pattern.named("rectangle"), Pattern.named("house"), Pattern.of(4, [(0, 1), (0, 2), (0, 3)]), Pattern.of(3, [(0, 1), (1, 2)])):
        for induced in ("edge", "vertex"):
            want = brute(pairs, p, induced)
            assert count(g, p, induced=induced) == want
            assert count(g, p, induced=induced, executor="join") == want
        assert count(g, p, iep=True) == brute(pairs, p, "edge")


def test_identities(q):
    n = {name: GOLD[name] for name in GOLD}
    assert n["diamond"][0] == n["diamond"][1] + 6 * n["p1"][0]
    census = {r["motif"]: r["n"] for r in motif_census(q, 4).collect()}
    assert len(census) == 6
    assert census[Pattern.clique(4).to_matrix()] == 43
    stats = q.stats()
    assert stats.triangles == 226
    assert q.triangles_by_vertex().agg({"triangles": "sum"}).first()[0] == 3 * 226
    assert q.oriented().count() * 2 == stats.edges


def test_enumerate(q):
    rows = enumerate_matches(q, Pattern.named("house")).collect()
    assert len(rows) == GOLD["house"][0] == len(set(rows))
    near = {tuple(r) for r in q.edges.collect()}
    p = Pattern.named("house")
    assert all((r[a], r[b]) in near for r in rows for a, b in p.edges)
    assert enumerate_matches(q, p, limit=7).count() == 7
    assert enumerate_matches(q, p, executor="join").count() == len(rows)


def test_labels(spark):
    rng = random.Random(8)
    pairs = [(a, b) for a in range(9) for b in range(a) if rng.random() < 0.6]
    labels = {a: a % 3 for a in range(9)}
    g = Graph.from_edges(edges_of(spark, pairs), labels=spark.createDataFrame(list(labels.items()), "id long, label int"))
    for name, some in (("triangle", (0, 1, None)), ("diamond", (0, None, None, 2)), ("rectangle", (1, 1, None, 2))):
        p = Pattern.named(name).with_labels(some)
        for induced in ("edge", "vertex"):
            for executor in ("array", "join"):
                assert count(g, p, induced=induced, executor=executor) == brute(pairs, p, induced, labels)
    with pytest.raises(ValueError):
        count(Graph.from_edges(edges_of(spark, pairs)), Pattern.clique(3).with_labels((1, 1, 1)))


def test_degenerate_graphs(spark):
    none = Graph.from_edges(edges_of(spark, []))
    assert count(none, Pattern.clique(3)) == 0 == count(none, Pattern.named("p3"), iep=True)
    assert none.stats().vertices == 0
    one = Graph.from_edges(edges_of(spark, [(1, 2), (2, 1), (1, 1), (None, 3), (1, 2)]))
    assert one.edges.count() == 2
    assert count(one, Pattern.clique(3)) == 0
    big = 2**40
    two = Graph.from_edges(edges_of(spark, [(big + 1, 2), (2, 3), (big + 1, 3), (3, 4), (2, 4)]))
    assert (count(two, Pattern.clique(3)), count(two, Pattern.named("diamond"), induced="vertex")) == (2, 1)
    assert (count(two, Pattern.named("rectangle")), count(two, Pattern.named("rectangle"), induced="vertex")) == (1, 0)


def test_relabelling_keeps_counts(q):
    again = q.relabel_by_degree()
    assert count(again, Pattern.named("p3")) == GOLD["p3"][0]
    top = again.degrees().orderBy("id").limit(1).first()["degree"]
    assert top == q.stats().max_degree


def test_global_rank_is_gapless(spark):
    from pyspark.sql import functions as F

    ranks = global_rank(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("id")), [F.col("id")])
    assert [r["rank"] for r in ranks.orderBy("id").collect()] == list(range(1000))


@pytest.mark.parametrize(("name", "induced", "labels"), [("triangle", "edge", None), ("rectangle", "edge", None), ("p3", "edge", None), ("triangle", "vertex", None), ("rectangle", "vertex", None), ("diamond", "vertex", None), ("triangle", "edge", (0, 1, None)), ("rectangle", "vertex", (0, None, 1, None))])
def test_delta(spark, name, induced, labels):
    rng = random.Random(4)
    pairs = [(a, b) for a in range(10) for b in range(a) if rng.random() < 0.5]
    marks = spark.createDataFrame([(a, a % 3) for a in range(10)], "id long, label int")
    g = Graph.from_edges(edges_of(spark, pairs), labels=marks if labels else None)
    batch = sources.changes(spark.createDataFrame([(a, b, int(rng.random() < 0.5)) for a in range(10) for b in range(a) if rng.random() < 0.2], "a long, b long, add int"))
    p = Pattern.named(name).with_labels(labels) if labels else Pattern.named(name)
    d = delta_count(g, batch, p, induced).first()
    assert count(g.changed(batch), p, induced=induced) - count(g, p, induced=induced) == d["change"] == d["added"] - d["removed"]


def test_delta_far_from_the_batch(spark):
    """Only the batch's surroundings are read: a long path and a triangle at its end."""
    g = Graph.from_edges(edges_of(spark, [(k, k + 1) for k in range(60)]))
    batch = sources.changes(spark.createDataFrame([(58, 60, 1), (0, 1, 0)], "a long, b long, add int"))
    assert delta_count(g, batch, Pattern.clique(3)).first().asDict() == {"removed": 0, "added": 1, "change": 1}
    three = Pattern.of(4, [(0, 1), (1, 2), (2, 3)])
    d = delta_count(g, batch, three).first()
    assert count(g.changed(batch), three) - count(g, three) == d["change"]


def test_a_hub(spark):
    """A star with a clique at its centre: both executors, and candidate sets narrowed by the cost rule."""
    pairs = [(0, k) for k in range(1, 20_000)] + [(a, b) for a in range(1, 6) for b in range(a)]
    g = Graph.from_edges(edges_of(spark, pairs)).persist()
    for executor in ("array", "join"):
        assert count(g, Pattern.clique(4), executor=executor) == 15
    assert count(g, Pattern.clique(4), pruning="cost", stats=g.stats()) == 15


def test_several_and_work(q):
    rows = {r["pattern"]: r["n"] for r in count_all(q, {n: Pattern.named(n) for n in ("p1", "p3")}).collect()}
    assert rows == {"p1": 43, "p3": 200}
    plan = make_plan(Pattern.clique(3))
    work = work_by(q, plan, "degree").where("loop = 3").agg({"matches": "sum"}).first()[0]
    assert work == 226
    assert timed(q, plan, runs=1)["n"] == 226


def test_no_python_and_pushed_filters(spark, data):
    from motifloom.operators.match import match

    plan = match(query_graph(spark, data), Pattern.named("p3"), iep=True)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert "PushedFilters: [IsNotNull(l_quantity)" in plan
    assert "l_comment" not in plan.split("== Physical Plan ==")[1]
