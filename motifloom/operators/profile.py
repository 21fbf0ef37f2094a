"""Statistics of graphs, and of the work that a match takes."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.functions import sets
from motifloom.operators.graph import Graph
from motifloom.operators.match import run_plan, with_last
from motifloom.plans.planner import MatchPlan

# Deviations above the mean at which degrees are cut.
FACTORS = (0.0, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 5.0, 10.0)


def degree_histogram(graph: Graph) -> DataFrame:
    return graph.degrees().groupBy("degree").agg(F.count("*").alias("vertices"))


def degree_summary(graph: Graph) -> DataFrame:
    """One row: ``mean`` and ``deviation`` (population) of degrees."""
    return graph.degrees().agg(F.avg("degree").alias("mean"), F.stddev_pop("degree").alias("deviation"))


def degree_classes(graph: Graph, factors: tuple[float, ...] = FACTORS) -> DataFrame:
    """For each factor f: directed edges between low and high vertices, and the vertices, edges and squared degrees of each class.

    High is a degree above floor(mean + f * deviation).
    """
    d = graph.degrees()
    cuts = degree_summary(graph).select(F.explode(F.array(*map(F.lit, factors))).alias("factor"), "mean", "deviation").select("factor", F.floor(F.col("mean") + F.col("factor") * F.col("deviation")).alias("threshold"))
    marks = cuts.agg(F.collect_list(F.struct("factor", "threshold")).alias("cuts"))  # one row of as many cuts as factors
    near = d.select(F.col("id").alias("src"), F.col("degree").alias("ds"))
    far = d.select(F.col("id").alias("dst"), F.col("degree").alias("dd"))
    # Edges are few kinds of degree pairs: they are counted before cuts multiply them.
    kinds = graph.edges.join(near, "src").join(far, "dst").groupBy("ds", "dd").agg(F.count("*").alias("n"))
    long = lambda c: F.sum(c).cast("long")
    pairs = kinds.join(F.broadcast(marks)).select("ds", "dd", "n", F.explode("cuts").alias("cut")).select("*", "cut.*")
    high = lambda c: F.col(c) > F.col("threshold")
    edges = pairs.groupBy("factor", "threshold").agg(long(F.when(~high("ds") & ~high("dd"), F.col("n")).otherwise(0)).alias("low_low"), long(F.when(high("ds") != high("dd"), F.col("n")).otherwise(0)).alias("low_high"), long(F.when(high("ds") & high("dd"), F.col("n")).otherwise(0)).alias("high_high"))
    sizes = d.groupBy("degree").agg(F.count("*").alias("n")).join(F.broadcast(marks)).select("degree", "n", F.explode("cuts").alias("cut")).select("degree", "n", "cut.*")
    up = F.col("degree") > F.col("threshold")
    part = lambda name, what: [long(F.when(~up, what).otherwise(0)).alias(f"low_{name}"), long(F.when(up, what).otherwise(0)).alias(f"high_{name}")]
    vertices = sizes.groupBy("factor", "threshold").agg(*part("vertices", F.col("n")), *part("edges", F.col("n") * F.col("degree")), *part("squares", F.col("n") * F.col("degree") * F.col("degree")))
    return edges.join(vertices, ["factor", "threshold"])


def pair_set_stats(graph: Graph) -> DataFrame:
    """``measure``, ``mean`` and ``most`` of the neighbour sets of vertices and of the ends of directed edges."""
    lists = graph.lists()
    adj = lists.table
    v = adj.agg(F.count("*").alias("v")).select("v")
    # Each edge in one direction: in the other one left and right change places.
    near = adj.select(F.col("id").alias("src"), F.col("nbrs").alias("a"), sets.bounded("nbrs", "id").alias("ids"))
    both = lists.beside(near, "dst", {"nbrs": "b"}, ["src"])
    common = F.size(F.array_intersect("a", "b"))
    sized = both.select(F.size("a").alias("na"), F.size("b").alias("nb"), common.alias("both"))
    sized = sized.select((F.col("na") + F.col("nb") - F.col("both")).alias("union"), "both", (F.col("na") - F.col("both")).alias("left"), (F.col("nb") - F.col("both")).alias("right"))
    names = ["union", "both", "left", "right"]
    half, top = F.avg(F.col("left") + F.col("right")) / 2, F.max(F.greatest("left", "right")).cast("long")
    edge_row = sized.agg(*[F.avg(n).alias(f"mean_{n}") for n in names[:2]], *[half.alias(f"mean_{n}") for n in names[2:]], *[F.max(n).cast("long").alias(f"most_{n}") for n in names[:2]], *[top.alias(f"most_{n}") for n in names[2:]])
    edge_part = edge_row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(f"mean_{n}").alias("mean"), F.col(f"most_{n}").alias("most")) for n in names])).alias("x")).select("x.*")
    size = adj.select(F.size("nbrs").cast("long").alias("d")).join(F.broadcast(v)).select("d", (F.col("v") - F.col("d")).alias("rest"))
    vertex_row = size.agg(F.avg("d").alias("mean_d"), F.max("d").alias("most_d"), F.avg("rest").alias("mean_r"), F.max("rest").alias("most_r"))
    vertex_part = vertex_row.select(F.explode(F.array(F.struct(F.lit("neighbours").alias("measure"), F.col("mean_d").alias("mean"), F.col("most_d").alias("most")), F.struct(F.lit("complement").alias("measure"), F.col("mean_r").alias("mean"), F.col("most_r").alias("most")))).alias("x")).select("x.*")
    return vertex_part.unionByName(edge_part)


def work_by_root(graph: Graph, plan: MatchPlan) -> DataFrame:
    """``loop``, ``id``: how many partial matches of each length start at a root, and the neighbours read for them."""
    d = graph.degree_lookup()
    out = None
    for k in range(2, plan.pattern.n + 1):
        part = MatchPlan(plan.query, plan.order, plan.pattern.ordered(range(plan.pattern.n)), plan.restrictions, plan.induced)
        rows = d.beside(with_last(graph, _first(part, k)).select("v0", "ids"), f"v{k - 1}", {"degree": "degree"}, ["v0"])
        one = rows.groupBy(F.col("v0").alias("id")).agg(F.count("*").alias("matches"), F.sum("degree").alias("neighbours_read")).select(F.lit(k).alias("loop"), "id", "matches", "neighbours_read")
        out = one if out is None else out.unionByName(one)
    return out


def _first(plan: MatchPlan, k: int) -> MatchPlan:
    """The plan's first k vertices."""
    from motifloom.plans.pattern import Pattern

    p = plan.pattern
    head = Pattern(k, frozenset(e for e in p.edges if max(e) < k), p.labels[:k] if p.labels else None)
    return MatchPlan(head, tuple(range(k)), head, tuple(r for r in plan.restrictions if max(r) < k), plan.induced)


def work_by(graph: Graph, plan: MatchPlan, key: str) -> DataFrame:
    """``work_by_root`` summed by the root's ``degree``, ``lower_degree`` or ``triangles``."""
    by = graph.triangles_by_vertex() if key == "triangles" else graph.adj().select("id", key)
    return work_by_root(graph, plan).join(by, "id").groupBy("loop", key).agg(F.count("*").alias("roots"), F.sum("matches").alias("matches"), F.sum("neighbours_read").alias("neighbours_read"))


def timed(graph: Graph, plan: MatchPlan, runs: int = 3, **options) -> dict[str, float]:
    """Result, runs, least, mean, greatest and deviation of the seconds of a count."""
    seconds, n = [], 0
    for _ in range(runs):
        start = time.perf_counter()
        n = run_plan(graph, plan, **options).first()["n"]
        seconds.append(time.perf_counter() - start)
    mean = sum(seconds) / runs
    return {"n": n, "runs": runs, "min": min(seconds), "mean": mean, "max": max(seconds), "std": (sum((s - mean) ** 2 for s in seconds) / runs) ** 0.5}
