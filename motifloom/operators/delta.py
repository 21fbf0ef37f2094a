"""Counts after a batch of edge changes, from the changes alone.

A match is made or broken by a batch only if one of its pairs of vertices
changes: a pattern edge whose image is added or removed, or, vertex-induced, a
pair without a pattern edge. Each search starts from the batch, and looks only at
the part of the graph that such matches can reach.

Matches are enumerated with the pattern's pairs in a fixed order: each is found at
its first changed pair. Edge-induced ones are counted with fewer searches, one for
each kind of edge that automorphisms tell apart, before and after at once: a match
with c changed edges is found from each of them, so it counts a c-th each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.operators.graph import Graph
from motifloom.operators.match import join_stages, label_table
from motifloom.plans.pattern import Pattern
from motifloom.plans.planner import INDUCED, MatchPlan, make_plan
from motifloom.plans.symmetry import automorphisms
from motifloom.sources.scratch import written


def _both(batch: DataFrame) -> DataFrame:
    return batch.select("src", "dst").union(batch.select("dst", "src"))


def effective(graph: Graph, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(removed, added) edges in both directions: removals that are in the graph, additions that aren't."""
    removed = _both(batch.where("add = 0")).join(graph.edges, ["src", "dst"], "left_semi")
    added = _both(batch.where("add > 0")).join(graph.edges, ["src", "dst"], "left_anti")
    return removed, added


def _reach(pattern: Pattern, pairs: list[tuple[int, int]]) -> int:
    """The most steps along pattern edges from either end of one of ``pairs`` to any vertex."""
    most = 0
    for pair in pairs:
        seen, edge, steps = set(pair), set(pair), 0
        while len(seen) < pattern.n:
            edge = {b for a in edge for b in pattern.neighbours(a)} - seen
            seen |= edge
            steps += 1
        most = max(most, steps)
    return most


def _order_from(pattern: Pattern, a: int, b: int) -> list[int]:
    """The pattern's vertices from a and b on, always the one with most neighbours so far."""
    order = [a, b]
    while len(order) < pattern.n:
        rest = [v for v in range(pattern.n) if v not in order]
        order.append(max(rest, key=lambda v: (sum(pattern.has(v, o) for o in order), pattern.degree(v), -v)))
    return order


def _around(edges: DataFrame, ends: DataFrame, steps: int) -> DataFrame:
    """The edges between vertices that are at most so many steps from ``ends`` (``id``)."""
    ball = ends
    for _ in range(steps):
        near = edges.join(ball.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("dst").alias("id"))
        ball = ball.union(near).distinct()
    inside = ball.select(F.col("id").alias("src"))
    return edges.join(inside, "src", "left_semi").join(inside.select(F.col("src").alias("dst")), "dst", "left_semi").select("src", "dst")


def _through(pattern: Pattern, induced: str, graph: Graph, turned: dict[bool, DataFrame], steady: DataFrame) -> DataFrame:
    """Matches in ``graph`` with a changed pair, one row each as columns u0, u1 ...

    ``turned``: by whether the pair is an edge now, the pairs that changed;
    ``steady``: the edges that didn't. Pairs before the first changed one are
    unchanged, later ones are as they are now.
    """
    pairs = sorted(pattern.edges)
    if induced == "vertex":
        pairs += [(a, b) for b in range(pattern.n) for a in range(b) if not pattern.has(a, b)]
    base = make_plan(pattern, induced)
    held = tuple((base.order[a], base.order[b]) for a, b in base.restrictions)
    either = graph.edges.union(turned[False])
    found = None
    for at, (a, b) in enumerate(pairs):
        order = _order_from(pattern, a, b)
        place = {v: k for k, v in enumerate(order)}
        plan = MatchPlan(pattern, tuple(order), pattern.ordered(order), tuple((place[x], place[y]) for x, y in held), induced)
        rank = lambda j, k, order=order: pairs.index(tuple(sorted((order[j], order[k]))))

        def relation(j: int, k: int, rank=rank, at=at) -> DataFrame:
            if rank(j, k) == at:
                return turned[pattern.has(*pairs[at])]
            return steady if rank(j, k) < at else graph.edges

        def absent(j: int, k: int, rank=rank, at=at) -> DataFrame:
            """What an unchanged, or any, pair without an edge is not in."""
            return either if rank(j, k) < at else graph.edges

        rows = join_stages(graph, plan, relation, absent).select(*[F.col(f"v{place[u]}").alias(f"u{u}") for u in range(pattern.n)])
        found = rows if found is None else found.unionByName(rows)
    return found


def _changed_and_steady(graph: Graph, batch: DataFrame, pattern: Pattern, induced: str) -> tuple[DataFrame, DataFrame]:
    """The batch's effect (``src``, ``dst`` in both directions, ``sign``) and the unchanged edges around it, each written once, as every search reads them."""
    removed, added = effective(graph, batch)
    signed = written(removed.withColumn("sign", F.lit(-1)).union(added.withColumn("sign", F.lit(1))), "delta")
    turned = signed.select("src", "dst")
    pairs = [(a, b) for b in range(pattern.n) for a in range(b)] if induced == "vertex" else sorted(pattern.edges)
    # Matches before and after reach no further than along edges that are there before or after.
    both = graph.edges.union(signed.where("sign > 0").select("src", "dst"))
    around = _around(both, turned.select(F.col("src").alias("id")).distinct(), _reach(pattern, pairs))
    return signed, written(around.join(turned, ["src", "dst"], "left_anti"), "delta")


def delta_matches(graph: Graph, batch: DataFrame, pattern: Pattern, induced: str = "edge") -> DataFrame:
    """Matches that a batch of ``sources.changes`` makes or breaks: u0, u1 ... and ``sign`` (1 or -1). Labels are those of ``graph``."""
    if induced not in INDUCED:
        raise ValueError(f"induced is one of {INDUCED}")
    signed, steady = _changed_and_steady(graph, batch, pattern, induced)
    removed, added = (signed.where(F.col("sign") == x).select("src", "dst") for x in (-1, 1))
    before, after = Graph(steady.union(removed), graph.labels), Graph(steady.union(added), graph.labels)
    lost = _through(pattern, induced, before, {True: removed, False: added}, steady).withColumn("sign", F.lit(-1))
    new = _through(pattern, induced, after, {True: added, False: removed}, steady).withColumn("sign", F.lit(1))
    return lost.unionByName(new)


def _counted(pattern: Pattern, signed: DataFrame, steady: DataFrame, labels: DataFrame | None) -> DataFrame:
    """``sign`` and ``n``: edge-induced matches broken (-1) and made (1)."""
    whole = steady.select("src", "dst", F.explode(F.array(F.lit(-1), F.lit(1))).alias("sign"), F.lit(0).alias("one")).union(signed.select("src", "dst", "sign", F.lit(1)))

    def step(j: int, k: int) -> DataFrame:
        return whole.select("sign", F.col("src").alias(f"v{j}"), F.col("dst").alias(f"v{k}"), "one")

    def marked(rows: DataFrame, k: int, label: int | None) -> DataFrame:
        return rows if labels is None or label is None else rows.join(labels.where(F.col("label") == label).select(F.col("id").alias(f"v{k}")), f"v{k}", "left_semi")

    group, seen, found = automorphisms(pattern), set(), None
    for a, b in sorted(pattern.edges):
        if (a, b) in seen or (b, a) in seen:
            continue
        kind = {(g[a], g[b]) for g in group}
        seen |= kind
        order = _order_from(pattern, a, b)
        shape = pattern.ordered(order)
        # An edge that an automorphism turns round is started from in one direction only.
        rows = signed.where("src < dst") if (b, a) in kind else signed
        rows = rows.select("sign", F.col("src").alias("v0"), F.col("dst").alias("v1"), F.lit(1).alias("c"))
        rows = marked(marked(rows, 0, shape.label(0)), 1, shape.label(1))
        for k in range(2, pattern.n):
            near = [j for j in range(k) if shape.has(j, k)]
            for j in near[::-1]:
                rows = rows.join(step(j, k), ["sign", f"v{j}"] + ([f"v{k}"] if f"v{k}" in rows.columns else [])).withColumn("c", F.col("c") + F.col("one")).drop("one")
                if j == near[-1]:
                    for other in set(range(k)) - set(near):
                        rows = rows.where(F.col(f"v{other}") != F.col(f"v{k}"))
                    rows = marked(rows, k, shape.label(k))
        part = rows.groupBy("sign", "c").agg((F.count("*") * len(kind)).alias("n"))
        found = part if found is None else found.unionByName(part)
    shares = found.groupBy("sign", "c").agg(F.sum("n").alias("n")).select("sign", F.expr(f"n div (c * {len(group)})").alias("n"))
    return shares.groupBy("sign").agg(F.sum("n").alias("n"))


def delta_count(graph: Graph, batch: DataFrame, pattern: Pattern, induced: str = "edge") -> DataFrame:
    """One row: ``removed``, ``added`` and ``change`` of the count."""
    if induced == "edge":
        labels = label_table(graph, pattern)
        told = _counted(pattern, *_changed_and_steady(graph, batch, pattern, induced), labels)
    else:
        told = delta_matches(graph, batch, pattern, induced).groupBy("sign").agg(F.count("*").alias("n"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    sign = F.col("sign")
    return told.agg(total(F.when(sign < 0, F.col("n"))).alias("removed"), total(F.when(sign > 0, F.col("n"))).alias("added"), total(sign * F.col("n")).alias("change"))
