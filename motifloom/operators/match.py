"""Matching a pattern: staged DataFrame plans for counting and enumerating.

Two executors give the same results. ``array`` carries candidate arrays beside
each partial match and counts the last vertex without making rows for it; it
needs each vertex's neighbours in one array. ``join`` keeps to rows: an inner
join adds a vertex, left-semi joins check further edges and left-anti joins
check absent ones, so the degree of a vertex is no bound.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.functions import sets
from motifloom.operators.graph import Graph
from motifloom.plans.pattern import Pattern
from motifloom.plans.planner import PRUNING, GraphStats, MatchPlan, inclusion_exclusion, make_plan

EXECUTORS = ("array", "join")


def _checks(plan: MatchPlan, k: int) -> list[Column]:
    v = F.col(f"v{k}")
    return [v < F.col(f"v{a}") for a in plan.above(k)] + [v > F.col(f"v{b}") for b in plan.below(k)] + [v != F.col(f"v{j}") for j in plan.unequal(k)]


# --- rows ------------------------------------------------------------------


def join_stages(graph: Graph, plan: MatchPlan, relation: Callable[[int, int], DataFrame] | None = None, absent: Callable[[int, int], DataFrame] | None = None) -> DataFrame:
    """All matches of ``plan`` as columns v0, v1 ...

    ``relation(a, b)`` gives the pairs that vertices a and b must come from: the
    edges for a pattern edge, and for vertices 0 and 1 always; ``absent(a, b)``
    the pairs that they must not be, vertex-induced, without a pattern edge.
    """
    relation = relation or (lambda a, b: graph.edges)
    absent = absent or (lambda a, b: graph.edges)
    labels = label_table(graph, plan.pattern)
    first = relation(0, 1).select(F.col("src").alias("v0"), F.col("dst").alias("v1"))
    rows = _filtered(first, _checks(plan, 1))
    for k in (0, 1):
        rows = _with_label(rows, labels, plan.pattern, k)
    for k in range(2, plan.pattern.n):
        near = plan.earlier(k)
        edges = relation(near[-1], k).select(F.col("src").alias(f"v{near[-1]}"), F.col("dst").alias(f"v{k}"))
        rows = _filtered(rows.join(edges, f"v{near[-1]}"), _checks(plan, k))
        rows = _with_label(rows, labels, plan.pattern, k)
        for j in near[:-1]:
            rows = rows.join(relation(j, k).select(F.col("src").alias(f"v{j}"), F.col("dst").alias(f"v{k}")), [f"v{j}", f"v{k}"], "left_semi")
        if plan.induced == "vertex":
            for j in plan.apart(k):
                rows = rows.join(absent(j, k).select(F.col("src").alias(f"v{j}"), F.col("dst").alias(f"v{k}")), [f"v{j}", f"v{k}"], "left_anti")
    return rows.select(*[f"v{k}" for k in range(plan.pattern.n)])


def _filtered(rows: DataFrame, checks: list[Column]) -> DataFrame:
    for c in checks:
        rows = rows.where(c)
    return rows


def label_table(graph: Graph, pattern: Pattern) -> DataFrame | None:
    """The graph's labels, if the pattern has any."""
    if not pattern.labels or all(x is None for x in pattern.labels):
        return None
    if graph.labels is None:
        raise ValueError("the pattern has labels, the graph hasn't")
    return graph.labels


def _with_label(rows: DataFrame, labels: DataFrame | None, pattern: Pattern, k: int) -> DataFrame:
    if labels is None or pattern.label(k) is None:
        return rows
    return rows.join(labels.where(F.col("label") == pattern.label(k)).select(F.col("id").alias(f"v{k}")), f"v{k}", "left_semi")


# --- arrays ----------------------------------------------------------------


class _Arrays:
    """Stages of the array executor: columns v0 ..., a0 ... (neighbours) and c3 ... (candidates of later vertices so far)."""

    def __init__(self, graph: Graph, plan: MatchPlan, pruning: str, stats: GraphStats | None):
        if pruning not in PRUNING:
            raise ValueError(f"pruning is one of {PRUNING}")
        self.plan, self.pattern = plan, plan.pattern
        n = self.pattern.n
        self.ahead = {"none": 0, "static": 1}.get(pruning, n)
        self.at_once = pruning == "eager"
        # Later vertices whose candidates are worth narrowing ahead of their turn.
        self.narrowed = set(range(n))
        if pruning == "cost":
            stats = stats or graph.stats()
            self.narrowed = {t for t in range(n) if worth_narrowing(plan, t, stats)}
        self.labelled = label_table(graph, self.pattern) is not None
        self.graph = graph
        self.inner = self.pattern.n - max(1, plan.suffix)
        self.over: list[set[int]] = []
        for k in range(n):  # all earlier vertices whose ids are greater, restrictions that follow from others included
            self.over.append(set().union(*[{a} | self.over[a] for a in plan.above(k)]))
        self.upper = [self.bounds(j) for j in range(n)]
        # Where every list is read below its own vertex only, no more of it is looked up.
        self.which = "labelled" if self.labelled else "below" if all(j in self.upper[j] for j in range(self.inner) if self.later(j, j)) else "all"

    def nbrs(self, j: int, k: int) -> Column:
        """Neighbours of v_j that may be v_k."""
        a = F.col(f"a{j}")
        if not self.labelled:
            return a
        empty = F.array().cast("array<bigint>")
        label = self.pattern.label(k)
        if label is None:
            return F.flatten(F.map_values(a))
        return F.coalesce(F.element_at(a, F.lit(label)), empty)

    def later(self, j: int, k: int) -> list[int]:
        """Vertices after k whose candidates need the neighbours of j."""
        return [t for t in range(k + 1, self.pattern.n) if self.pattern.has(j, t) or self.plan.induced == "vertex"]

    def bounds(self, j: int) -> set[int]:
        """Vertices up to j that all vertices after j, whose candidates need the neighbours of j, must be below."""
        found = [{a for a in self.over[t] if a <= j} for t in self.later(j, j)]
        return self.least(set.intersection(*found)) if found else set()

    def least(self, vertices: set[int]) -> set[int]:
        """Without those that are greater than another one."""
        return vertices - set().union(*[self.over[b] for b in vertices])

    def candidates(self, k: int, upto: int, held: dict[int, int]) -> Column:
        """Candidates of v_k as far as vertices before ``upto`` tell; ``held[k]``: those that column c_k already has."""
        done = held.get(k, 0)
        near = [self.nbrs(j, k) for j in self.plan.earlier(k) if done <= j < upto]
        out = sets.intersect_all([F.col(f"c{k}"), *near] if done else near)
        if self.plan.induced == "vertex":
            for j in self.plan.apart(k):
                if done <= j < upto:
                    out = F.array_except(out, self.nbrs(j, k))
        return out

    def bounded(self, k: int, cand: Column, known: int) -> Column:
        """With the id checks that vertices before ``known`` allow."""
        told = set() if self.labelled else set().union(*[self.upper[j] for j in self.plan.earlier(k) if j < known])
        above = [F.col(f"v{a}") for a in sorted(self.least({a for a in self.plan.above(k) if a < known}) - told)]
        below = [F.col(f"v{b}") for b in self.plan.below(k) if b < known]
        unequal = [F.col(f"v{j}") for j in self.plan.unequal(k) if j < known]
        if above:
            top = F.least(*above) if len(above) > 1 else above[0]
            cand = F.filter(cand, lambda x: x < top)
        if below:
            low = F.greatest(*below) if len(below) > 1 else below[0]
            cand = F.filter(cand, lambda x: x > low)
        return sets.without(cand, unequal)

    def rows(self) -> tuple[DataFrame, dict[int, int]]:
        """Matches of the first ``inner`` vertices with what the others need."""
        held: dict[int, int] = {}
        lists = self.graph.lists(self.which)
        rows = lists.table.select(F.col("id").alias("v0"), F.col("nbrs").alias("a0"))
        if self.labelled and self.pattern.label(0) is not None:
            rows = rows.join(self.graph.labels.where(F.col("label") == self.pattern.label(0)).select(F.col("id").alias("v0")), "v0", "left_semi")
        rows, held = self.advance(self.shortened(rows, 0), 1, held)
        for k in range(1, self.inner):
            cand = self.bounded(k, self.candidates(k, k, held), k)
            rows = rows.withColumn("ids", cand)
            rows = rows.select(*[c for c in rows.columns if c != f"c{k}" and (c[0] != "a" or self.later(int(c[1:]), k))])
            if self.later(k, k):
                rows = lists.beside(rows, f"v{k}", {"nbrs": f"a{k}"}, [f"v{j}" for j in range(k)])
                rows = self.shortened(rows, k)
            else:
                rows = rows.withColumn(f"v{k}", F.explode("ids")).drop("ids")
            rows, held = self.advance(rows, k + 1, held)
        return rows, held

    def shortened(self, rows: DataFrame, j: int) -> DataFrame:
        """Without the neighbours of v_j that no later vertex can be."""
        upper = self.upper[j] - ({j} if self.which == "below" else set())
        if self.labelled or not upper:
            return rows
        top = F.least(*[F.col(f"v{a}") for a in sorted(upper)]) if len(upper) > 1 else F.col(f"v{min(upper)}")
        return rows.withColumn(f"a{j}", sets.bounded(f"a{j}", top))

    def advance(self, rows: DataFrame, known: int, held: dict[int, int]) -> tuple[DataFrame, dict[int, int]]:
        """Narrow the candidates of the next vertices by what v_(known-1) tells, and stop where none are left."""
        if known == self.pattern.n - 1:
            return rows, held  # the last vertex's candidates are read once, where they are counted
        held = dict(held)
        out = {}
        for t in range(known, min(self.pattern.n, known + self.ahead)):
            told = [j for j in self.plan.earlier(t) if held.get(t, 0) <= j < known]
            if told and t in self.narrowed:
                if t not in held and len(told) == 1 and not self.at_once:
                    continue  # made when it is first read: so far it would be a neighbour list that is carried already
                cand = self.candidates(t, known, held)
                out[f"c{t}"] = cand
                held[t] = known
        if not out:
            return rows, held
        rows = rows.withColumns(out)
        for name in out:
            rows = rows.where(F.size(name) > 0)
        return rows, held

    def counted(self) -> DataFrame:
        rows, held = self.rows()
        plan, n = self.plan, self.pattern.n
        if plan.suffix <= 1:
            k = n - 1
            each = F.size(self.bounded(k, self.candidates(k, k, held), k)).cast("long")
            total = F.coalesce(F.sum(each), F.lit(0)).cast("long")
            return rows.agg(total.alias("n")) if plan.multiplicity == 1 else rows.agg(total.alias("s")).select(F.expr(f"s div {plan.multiplicity}").alias("n"))
        suffix = tuple(range(self.inner, n))
        ready = rows.select(*[sets.without(self.bounded(t, self.candidates(t, self.inner, held), self.inner), [F.col(f"v{j}") for j in plan.apart(t) if j < self.inner]).alias(f"s{t}") for t in suffix])
        blocks = {b for _, parts in inclusion_exclusion(suffix) for b in parts}
        size = {b: "z" + "_".join(map(str, b)) for b in blocks}
        sized = ready.select(*[F.size(sets.intersect_all([f"s{t}" for t in b])).cast("decimal(38,0)").alias(size[b]) for b in sorted(blocks)])
        terms = []
        for coefficient, parts in inclusion_exclusion(suffix):
            product = F.lit(coefficient).cast("decimal(38,0)")
            for b in parts:
                product = (product * F.col(size[b])).cast("decimal(38,0)")
            terms.append(product)
        each = terms[0]
        for t in terms[1:]:
            each = (each + t).cast("decimal(38,0)")
        total = F.coalesce(F.sum(each), F.lit(0)).cast("decimal(38,0)")
        return sized.agg(total.alias("s")).select(F.expr(f"cast(s div {plan.multiplicity} as bigint)").alias("n"))

    def with_last(self) -> DataFrame:
        """``v0`` ... of all vertices but the last, and ``ids``: all that the last may be."""
        if self.plan.suffix > 1:
            raise ValueError("inclusion and exclusion counts, it doesn't enumerate")
        rows, held = self.rows()
        k = self.pattern.n - 1
        return rows.select(*[f"v{i}" for i in range(k)], self.bounded(k, self.candidates(k, k, held), k).alias("ids"))

    def enumerated(self) -> DataFrame:
        k = self.pattern.n - 1
        return self.with_last().select(*[f"v{i}" for i in range(k)], F.explode("ids").alias(f"v{k}"))


def worth_narrowing(plan: MatchPlan, t: int, stats: GraphStats) -> bool:
    """Whether candidates of vertex t that are carried save more comparisons than narrowing them takes.

    A narrowed set is read at every match of the vertices between the second
    that tells of it and t; each reading compares what is kept of a neighbour
    list instead of all of it. Hubs (a degree of four times the mean) always pay.
    """
    v, e = max(stats.vertices, 2), max(stats.edges, 1)
    degree = e / v
    if stats.max_degree >= 4 * degree:
        return True
    kept = degree * min(1.0, 6.0 * stats.triangles * v / e / e) if stats.triangles else degree * degree / v
    told = plan.earlier(t)
    if len(told) < 2:
        return False
    reads = 1.0
    for k in range(told[1] + 1, t):
        reads *= max(1.0, degree if len(plan.earlier(k)) < 2 else kept) / 2 ** len(plan.above(k) + plan.below(k))
    return reads * (degree - kept) - degree - kept > 0


# --- entry points ----------------------------------------------------------


def match(graph: Graph, pattern: Pattern, induced: str = "edge", mode: str = "count", iep: bool = False, executor: str = "array", pruning: str = "online", stats: GraphStats | None = None, order: tuple[int, ...] | None = None, restrictions: tuple[tuple[int, int], ...] | None = None, limit: int | None = None, model: str = "triangles", all_sets: bool = False) -> DataFrame:
    """Find every match of ``pattern`` once.

    ``mode`` count: one row, ``n``. ``mode`` enumerate: one row for each match,
    u0, u1 ... being the ids of the pattern's vertices; ``limit`` keeps any so
    many of them. ``induced``: 'edge' (pattern edges must be there) or
    'vertex' (and no others). ``pruning`` says how far ahead candidate sets
    are narrowed and carried: 'none', 'static' (the next vertex), 'eager' (all,
    as soon as one vertex tells of them), 'online' (all, from when two do) or
    'cost' (those for which ``stats``, worked out if not given, make it worth
    while). With ``stats``, orders are compared under the cost ``model``, and
    with ``all_sets`` all restriction sets too. Results don't depend on any of
    these, nor on ``executor``, ``order`` and ``restrictions``.
    """
    if executor not in EXECUTORS or mode not in ("count", "enumerate"):
        raise ValueError("executor is array or join, mode is count or enumerate")
    plan = make_plan(pattern, induced, iep, stats, model, order=order, pairs=restrictions, all_sets=all_sets)
    return run_plan(graph, plan, mode, executor, pruning, stats, limit)


def with_last(graph: Graph, plan: MatchPlan) -> DataFrame:
    """Matches of ``plan`` in its order as ``v0`` ... and, for the last vertex, all its ``ids``."""
    return _Arrays(graph, plan, "online", None).with_last()


def run_plan(graph: Graph, plan: MatchPlan, mode: str = "count", executor: str = "array", pruning: str = "online", stats: GraphStats | None = None, limit: int | None = None) -> DataFrame:
    if executor == "join" and plan.suffix > 1:
        raise ValueError("inclusion and exclusion needs the array executor")
    if mode == "count":
        if executor == "array":
            return _Arrays(graph, plan, pruning, stats).counted()
        return join_stages(graph, plan).agg(F.count("*").alias("s")).select(F.expr(f"s div {plan.multiplicity}").alias("n"))
    rows = _Arrays(graph, plan, pruning, stats).enumerated() if executor == "array" else join_stages(graph, plan)
    place = {v: k for k, v in enumerate(plan.order)}
    out = rows.select(*[F.col(f"v{place[u]}").alias(f"u{u}") for u in range(plan.pattern.n)])
    return out if limit is None else out.limit(limit)


def count(graph: Graph, pattern: Pattern, **options) -> int:
    return match(graph, pattern, **options).first()["n"]


def enumerate_matches(graph: Graph, pattern: Pattern, **options) -> DataFrame:
    return match(graph, pattern, mode="enumerate", **options)


def count_all(graph: Graph, patterns: dict[str, Pattern], **options) -> DataFrame:
    """``pattern`` and ``n`` of several patterns."""
    frames = [match(graph, p, **options).select(F.lit(name).alias("pattern"), "n") for name, p in patterns.items()]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def motif_census(graph: Graph, k: int, induced: str = "vertex", **options) -> DataFrame:
    """``motif`` (adjacency matrix), ``edges`` and ``n`` of every connected graph of k vertices."""
    from motifloom.plans.pattern import motifs

    shapes = {m.to_matrix(): m for m in motifs(k)}
    return count_all(graph, shapes, induced=induced, **options).select(F.col("pattern").alias("motif"), (F.length(F.regexp_replace("pattern", "0", "")) / 2).cast("long").alias("edges"), "n")
