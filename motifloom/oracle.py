"""DuckDB SQL of the graph queries, formulated apart from the executors.

Matches are found without symmetry breaking, once for each automorphism, by
staged common table expressions, and their number is divided by the number of
the pattern's automorphisms.
"""

from __future__ import annotations

from itertools import permutations

from motifloom.plans.pattern import Pattern

GRAPH_Q = """s AS MATERIALIZED (SELECT DISTINCT a.l_partkey AS u, b.l_partkey AS v FROM lineitem a JOIN lineitem b
  ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey WHERE a.l_quantity >= 40 AND b.l_quantity >= 40)"""
GRAPH_R = GRAPH_Q.replace("l_quantity >= 40", "l_returnflag = 'R'")
#: The graph of all lines.
GRAPH_ALL = GRAPH_Q.replace(" WHERE a.l_quantity >= 40 AND b.l_quantity >= 40", "")
LABELS = "lab AS MATERIALIZED (SELECT p_partkey AS id, p_size % 3 AS label FROM part)"


def automorphism_count(p: Pattern) -> int:
    return sum(all(p.has(a, b) == p.has(q[a], q[b]) for a in range(p.n) for b in range(a)) and all(p.label(a) == p.label(q[a]) for a in range(p.n)) for q in permutations(range(p.n)))


def _stages(p: Pattern, induced: str, edges: str = "s") -> tuple[str, list[int]]:
    """The common table expressions m0, m1 ...; the order of vertices is by breadth from vertex 0."""
    order = [0]
    while len(order) < p.n:
        order.append(next(v for v in range(p.n) if v not in order and any(p.has(v, o) for o in order)))
    ctes = []
    for k, x in enumerate(order):
        wanted = f" AND EXISTS (SELECT 1 FROM lab WHERE lab.id = {{}} AND lab.label = {p.label(x)})" if p.label(x) is not None else ""
        if k == 0:
            ctes.append(f"m0 AS MATERIALIZED (SELECT DISTINCT u AS v{x} FROM {edges} WHERE true{wanted.format(f'{edges}.u')})")
            continue
        near = [o for o in order[:k] if p.has(o, x)]
        other = [o for o in order[:k] if not p.has(o, x)]
        tests = [f"EXISTS (SELECT 1 FROM {edges} z WHERE z.u = m.v{o} AND z.v = e.v)" for o in near[1:]] + [f"m.v{o} <> e.v" for o in other]
        if induced == "vertex":
            tests += [f"NOT EXISTS (SELECT 1 FROM {edges} z WHERE z.u = m.v{o} AND z.v = e.v)" for o in other]
        where = " AND ".join(["true", *tests]) + wanted.format("e.v")
        ctes.append(f"m{k} AS MATERIALIZED (SELECT m.*, e.v AS v{x} FROM m{k - 1} m JOIN {edges} e ON e.u = m.v{near[0]} WHERE {where})")
    return ",\n".join(ctes), order


def count_sql(p: Pattern, induced: str = "edge", graph: str = GRAPH_Q) -> str:
    stages, _ = _stages(p, induced)
    head = graph + (f",\n{LABELS}" if p.labels else "")
    return f"WITH {head},\n{stages}\nSELECT CAST(count(*) // {automorphism_count(p)} AS BIGINT) AS n FROM m{p.n - 1}"


def rows_sql(p: Pattern, graph: str = GRAPH_Q, induced: str = "edge") -> str:
    """All maps, as columns u0, u1 ..."""
    stages, _ = _stages(p, induced)
    return f"WITH {graph},\n{stages}\nSELECT {', '.join(f'v{k} AS u{k}' for k in range(p.n))} FROM m{p.n - 1}"
