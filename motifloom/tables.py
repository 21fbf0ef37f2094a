"""Queries of readers, writers, splits, logs and plans: each writes to the shared folder what it reads back."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom.operators import profile
from motifloom.operators.graph import Graph
from motifloom.operators.match import count_all, match
from motifloom.oracle import GRAPH_ALL, GRAPH_Q, LABELS, automorphism_count, count_sql
from motifloom.plans.pattern import Pattern, is_acyclic
from motifloom.plans.planner import make_plan
from motifloom.plans.symmetry import reduced, restrictions
from motifloom.sources import edges as sources
from motifloom.sources import sinks
from motifloom.sources.scratch import new_path
from motifloom.streaming.deltas import CHANGE, RunningCount

Query = Callable[[SparkSession, str], DataFrame]

#: Per vertex, all lines: id, degree, lower_degree, triangles.
_VERTICES = f"""WITH {GRAPH_ALL},
t AS MATERIALIZED (SELECT a.u AS x, a.v AS y, b.v AS z FROM s a JOIN s b ON b.u = a.v AND a.u < a.v AND b.u < b.v WHERE EXISTS (SELECT 1 FROM s c WHERE c.u = a.u AND c.v = b.v)),
k AS (SELECT id, count(*) AS n FROM (SELECT unnest([x, y, z]) AS id FROM t) GROUP BY id),
per AS MATERIALIZED (SELECT d.*, coalesce(k.n, 0) AS triangles FROM (SELECT u AS id, count(*) AS degree, count(*) FILTER (v < u) AS lower_degree FROM s GROUP BY u) d LEFT JOIN k USING (id))"""


def _hash_mod(n: int, *ids: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(',', {', '.join(ids)})), 1, 12))::BIGINT % {n})"


def _values(rows: list[tuple], names: str) -> str:
    text = lambda x: "NULL" if x is None else ("'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x).lower())
    return f"(VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({names})"


def _through(write: Callable, read: Callable, of: Callable) -> Query:
    """Write ``of(spark, sf_dir)`` to a new path and read it back."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = new_path(spark, "query")
        write(of(spark, sf_dir), path)
        return read(spark, path)

    return run


def _snap_checked_message(spark: SparkSession, path: str) -> DataFrame:
    """What a checked reader says of a file with a repeated edge and of one whose header tells a wrong number."""
    said = []
    for name, lines in (("repeated", ["# Nodes: 3 Edges: 3", "1 2", "2 3", "2 1"]), ("miscounted", ["# Nodes: 3 Edges: 5", "1 2", "2 3"])):
        spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{path}-{name}")
        try:
            sources.read_snap_checked(spark, f"{path}-{name}")
            said.append((name, ""))
        except ValueError as error:
            said.append((name, str(error)))
    return spark.createDataFrame(said, "file string, said string")


def _query_file(spark: SparkSession, graph: Graph) -> DataFrame:
    """Counts of the patterns of a query file, written, read by Spark and parsed."""
    shapes = [Pattern.named(n) for n in ("p1", "diamond", "rectangle")]
    path = new_path(spark, "patterns")
    for k, p in enumerate(shapes):
        spark.createDataFrame([(p.to_file(),)], "value string").coalesce(1).write.text(f"{path}/{k}")
    found = {}
    for k in range(len(shapes)):
        text = "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(f"{path}/{k}").collect())  # a query file is a few lines
        (p,) = Pattern.parse_file(text)
        found[str(k)] = p.with_labels([None] * p.n)
    return count_all(graph, found)


def _edited(graph: Graph) -> DataFrame:
    """Patterns made of others by an edge: a rectangle with a diagonal, a 4-clique without an edge, a path from two edges."""
    path = Pattern.of(3, [(0, 1)]).with_edge(1, 2)
    return count_all(graph, {"rectangle with a diagonal": Pattern.named("rectangle").with_edge(0, 3), "clique without an edge": Pattern.clique(4).without_edge(2, 3), "path": path})


def _pattern_facts(spark: SparkSession) -> DataFrame:
    """Of each named shape: its relabelled edge sets, whether it is connected, and whether its oriented edges and a closed walk along a cycle are acyclic."""
    rows = []
    for name in _SHAPES:
        p = Pattern.named(name)
        rows.append((name, len(p.isomorphs()), p.connected(), is_acyclic(p.n, p.edges), is_acyclic(3, [(0, 1), (1, 2), (2, 0)]), p.canonical() == p.ordered(range(p.n - 1, -1, -1)).canonical()))
    return spark.createDataFrame(rows, "pattern string, isomorphs long, connected boolean, oriented_acyclic boolean, cycle_acyclic boolean, same_canonical boolean")


_SHAPES = ("triangle", "p1", "p2", "p3", "p4", "p6", "rectangle", "diamond", "pentagon", "house", "hourglass")


def _lines(spark: SparkSession) -> DataFrame:
    """The steps of plans, and their restrictions without those that follow from others."""
    rows = []
    for name in ("triangle", "p2", "p3", "p6", "rectangle"):
        plan = make_plan(Pattern.named(name))
        told = plan.explain().splitlines()
        rows.append((name, len(told), ",".join(f"{a}>{b}" for a, b in reduced(restrictions(plan.pattern))), told[1].strip()))
    return spark.createDataFrame(rows, "pattern string, lines int, restrictions string, root string")


#: Worked out by hand: chains of stabilisers in matching order, reduced.
_RESTRICTIONS = [("triangle", 4, "0>1,1>2", "v0: all vertices"), ("p2", 6, "0>1,2>3,3>4", "v0: all vertices"), ("p3", 6, "0>1,2>3", "v0: all vertices"), ("p6", 7, "0>1,1>2", "v0: all vertices"), ("rectangle", 5, "0>1,0>3,1>2", "v0: all vertices")]


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs for reports, made of all lines: the return flag is the system, the status the graph, the line number the query."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    slow = F.col("l_quantity") > 30
    return lines.select(F.col("l_returnflag").alias("system"), F.col("l_linestatus").alias("graph"), F.concat(F.lit("p"), "l_linenumber").alias("query"), F.when(F.col("l_suppkey") % 2 == 0, "edge").otherwise("vertex").alias("qtype"), F.when(~slow, F.col("l_quantity")).alias("seconds"), F.when(~slow, F.col("l_partkey")).cast("long").alias("result"), F.col("l_orderkey").cast("long").alias("peak_bytes"))


_RUNS_SQL = "runs AS (SELECT l_returnflag AS system, l_linestatus AS graph, 'p' || l_linenumber AS query, CASE WHEN l_suppkey % 2 = 0 THEN 'edge' ELSE 'vertex' END AS qtype, CASE WHEN l_quantity <= 30 THEN l_quantity END AS seconds, CASE WHEN l_quantity <= 30 THEN l_partkey END AS result, l_orderkey AS peak_bytes FROM lineitem)"


def _logged(spark: SparkSession, graph: Graph) -> DataFrame:
    """Counts of some patterns, logged and read back: a log of plans joined to one of runs."""
    path = new_path(spark, "log")
    for k, name in enumerate(("triangle", "p1", "diamond")):
        plan = make_plan(Pattern.named(name))
        told = profile.timed(graph, plan, runs=1)
        entry = sinks.run_entry(str(k), "q", name, plan, "online", "array")
        sinks.append_log(spark, [entry | {"plan_seconds": 0.001 * k}], f"{path}/plans", sinks.PLAN_LOG)
        sinks.append_log(spark, [entry | {"partitions": 8, "result": told["n"], "seconds": told["mean"], "peak_bytes": 1024}], f"{path}/runs")
    plans = sinks.read_log(spark, f"{path}/plans", sinks.PLAN_LOG).select("id", "matrix", F.col("n").alias("vertices"), "plan_seconds")
    return sinks.read_log(spark, f"{path}/runs").join(plans.select("id", "vertices", "plan_seconds"), "id").select("id", "graph", "query", "matrix", "vertices", "qtype", "pruning", "executor", F.round("plan_seconds", 3).alias("plan_seconds"), "result", (F.col("seconds") > 0).alias("timed"))


def _running(spark: SparkSession, graph: Graph) -> DataFrame:
    """Triangles after the start and after each of two batches of a stream: pairs (x, x + 1) come, then edges of an even sum go."""
    state, folder = new_path(spark, "state"), new_path(spark, "stream")
    run = RunningCount(spark, state, Pattern.clique(3), compact_every=2)
    run.start(graph)
    come = graph.vertices().select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1).alias("add"))
    gone = graph.edges.where("(src + dst) % 4 = 0").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("add"))
    for k, batch in enumerate((come, gone)):
        batch.coalesce(1).write.csv(f"{folder}/{k}")
        stream = spark.readStream.schema(CHANGE).csv(f"{folder}/*")
        run.attach(stream, f"{state}/check").trigger(availableNow=True).start().awaitTermination()
    return run.counts()


def frames(graph: Callable[..., Graph], labels: Query) -> dict[str, tuple[Query, str | None]]:
    """Name, query and SQL of each; ``graph(spark, sf_dir, which)`` and ``labels(spark, sf_dir)`` give the inputs."""
    whole = lambda s, d: graph(s, d, "all")
    half = f"WITH {GRAPH_ALL} SELECT u AS src, v AS dst FROM s WHERE u < v"
    out: dict[str, tuple[Query, str | None]] = {}
    out["snap_scan"] = (_through(lambda g, p: sinks.write_snap(g.edges, p), lambda s, p: sources.symmetric(sources.read_snap(s, p)), whole), f"WITH {GRAPH_ALL} SELECT u AS src, v AS dst FROM s")
    out["snap_scan_checked"] = (_through(lambda g, p: sinks.write_snap(g.edges, p, header=True), sources.read_snap_checked, whole), half)
    out["snap_scan_refused"] = (lambda s, d: _snap_checked_message(s, new_path(s, "refused")), f"SELECT CAST(file AS VARCHAR) AS file, CAST(said AS VARCHAR) AS said FROM {_values([('repeated', '1 edges are repeated'), ('miscounted', '3 nodes and 2 edges, but the header tells 3 and 5')], 'file, said')}")
    out["saved_graph"] = (_through(lambda g, p: g.save(p), lambda s, p: (g := Graph.load(s, p)).edges.join(g.labels.select(F.col("id").alias("src"), "label"), "src"), lambda s, d: whole(s, d).with_labels(labels(s, d))), f"WITH {GRAPH_ALL}, {LABELS} SELECT u AS src, v AS dst, CAST(label AS INTEGER) AS label FROM s JOIN lab ON id = u")
    out["saved_vertices"] = (_through(lambda g, p: g.save_vertices(p), lambda s, p: s.read.parquet(f"{p}/vertices"), whole), f"{_VERTICES} SELECT * FROM per")
    meta = {"NUM_VERTEX": "count(*)", "NUM_EDGE": "sum(degree)", "NUM_TRIANGLE": "2 * sum(triangles)", "MAX_DEGREE": "max(degree)", "MAX_OFFSET": "max(lower_degree)", "MAX_TRIANGLE": "max(triangles)"}
    out["metadata"] = (_through(sinks.write_meta, lambda s, p: s.createDataFrame(list(sources.read_meta(s, p).items()), "key string, value long"), whole), f"{_VERTICES} {' UNION ALL '.join(f'SELECT {chr(39)}{k}{chr(39)} AS key, CAST({e} AS BIGINT) AS value FROM per' for k, e in meta.items())}")
    out["random_labels"] = (lambda s, d: sources.random_labels(whole(s, d).vertices(), 5), f"WITH {GRAPH_ALL} SELECT DISTINCT u AS id, CAST({_hash_mod(5, '0', 'u')} AS INTEGER) AS label FROM s")
    out["query_file"] = (lambda s, d: _query_file(s, graph(s, d)), " UNION ALL ".join(f"SELECT '{k}' AS pattern, ({count_sql(Pattern.named(n))}) AS n" for k, n in enumerate(("p1", "diamond", "rectangle"))))
    out["edited_patterns"] = (lambda s, d: _edited(graph(s, d)), " UNION ALL ".join(f"SELECT '{k}' AS pattern, ({count_sql(p)}) AS n" for k, p in (("rectangle with a diagonal", Pattern.named("diamond")), ("clique without an edge", Pattern.named("diamond")), ("path", Pattern.of(3, [(0, 1), (1, 2)])))))
    facts = [(n, math.factorial(Pattern.named(n).n) // automorphism_count(Pattern.named(n)), True, True, False, True) for n in _SHAPES]
    out["pattern_facts"] = (lambda s, d: _pattern_facts(s), f"SELECT CAST(pattern AS VARCHAR) AS pattern, CAST(i AS BIGINT) AS isomorphs, c AS connected, o AS oriented_acyclic, y AS cycle_acyclic, m AS same_canonical FROM {_values(facts, 'pattern, i, c, o, y, m')}")
    out["plan_lines"] = (lambda s, d: _lines(s), f"SELECT CAST(p AS VARCHAR) AS pattern, CAST(l AS INTEGER) AS lines, CAST(r AS VARCHAR) AS restrictions, CAST(v AS VARCHAR) AS root FROM {_values(_RESTRICTIONS, 'p, l, r, v')}")
    changes = "x AS (SELECT least(u, v) AS src, greatest(u, v) AS dst, CASE WHEN (u + v) % 3 = 0 THEN 0 ELSE 1 END AS add FROM s WHERE u < v)"
    batch = lambda s, d: whole(s, d).edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), F.when((F.col("src") + F.col("dst")) % 3 == 0, 0).otherwise(1).alias("add"))
    out["changes_file"] = (_through(lambda df, p: sources.write_changes(sources.changes(df), p), sources.read_changes, batch), f"WITH {GRAPH_ALL}, {changes} SELECT src, dst, CAST(add AS INTEGER) AS add FROM x")
    out["changes_of_pairs"] = (lambda s, d: sources.change_of(sources.changes(batch(s, d).where("a % 2 = 0")), whole(s, d).edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))), f"WITH {GRAPH_ALL} SELECT u AS a, v AS b, CAST(CASE WHEN u % 2 <> 0 AND v % 2 <> 0 THEN 0 WHEN (u + v) % 3 = 0 THEN -1 ELSE 1 END AS INTEGER) AS change FROM s")
    parts = lambda s, d: [df.select(F.lit(n).alias("part"), "src", "dst") for n, df in sources.split_for_updates(whole(s, d).edges).items()]
    h5 = _hash_mod(5, "u", "v")
    out["update_split"] = (lambda s, d: (p := parts(s, d))[0].union(p[1]).union(p[2]), f"WITH {GRAPH_ALL}, e AS (SELECT u AS src, v AS dst, {h5} AS h FROM s WHERE u < v) SELECT 'start' AS part, src, dst FROM e WHERE h <> 1 UNION ALL SELECT 'del', src, dst FROM e WHERE h = 0 UNION ALL SELECT 'add', src, dst FROM e WHERE h = 1")
    out["batch_split"] = (lambda s, d: sources.split_batches(whole(s, d).edges, 60, 4), f"WITH {GRAPH_ALL} SELECT u AS src, v AS dst, CAST(CASE WHEN {_hash_mod(100, 'u', 'v')} < 60 THEN 0 ELSE 1 + {_hash_mod(4, 'v', 'u')} END AS INTEGER) AS batch FROM s WHERE u < v")
    work = f"""{_VERTICES},
w AS (SELECT 2 AS loop, s.u AS id, count(*) AS m, sum(d.degree) AS r FROM s JOIN per d ON d.id = s.v WHERE s.u > s.v GROUP BY s.u UNION ALL SELECT 3, z, count(*), sum(d.degree) FROM t JOIN per d ON d.id = t.x GROUP BY z)"""
    for key in ("degree", "lower_degree", "triangles"):
        out[f"work_by_{key}"] = (lambda s, d, key=key: profile.work_by(whole(s, d), make_plan(Pattern.clique(3)), key), f"{work} SELECT w.loop, per.{key}, count(*) AS roots, CAST(sum(m) AS BIGINT) AS matches, CAST(sum(r) AS BIGINT) AS neighbours_read FROM w JOIN per USING (id) GROUP BY ALL")
    out["timed_run"] = (lambda s, d: s.createDataFrame([(t["n"], t["runs"], t["min"] <= t["mean"] <= t["max"])], "n long, runs int, ordered boolean") if (t := profile.timed(graph(s, d), make_plan(Pattern.named("p1")), runs=2)) else None, f"SELECT ({count_sql(Pattern.named('p1'))}) AS n, 2 AS runs, true AS ordered")
    side = "SELECT graph, query, qtype, avg(seconds) AS s, max(result) AS r, true AS has FROM runs WHERE system = '{}' GROUP BY ALL"
    out["speedups"] = (lambda s, d: sinks.speedups(_runs(s, d), "A", "N").withColumns({c: F.round(c, 6) for c in ("base_s", "target_s", "speedup")}), f"WITH {_RUNS_SQL}, a AS ({side.format('A')}), b AS ({side.format('N')}) SELECT graph, query, qtype, round(a.s, 6) AS base_s, round(b.s, 6) AS target_s, round(a.s / b.s, 6) AS speedup, a.r AS base_result, b.r AS target_result, CASE WHEN a.has IS NULL OR b.has IS NULL THEN 'not available' WHEN a.s IS NULL OR b.s IS NULL THEN 'out of time' ELSE 'ok' END AS state FROM a FULL JOIN b USING (graph, query, qtype)")
    out["memory_report"] = (lambda s, d: sinks.memory_report(_runs(s, d)).withColumn("mean_bytes", F.round("mean_bytes", 3)), f"WITH {_RUNS_SQL} SELECT system, graph, query, qtype, count(result) AS runs, round(avg(peak_bytes) FILTER (result IS NOT NULL), 3) AS mean_bytes, max(peak_bytes) FILTER (result IS NOT NULL) AS most_bytes, CASE WHEN count(result) > 0 THEN 'ok' ELSE 'out of time' END AS state FROM runs GROUP BY ALL")
    logged = " UNION ALL ".join(f"SELECT '{k}' AS id, 'q' AS graph, '{n}' AS query, '{Pattern.named(n).to_matrix()}' AS matrix, {Pattern.named(n).n} AS vertices, 'edge' AS qtype, 'online' AS pruning, 'array' AS executor, CAST({0.001 * k} AS DOUBLE) AS plan_seconds, ({count_sql(Pattern.named(n))}) AS result, true AS timed" for k, n in enumerate(("triangle", "p1", "diamond")))
    out["run_log"] = (lambda s, d: _logged(s, graph(s, d)), logged)
    tri = "SELECT count(*) FROM {0} a JOIN {0} b ON b.u = a.v AND a.u < a.v AND b.u < b.v JOIN {0} c ON c.u = a.u AND c.v = b.v"
    out["running_count"] = (lambda s, d: _running(s, graph(s, d)), f"WITH {GRAPH_Q}, e1 AS MATERIALIZED (SELECT u, v FROM s UNION SELECT u, u + 1 FROM s UNION SELECT u + 1, u FROM s), e2 AS MATERIALIZED (SELECT * FROM e1 EXCEPT SELECT u, v FROM s WHERE (u + v) % 4 = 0) SELECT CAST(-1 AS BIGINT) AS epoch, ({tri.format('s')}) AS n UNION ALL SELECT 0, ({tri.format('e1')}) UNION ALL SELECT 1, ({tri.format('e2')})")
    out["given_order"] = (lambda s, d: match(graph(s, d), Pattern.named("house"), order=(4, 2, 0, 1, 3), restrictions=_house()), count_sql(Pattern.named("house")))
    out["edge_labels_join"] = (lambda s, d: match(whole(s, d).with_labels(labels(s, d)), Pattern.clique(3).with_labels((0, 0, 0)), executor="join"), count_sql(Pattern.clique(3).with_labels((0, 0, 0)), graph=GRAPH_ALL))
    return out


def _house() -> tuple[tuple[int, int], ...]:
    return reduced(restrictions(Pattern.named("house")))
