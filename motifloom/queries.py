"""The graph queries for the driver, over graphs made of ``lineitem``, and their SQL.

Parts are adjacent when they occur in one order. What describes a graph, and
triangles, are asked of the graph of all lines; larger patterns of the two
sparser graphs that the fixtures define (their matches in the first number
billions).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from motifloom import tables
from motifloom.functions import sets
from motifloom.operators import delta, profile
from motifloom.operators.graph import Graph, global_rank
from motifloom.operators.match import count_all, match, motif_census
from motifloom.oracle import GRAPH_ALL, GRAPH_Q, GRAPH_R, LABELS, automorphism_count, count_sql, rows_sql
from motifloom.plans.pattern import Pattern, motifs
from motifloom.plans.planner import GraphStats, make_plan
from motifloom.plans.symmetry import admits_one_image, automorphisms, restriction_sets
from motifloom.sources import edges as sources
from motifloom.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]
WHERE = {"q": "l_quantity >= 40", "r": "l_returnflag = 'R'", "all": "true"}
NAMED = ["rectangle", "diamond", "pentagon", "house", "hourglass", "cycle_6_tri", "clique_7_minus"]


def graph(spark: SparkSession, sf_dir: str, name: str = "q") -> Graph:
    return Graph(sources.same_order_edges(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), WHERE[name]))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("id"), (F.col("p_size") % 3).cast("int").alias("label"))


def _changes(g: Graph) -> DataFrame:
    """A batch made of the graph: edges whose ends' sum is divisible by 11 go, pairs (x, x + 1) of vertices x divisible by 7 come."""
    gone = g.edges.where("(src + dst) % 11 = 0").select(F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(0).alias("add"))
    come = g.vertices().where("id % 7 = 0").select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), F.lit(1).alias("add"))
    return sources.changes(gone.unionByName(come))


CHANGED = """g2 AS MATERIALIZED (SELECT DISTINCT u, v FROM (
  SELECT u, v FROM s WHERE (u + v) % 11 <> 0
  UNION ALL SELECT u, u + 1 FROM s WHERE u % 7 = 0 UNION ALL SELECT u + 1, u FROM s WHERE u % 7 = 0))"""


def _counted(p: Pattern, which: str = "q", **options) -> Query:
    return lambda spark, sf_dir: match(graph(spark, sf_dir, which), p, **options)


def _delta(p: Pattern, induced: str = "edge") -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g = graph(spark, sf_dir)
        if p.labels:
            g = g.with_labels(_labels(spark, sf_dir))
        return delta.delta_count(g, _changes(g), p, induced)

    return run


def _delta_sql(p: Pattern, induced: str = "edge") -> str:
    """Matches before that aren't there after, and the other way round, by their pattern vertices' images."""
    before = rows_sql(p, GRAPH_Q + (f",\n{LABELS}" if p.labels else ""), induced).split(",\nm0", 1)
    stages = "m0" + before[1]
    body, tail = stages.rsplit("\nSELECT ", 1)
    after = body.replace("FROM s ", "FROM g2 ").replace("JOIN s ", "JOIN g2 ").replace("s.u", "g2.u")
    for k in range(p.n):
        after = after.replace(f"m{k} ", f"n{k} ").replace(f" m{k - 1} m", f" n{k - 1} m") if k else after.replace("m0 ", "n0 ")
    select = tail.rsplit(" FROM ", 1)[0]
    size = automorphism_count(p)
    return f"""WITH {GRAPH_Q},
{f"{LABELS}," if p.labels else ""}
{CHANGED},
{body},
{after},
old AS (SELECT {select} FROM m{p.n - 1}), new AS (SELECT {select} FROM n{p.n - 1}),
gone AS (SELECT * FROM old EXCEPT SELECT * FROM new), come AS (SELECT * FROM new EXCEPT SELECT * FROM old)
SELECT CAST((SELECT count(*) FROM gone) // {size} AS BIGINT) AS removed, CAST((SELECT count(*) FROM come) // {size} AS BIGINT) AS added,
  CAST((SELECT count(*) FROM come) // {size} - (SELECT count(*) FROM gone) // {size} AS BIGINT) AS change"""


def _patterns() -> dict[str, Pattern]:
    return {n: Pattern.named(n) for n in ["triangle", *(f"p{k}" for k in range(1, 9)), *NAMED]}


def _by_vertices(spark: SparkSession, sf_dir: str, p: Pattern) -> DataFrame:
    rows = match(graph(spark, sf_dir), p, mode="enumerate")
    return rows.select(F.array_join(F.array_sort(F.array(*[F.col(f"u{k}") for k in range(p.n)])), ",").alias("vertices")).groupBy("vertices").agg(F.count("*").alias("n"))


def _by_vertices_sql(p: Pattern) -> str:
    ids = ", ".join(f"u{k}" for k in range(p.n))
    return f"SELECT array_to_string(list_sort([{ids}]), ',') AS vertices, CAST(count(*) // {automorphism_count(p)} AS BIGINT) AS n FROM ({rows_sql(p)}) GROUP BY 1"


def _selfcheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each workload pattern: automorphisms, restriction sets that admit exactly one image, and restrictions of the plan."""
    rows = []
    for name in [f"p{k}" for k in range(1, 8)]:
        p = Pattern.named(name)
        found = restriction_sets(p)
        rows.append((name, len(automorphisms(p)), all(admits_one_image(p, r) for r in found), make_plan(p).multiplicity))
    return spark.createDataFrame(rows, "pattern string, automorphisms long, one_image boolean, multiplicity long")


def _selfcheck_sql() -> str:
    rows = ", ".join(f"('p{k}', {automorphism_count(Pattern.named(f'p{k}'))}, true, 1)" for k in range(1, 8))
    return f"SELECT CAST(pattern AS VARCHAR) AS pattern, CAST(a AS BIGINT) AS automorphisms, o AS one_image, CAST(m AS BIGINT) AS multiplicity FROM (VALUES {rows}) AS t(pattern, a, o, m)"


def _set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per directed edge, summed by source: the set algebra on the ends' neighbours."""
    g = graph(spark, sf_dir)
    adj = g.adj().select("id", "nbrs")
    both = g.edges.join(adj.select(F.col("id").alias("src"), F.col("nbrs").alias("a")), "src").join(adj.select(F.col("id").alias("dst"), F.col("nbrs").alias("b")), "dst")
    each = {"both": sets.intersect_count("a", "b"), "both_below": sets.intersect_count("a", "b", F.col("src")), "left": sets.subtract_count("a", "b", F.col("dst")), "left_below": sets.subtract_count("a", "b", F.col("dst"), F.col("src")), "below": sets.bounded_count("a", "dst"), "others": sets.remove_count("a", "dst"), "right_only": F.size(sets.split3("a", "b")["right"]).cast("long"), "places": F.aggregate(sets.positions("a", "b"), F.lit(0).cast("long"), lambda s, x: s + x)}
    return both.select("src", *[c.alias(n) for n, c in each.items()]).groupBy("src").agg(*[F.sum(n).cast("long").alias(n) for n in each])


_SET_OPS_SQL = f"""WITH {GRAPH_Q},
adj AS MATERIALIZED (SELECT u, list_sort(list(v)) AS n FROM s GROUP BY u),
e AS (SELECT s.u AS src, s.v AS dst, x.n AS a, y.n AS b FROM s JOIN adj x ON x.u = s.u JOIN adj y ON y.u = s.v)
SELECT src, CAST(sum(len(list_filter(a, lambda x: list_contains(b, x)))) AS BIGINT) AS "both",
  CAST(sum(len(list_filter(a, lambda x: list_contains(b, x) AND x < src))) AS BIGINT) AS both_below,
  CAST(sum(len(list_filter(a, lambda x: NOT list_contains(b, x) AND x <> dst))) AS BIGINT) AS "left",
  CAST(sum(len(list_filter(a, lambda x: NOT list_contains(b, x) AND x <> dst AND x < src))) AS BIGINT) AS left_below,
  CAST(sum(len(list_filter(a, lambda x: x < dst))) AS BIGINT) AS below, CAST(sum(len(a) - 1) AS BIGINT) AS others,
  CAST(sum(len(list_filter(b, lambda x: NOT list_contains(a, x)))) AS BIGINT) AS right_only,
  CAST(sum(coalesce(list_sum(list_transform(list_filter(a, lambda x: list_contains(b, x)), lambda x: list_position(a, x) - 1)), 0)) AS BIGINT) AS places
FROM e GROUP BY src"""


def _frames() -> dict[str, tuple[Query, str | None]]:
    tri, house = Pattern.named("triangle"), Pattern.named("house")
    out: dict[str, tuple[Query, str | None]] = {}
    out["graph_edges"] = (lambda s, d: graph(s, d, "all").edges, f"WITH {GRAPH_ALL} SELECT u AS src, v AS dst FROM s")
    out["graph_adjacency"] = (lambda s, d: graph(s, d, "all").adj().select("id", F.array_join("nbrs", ",").alias("nbrs"), "degree", "lower_degree"), f"WITH {GRAPH_ALL} SELECT u AS id, string_agg(v, ',' ORDER BY v) AS nbrs, count(*) AS degree, count(*) FILTER (v < u) AS lower_degree FROM s GROUP BY u")
    tri_cte = "t AS MATERIALIZED (SELECT a.u AS x, a.v AS y, b.v AS z FROM s a JOIN s b ON b.u = a.v AND a.u < a.v AND b.u < b.v WHERE EXISTS (SELECT 1 FROM s c WHERE c.u = a.u AND c.v = b.v))"
    per = "p AS (SELECT s.u AS id, (SELECT 1) AS one FROM s GROUP BY s.u), k AS (SELECT unnest([x, y, z]) AS id FROM t), tv AS MATERIALIZED (SELECT p.id, count(k.id) AS triangles FROM p LEFT JOIN k ON k.id = p.id GROUP BY p.id)"
    out["graph_stats"] = (lambda s, d: graph(s, d, "all").stats_frame(), f"WITH {GRAPH_ALL}, {tri_cte}, {per}, d AS (SELECT u, count(*) AS degree, count(*) FILTER (v < u) AS lower FROM s GROUP BY u) SELECT count(*) AS vertices, CAST(sum(degree) AS BIGINT) AS edges, (SELECT count(*) FROM t) AS triangles, max(degree) AS max_degree, max(lower) AS max_lower_degree, (SELECT max(triangles) FROM tv) AS max_triangles FROM d")
    out["triangles_by_vertex"] = (lambda s, d: graph(s, d, "all").triangles_by_vertex(), f"WITH {GRAPH_ALL}, {tri_cte}, {per} SELECT id, triangles FROM tv")
    out["degree_histogram"] = (lambda s, d: profile.degree_histogram(graph(s, d, "all")), f"WITH {GRAPH_ALL}, d AS (SELECT u, count(*) AS degree FROM s GROUP BY u) SELECT degree, count(*) AS vertices FROM d GROUP BY degree")
    out["oriented_edges"] = (lambda s, d: graph(s, d, "all").oriented(), f"WITH {GRAPH_ALL}, d AS (SELECT u, count(*) AS n FROM s GROUP BY u) SELECT s.u AS src, s.v AS dst FROM s JOIN d a ON a.u = s.u JOIN d b ON b.u = s.v WHERE a.n < b.n OR (a.n = b.n AND s.u < s.v)")
    out["degree_relabel"] = (lambda s, d: graph(s, d, "all").relabel_by_degree().edges, f"WITH {GRAPH_ALL}, r AS (SELECT u, row_number() OVER (ORDER BY n DESC, u DESC) - 1 AS k FROM (SELECT u, count(*) AS n FROM s GROUP BY u)) SELECT a.k AS src, b.k AS dst FROM s JOIN r a ON a.u = s.u JOIN r b ON b.u = s.v")
    out["dense_ids"] = (lambda s, d: sources.densify(graph(s, d, "all").edges), f"WITH {GRAPH_ALL}, r AS (SELECT u, row_number() OVER (ORDER BY u) - 1 AS k FROM (SELECT DISTINCT u FROM s)) SELECT a.k AS src, b.k AS dst FROM s JOIN r a ON a.u = s.u JOIN r b ON b.u = s.v")
    out["degree_rank"] = (lambda s, d: global_rank(graph(s, d, "all").degrees(), [F.col("degree").desc(), F.col("id")]), f"WITH {GRAPH_ALL}, d AS (SELECT u AS id, count(*) AS degree FROM s GROUP BY u) SELECT id, degree, row_number() OVER (ORDER BY degree DESC, id) - 1 AS rank FROM d")
    out["complete_graph"] = (lambda s, d: count_all(Graph.complete(s, 7), {n: Pattern.named(n) for n in ("triangle", "p1", "p2", "p3", "p4", "house")}), "SELECT CAST(pattern AS VARCHAR) AS pattern, CAST(n AS BIGINT) AS n FROM (VALUES ('triangle', 35), ('p1', 35), ('p2', 210), ('p3', 630), ('p4', 21), ('house', 1260)) AS t(pattern, n)")
    for name, p in _patterns().items():
        which, sql = ("all", GRAPH_ALL) if p.n == 3 else ("q", GRAPH_Q)
        for induced in ("edge", "vertex"):
            out[f"{name}_{induced}"] = (_counted(p, which, induced=induced), count_sql(p, induced, sql))
    for name in ("p2", "p3", "p5", "p6", "p7", "p8", "diamond", "house", "hourglass"):
        out[f"{name}_iep"] = (_counted(Pattern.named(name), iep=True), count_sql(Pattern.named(name)))
    for name in ("p1", "p3", "house"):
        out[f"{name}_join"] = (_counted(Pattern.named(name), executor="join"), count_sql(Pattern.named(name)))
        for pruning in ("none", "static", "eager", "online"):
            out[f"{name}_pruning_{pruning}"] = (_counted(Pattern.named(name), pruning=pruning, induced="vertex"), count_sql(Pattern.named(name), "vertex"))
    for name in ("p1", "p3", "house", "p6"):
        # In the sparse graph narrowing ahead doesn't pay for any vertex of these; in one with hubs it does for all.
        out[f"{name}_pruning_cost"] = (lambda s, d, p=Pattern.named(name): match(graph(s, d), p, induced="vertex", pruning="cost"), count_sql(Pattern.named(name), "vertex"))
        hubs = GraphStats(1000, 20_000, 5_000, 900)
        out[f"{name}_pruning_hubs"] = (lambda s, d, p=Pattern.named(name), hubs=hubs: match(graph(s, d), p, induced="vertex", pruning="cost", stats=hubs), count_sql(Pattern.named(name), "vertex"))
    for model in ("triangles", "density", "rows"):
        out[f"p3_planned_by_{model}"] = (lambda s, d, model=model: match(g := graph(s, d), Pattern.named("p3"), stats=g.stats(), model=model), count_sql(Pattern.named("p3")))
    out["p6_planned_over_all_sets"] = (lambda s, d: match(g := graph(s, d), Pattern.named("p6"), stats=g.stats(), all_sets=True), count_sql(Pattern.named("p6")))
    for k in (4, 5, 6):
        out[f"clique{k}_dense"] = (_counted(Pattern.clique(k), "r"), count_sql(Pattern.clique(k), graph=GRAPH_R))
    out["triangle_dense"] = (_counted(tri, "r"), count_sql(tri, graph=GRAPH_R))
    out["enumerate_triangles"] = (lambda s, d: match(graph(s, d, "all"), tri, mode="enumerate").select(*[F.array_sort(F.array("u0", "u1", "u2"))[k].alias(c) for k, c in enumerate("abc")]), f"WITH {GRAPH_ALL}, {tri_cte} SELECT x AS a, y AS b, z AS c FROM t")
    out["enumerate_houses"] = (lambda s, d: _by_vertices(s, d, house), _by_vertices_sql(house))
    for name, labels in (("triangle", (0, 1, None)), ("p3", (0, 0, None, 1, None)), ("rectangle", (2, None, None, 2))):
        p = Pattern.named(name).with_labels(labels)
        for executor in ("array", "join"):
            out[f"labelled_{name}_{executor}"] = (lambda s, d, p=p, executor=executor: match(graph(s, d).with_labels(_labels(s, d)), p, executor=executor), count_sql(p))
    out["labelled_p3_vertex"] = (lambda s, d: match(graph(s, d).with_labels(_labels(s, d)), Pattern.named("p3").with_labels((0, 0, None, 1, None)), induced="vertex"), count_sql(Pattern.named("p3").with_labels((0, 0, None, 1, None)), "vertex"))
    out["label_adjacency"] = (lambda s, d: graph(s, d, "all").with_labels(_labels(s, d)).labelled_adj().select("id", "label", F.explode("by_label").alias("nbr_label", "n")).select("id", "label", "nbr_label", F.array_join("n", ",").alias("nbrs")), f"WITH {GRAPH_ALL}, {LABELS} SELECT s.u AS id, CAST(a.label AS INTEGER) AS label, CAST(b.label AS INTEGER) AS nbr_label, string_agg(s.v, ',' ORDER BY s.v) AS nbrs FROM s JOIN lab a ON a.id = s.u JOIN lab b ON b.id = s.v GROUP BY ALL")
    out["label_sizes"] = (lambda s, d: graph(s, d, "all").with_labels(_labels(s, d)).label_sizes(), f"WITH {GRAPH_ALL}, {LABELS} SELECT CAST(label AS INTEGER) AS label, count(*) AS n FROM lab WHERE id IN (SELECT u FROM s) GROUP BY label")
    for k, which, sql in ((3, "all", GRAPH_ALL), (4, "q", GRAPH_Q)):
        shapes = [(m, induced) for m in motifs(k) for induced in ("vertex",)]
        union = "\nUNION ALL ".join(f"SELECT '{m.to_matrix()}' AS motif, CAST({len(m.edges)} AS BIGINT) AS edges, ({count_sql(m, i, sql)}) AS n" for m, i in shapes)
        out[f"motif{k}_census"] = (lambda s, d, k=k, which=which: motif_census(graph(s, d, which), k), union)
    several = {n: Pattern.named(n) for n in ("p1", "p3", "rectangle")}
    out["multi_pattern"] = (lambda s, d: count_all(graph(s, d), several), "\nUNION ALL ".join(f"SELECT '{n}' AS pattern, ({count_sql(p)}) AS n" for n, p in several.items()))
    for name in ("triangle", "p1", "rectangle", "diamond"):
        out[f"delta_{name}"] = (_delta(Pattern.named(name)), _delta_sql(Pattern.named(name)))
    for name in ("triangle", "rectangle", "diamond"):
        out[f"delta_{name}_vertex"] = (_delta(Pattern.named(name), "vertex"), _delta_sql(Pattern.named(name), "vertex"))
    marked = tri.with_labels((0, 1, None))
    out["delta_labelled_triangle"] = (_delta(marked), _delta_sql(marked))
    out |= tables.frames(graph, _labels)
    out["set_algebra"] = (_set_ops, _SET_OPS_SQL)
    out["canonical_classes"] = (lambda s, d: match(graph(s, d, "all"), tri, mode="enumerate").select(F.array_join(sets.canonical_classes(["u0", "u1", "u2"], 5), ",").alias("classes")).groupBy("classes").agg(F.count("*").alias("n")), f"WITH {GRAPH_ALL}, {tri_cte} SELECT array_to_string(list_sort([x % 5, y % 5, z % 5]), ',') AS classes, count(*) AS n FROM t GROUP BY 1")
    pair = "WITH " + GRAPH_ALL + ", adj AS MATERIALIZED (SELECT u, list(v) AS n FROM s GROUP BY u), c AS MATERIALIZED (SELECT len(x.n) AS a, len(y.n) AS b, len(list_intersect(x.n, y.n)) AS i FROM s JOIN adj x ON x.u = s.u JOIN adj y ON y.u = s.v), v AS (SELECT count(*) AS n FROM adj)"
    measures = {"union": "a + b - i", "both": "i", "left": "a - i", "right": "b - i"}
    rows = [f"SELECT '{m}' AS measure, avg({e}) AS mean, CAST(max({e}) AS BIGINT) AS most FROM c" for m, e in measures.items()] + ["SELECT 'neighbours', avg(len(n)), CAST(max(len(n)) AS BIGINT) FROM adj", "SELECT 'complement', avg(v.n - len(adj.n)), CAST(max(v.n - len(adj.n)) AS BIGINT) FROM adj, v"]
    rounded = lambda df: df.withColumn("mean", F.round("mean", 6))
    out["pair_set_stats"] = (lambda s, d: rounded(profile.pair_set_stats(graph(s, d, "all"))), pair + f" SELECT measure, round(mean, 6) AS mean, most FROM ({' UNION ALL '.join(rows)})")
    out["degree_summary"] = (lambda s, d: profile.degree_summary(graph(s, d, "all")).select(F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation")), f"WITH {GRAPH_ALL} SELECT round(avg(n), 6) AS mean, round(stddev_pop(n), 6) AS deviation FROM (SELECT count(*) AS n FROM s GROUP BY u)")
    out["degree_classes"] = (lambda s, d: profile.degree_classes(graph(s, d, "all")), f"""WITH {GRAPH_ALL}, d AS MATERIALIZED (SELECT u, count(*) AS n FROM s GROUP BY u),
c AS MATERIALIZED (SELECT CAST(f AS DOUBLE) AS factor, CAST(floor(m + f * sd) AS BIGINT) AS threshold FROM (SELECT avg(n) AS m, stddev_pop(n) AS sd FROM d), (SELECT unnest([0.0::DOUBLE, 0.5, 1.0, 1.5, 2.0, 2.5, 3.0, 5.0, 10.0]) AS f)),
e AS (SELECT factor, threshold, count(*) FILTER (a.n <= threshold AND b.n <= threshold) AS low_low, count(*) FILTER ((a.n > threshold) <> (b.n > threshold)) AS low_high, count(*) FILTER (a.n > threshold AND b.n > threshold) AS high_high FROM s JOIN d a ON a.u = s.u JOIN d b ON b.u = s.v, c GROUP BY ALL),
v AS (SELECT factor, count(*) FILTER (n <= threshold) AS low_vertices, count(*) FILTER (n > threshold) AS high_vertices, CAST(coalesce(sum(n) FILTER (n <= threshold), 0) AS BIGINT) AS low_edges, CAST(coalesce(sum(n) FILTER (n > threshold), 0) AS BIGINT) AS high_edges, CAST(coalesce(sum(n * n) FILTER (n <= threshold), 0) AS BIGINT) AS low_squares, CAST(coalesce(sum(n * n) FILTER (n > threshold), 0) AS BIGINT) AS high_squares FROM d, c GROUP BY factor)
SELECT * FROM e JOIN v USING (factor)""")
    out["work_by_root"] = (lambda s, d: profile.work_by_root(graph(s, d, "all"), make_plan(tri)), f"WITH {GRAPH_ALL}, d AS (SELECT u, count(*) AS n FROM s GROUP BY u), {tri_cte.replace('a.u < a.v AND b.u < b.v', 'a.u > a.v AND b.u > b.v')}, two AS (SELECT s.u AS id, count(*) AS m, sum(d.n) AS r FROM s JOIN d ON d.u = s.v WHERE s.u > s.v GROUP BY s.u), three AS (SELECT x AS id, count(*) AS m, sum(d.n) AS r FROM t JOIN d ON d.u = t.z GROUP BY x) SELECT 2 AS loop, id, m AS matches, CAST(r AS BIGINT) AS neighbours_read FROM two UNION ALL SELECT 3, id, m, CAST(r AS BIGINT) FROM three")
    out["labelled_text"] = (lambda s, d: sinks.labelled_text(graph(s, d, "all").with_labels(_labels(s, d))).select("value"), f"WITH {GRAPH_ALL}, {LABELS}, v AS (SELECT id, label FROM lab WHERE id IN (SELECT u FROM s)) SELECT 't 0 ' || count(*) AS value FROM v UNION ALL SELECT 'v ' || id || ' ' || label FROM v UNION ALL SELECT 'e ' || u || ' ' || v || ' 0' FROM s WHERE u < v")
    out["restriction_selfcheck"] = (_selfcheck, _selfcheck_sql())
    return out


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in _frames().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _frames().items() if sql}
