"""Writing graphs, metadata and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.plans.planner import GraphStats


def write_meta(graph, path: str) -> None:
    """KEY, tab, value lines, triangles counted six times each as by vertex and direction."""
    s: GraphStats = graph.stats()
    lines = [("NUM_VERTEX", s.vertices), ("NUM_EDGE", s.edges), ("NUM_TRIANGLE", 6 * s.triangles), ("MAX_DEGREE", s.max_degree), ("MAX_OFFSET", s.max_lower_degree), ("MAX_TRIANGLE", s.max_triangles)]
    spark = graph.edges.sparkSession
    spark.createDataFrame([(k, f"{a}\t{b}") for k, (a, b) in enumerate(lines)], "k int, value string").coalesce(1).sortWithinPartitions("k").select("value").write.text(path)


def write_snap(edges: DataFrame, path: str, header: bool = False) -> None:
    """Each undirected edge as a line; with ``header``, comments that tell the numbers of nodes and edges come first."""
    half = edges.where("src < dst").select("src", "dst")
    lines = half.select(F.concat_ws("\t", "src", "dst").alias("value"))
    if header:
        told = edges.agg(F.count_distinct("src").alias("v"), F.count_if(F.col("src") < F.col("dst")).alias("e"))
        texts = [F.lit("# Undirected graph"), F.lit("# Each edge is told once"), F.format_string("# Nodes: %d Edges: %d", "v", "e"), F.lit("# FromNodeId\tToNodeId")]
        told.select(F.explode(F.array(*texts)).alias("value")).coalesce(1).write.text(path)
    lines.write.mode("append").text(path)


def labelled_text(graph) -> DataFrame:
    """Lines ``t 0 V``, ``v id label`` and ``e u v 0`` of a labelled graph, with a column ``part`` that orders them."""
    vertices = graph.vertices()
    if "label" not in vertices.columns:
        vertices = vertices.withColumn("label", F.lit(0))
    head = vertices.agg(F.format_string("t 0 %d", F.count("*")).alias("value")).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), "value")
    rows = vertices.select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.format_string("v %d %d", "id", "label").alias("value"))
    edges = graph.edges.where("src < dst").select(F.lit(2).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.format_string("e %d %d 0", "src", "dst").alias("value"))
    return head.unionByName(rows).unionByName(edges)


def write_labelled_text(graph, path: str) -> None:
    """``labelled_text`` as text files whose order is that of their names."""
    labelled_text(graph).repartitionByRange("part", "a", "b").sortWithinPartitions("part", "a", "b").select("value").write.text(path)


def speedups(runs: DataFrame, base: str, target: str) -> DataFrame:
    """``graph``, ``query``, ``qtype`` and the mean seconds of two systems with their quotient.

    ``runs`` has ``system``, ``graph``, ``query``, ``qtype``, ``seconds`` (null:
    out of time) and ``result``. ``state`` is ``ok``, ``out of time`` if either
    never ended, or ``not available`` if either has no run at all.
    """
    mean = runs.groupBy("system", "graph", "query", "qtype").agg(F.avg("seconds").alias("s"), F.max("result").alias("r"))
    side = lambda name, s, r: mean.where(F.col("system") == name).select("graph", "query", "qtype", F.col("s").alias(s), F.col("r").alias(r), F.lit(True).alias(f"has_{s}"))
    both = side(base, "base_s", "base_result").join(side(target, "target_s", "target_result"), ["graph", "query", "qtype"], "full")
    state = F.when(F.col("has_base_s").isNull() | F.col("has_target_s").isNull(), "not available").when(F.col("base_s").isNull() | F.col("target_s").isNull(), "out of time").otherwise("ok")
    return both.select("graph", "query", "qtype", "base_s", "target_s", (F.col("base_s") / F.col("target_s")).alias("speedup"), "base_result", "target_result", state.alias("state"))


#: Columns of a log of plans that were made, and of matches that were run.
RUN_KEY = "id string, graph string, query string, matrix string, n int, qtype string, pruning string, executor string"
PLAN_LOG = f"{RUN_KEY}, plan_seconds double"
RUN_LOG = f"{RUN_KEY}, partitions int, result long, seconds double, peak_bytes long"


def run_entry(id_: str, graph: str, query: str, plan, pruning: str, executor: str) -> dict:
    """What identifies a run in either log; ``plan`` is its ``MatchPlan``."""
    kind = f"{plan.induced}-iep" if plan.suffix else plan.induced
    return {"id": id_, "graph": graph, "query": query, "matrix": plan.query.to_matrix(), "n": plan.query.n, "qtype": kind, "pruning": pruning, "executor": executor}


def append_log(spark, rows: list[dict], path: str, schema: str = RUN_LOG) -> None:
    """Add rows to a log of CSV files with headers; a run writes few of them."""
    names = [c.split()[0] for c in schema.split(", ")]
    spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema).coalesce(1).write.mode("append").option("header", True).csv(path)


def read_log(spark, path: str, schema: str = RUN_LOG) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def memory_report(runs: DataFrame) -> DataFrame:
    """``system``, ``graph``, ``query``, ``qtype``: runs that ended, the mean and greatest of their ``peak_bytes``, and ``state``.

    ``state`` is ``ok``, or ``out of time`` if no run has a ``result``.
    """
    ended = F.col("result").isNotNull()
    per = runs.groupBy("system", "graph", "query", "qtype").agg(F.count_if(ended).alias("runs"), F.avg(F.when(ended, F.col("peak_bytes"))).alias("mean_bytes"), F.max(F.when(ended, F.col("peak_bytes"))).alias("most_bytes"))
    return per.withColumn("state", F.when(F.col("runs") > 0, "ok").otherwise("out of time"))
