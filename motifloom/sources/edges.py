"""Reading edges, labels and batches of changes from text and Parquet."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPLIT = r"[\s,]+"
# Bytes to read for each partition of ``dealt``, and its greatest number of partitions.
PART_BYTES, MOST_PARTS = 4 << 20, 4000


def read_snap(spark: SparkSession, path: str, mode: str = "DROPMALFORMED") -> DataFrame:
    """``src`` and ``dst`` of each line ``src dst``; blank lines and lines from ``#`` are skipped.

    Lines whose first two fields aren't whole numbers are dropped, or with
    ``FAILFAST`` fail the job.
    """
    lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "\\r$", "")).alias("line")).where("line != '' and not startswith(line, '#')")
    field = lambda k: F.get(F.split("line", _SPLIT), F.lit(k)).try_cast("bigint")
    edges = lines.select("line", field(0).alias("src"), field(1).alias("dst"))
    if mode == "FAILFAST":
        bad = F.col("src").isNull() | F.col("dst").isNull()
        return edges.select(F.when(bad, F.raise_error(F.concat(F.lit("not an edge: "), "line")).cast("bigint")).otherwise(F.col("src")).alias("src"), "dst")
    if mode != "DROPMALFORMED":
        raise ValueError("mode is DROPMALFORMED or FAILFAST")
    return edges.where("src is not null and dst is not null").select("src", "dst")


def read_snap_checked(spark: SparkSession, path: str) -> DataFrame:
    """A SNAP file whose comment ``# Nodes: V Edges: E`` is held against its lines; repeated edges are a ValueError."""
    told = spark.read.text(path).where("startswith(value, '#')").select(F.regexp_extract("value", r"Nodes:\s*(\d+)", 1).alias("v"), F.regexp_extract("value", r"Edges:\s*(\d+)", 1).alias("e")).where("v != '' and e != ''").first()
    if told is None:
        raise ValueError("no line tells the numbers of nodes and edges")
    edges = read_snap(spark, path, "FAILFAST")
    # One pass over the file: an edge counts under its pair, a node under itself.
    pair = F.struct(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    node = lambda c: F.struct(F.col(c).alias("a"), F.lit(None).cast("long").alias("b"))
    seen = edges.select(F.explode(F.array(pair, node("src"), node("dst"))).alias("x")).groupBy("x.a", "x.b").agg(F.count("*").alias("n"))
    got = seen.agg(F.count_if(F.col("b").isNull()).alias("v"), F.count_if(F.col("b").isNotNull()).alias("e"), F.coalesce(F.sum(F.when(F.col("b").isNotNull(), F.col("n"))), F.lit(0)).alias("lines")).first()
    if got["lines"] != got["e"]:
        raise ValueError(f"{got['lines'] - got['e']} edges are repeated")
    if (got["v"], got["e"]) != (int(told["v"]), int(told["e"])):
        raise ValueError(f"{got['v']} nodes and {got['e']} edges, but the header tells {told['v']} and {told['e']}")
    return edges


def never_broadcast(rows: DataFrame) -> DataFrame:
    """Rows that Spark must not broadcast on its own estimate, which takes ``explode`` to make one row of each.

    What is derived from them without a join is not broadcast either.
    """
    return rows.hint("merge")


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows in partitions by ``keys``, more of them the larger the tables they come from, so that a task's share doesn't grow with the input.

    What is grouped by the keys next is not grouped before that shuffle too,
    which would be for nothing where keys hardly repeat.
    """
    read = bytes_read(rows)
    if read is None:
        return rows.repartition(*keys)
    least = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(max(least, min(-(-read // PART_BYTES), MOST_PARTS)), *keys)


def bytes_read(df: DataFrame) -> int | None:
    """Bytes of the tables that ``df`` comes from, or None where Spark doesn't know. Its estimate of what joins make of them is far too large."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    return sum(sizes) if max(sizes) < 1 << 60 else None


def symmetric(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``src``, ``dst`` in both directions, without loops, null ends and repeats."""
    clean = edges.select(F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")).where("src != dst")
    # One shuffle: repeats go as ordered pairs, which are then told in both directions.
    once = dealt(clean.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")), "a", "b").distinct()
    return once.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")


def complete(spark: SparkSession, n: int) -> DataFrame:
    """The symmetric edges of the complete graph on 0..n-1."""
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")), lambda x: x != F.col("id"))
    return spark.range(n).select(F.col("id").alias("src"), F.explode(others).alias("dst"))


def densify(edges: DataFrame, by: list[Column] | None = None) -> DataFrame:
    """Ids replaced by 0, 1, 2 ... in their order; the mapping's ranks come from partition offsets, not from one global window."""
    from motifloom.operators.graph import global_rank

    edges = never_broadcast(edges)
    ids = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    ranks = never_broadcast(global_rank(ids, by or [F.col("id")]))
    one = ranks.select(F.col("id").alias("src"), F.col("rank").alias("s"))
    two = ranks.select(F.col("id").alias("dst"), F.col("rank").alias("d"))
    return edges.join(one, "src").join(two, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))


def same_order_edges(lineitem: DataFrame, condition: str) -> DataFrame:
    """Parts that occur in one order, on lines that meet ``condition``, as symmetric edges."""
    lines = lineitem.where(condition).select("l_orderkey", "l_partkey").distinct()
    parts = lines.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("p")).where("size(p) > 1")
    return symmetric(parts.select(F.explode("p").alias("src"), "p").select("src", F.explode("p").alias("dst")).where("src < dst"))


def hash_mod(n: int, *ids: str) -> Column:
    """0..n-1 from a digest of ids, the same wherever it is worked out."""
    digits = F.substring(F.md5(F.concat_ws(",", *ids)), 1, 12)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(n)).cast("int")


def random_labels(vertices: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """``id`` and ``label``, one of 0..n-1 by a hash, so reruns agree."""
    return vertices.withColumn("seed", F.lit(seed)).select("id", hash_mod(n, "seed", "id").alias("label"))


def read_changes(spark: SparkSession, path: str) -> DataFrame:
    """A batch file: a line with the number of changes, then ``a b add`` (1 or 0). Returns ``src``, ``dst``, ``add`` with src < dst."""
    parts = lambda k: F.get(F.split(F.trim("value"), r"\s+"), F.lit(k)).try_cast("bigint")
    rows = spark.read.text(path).select(parts(0).alias("a"), parts(1).alias("b"), parts(2).alias("add")).where("add is not null")
    return changes(rows)


def changes(rows: DataFrame) -> DataFrame:
    """Canonical changes from ``a``, ``b`` and ``add``: loops dropped, pairs ordered; a pair both added and removed ends as added."""
    pairs = rows.where("a != b").select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), F.col("add").cast("int").alias("add"))
    return dealt(pairs, "src", "dst").groupBy("src", "dst").agg(F.max("add").alias("add"))


def change_of(batch: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (``a``, ``b``) with ``change``: 1 added, -1 removed, 0 neither."""
    key = pairs.withColumn("src", F.least("a", "b")).withColumn("dst", F.greatest("a", "b"))
    return never_broadcast(key).join(batch, ["src", "dst"], "left").select("a", "b", F.when(F.col("add").isNull(), 0).when(F.col("add") > 0, 1).otherwise(-1).alias("change"))


def split_for_updates(edges: DataFrame, every: int = 5) -> dict[str, DataFrame]:
    """Start, removed and added edges for an update run: by a hash, one of ``every`` starts and is removed, another one is added."""
    half = edges.where("src < dst").withColumn("h", hash_mod(every, "src", "dst"))
    return {"start": half.where("h != 1").select("src", "dst"), "del": half.where("h = 0").select("src", "dst"), "add": half.where("h = 1").select("src", "dst")}


def split_batches(edges: DataFrame, percent: int, batches: int) -> DataFrame:
    """Each undirected edge with its ``batch``: 0 for about ``percent`` of them, which are the start, else 1 to ``batches``."""
    return edges.where("src < dst").select("src", "dst", F.when(hash_mod(100, "src", "dst") < percent, F.lit(0)).otherwise(1 + hash_mod(batches, "dst", "src")).cast("int").alias("batch"))


def write_changes(batch: DataFrame, path: str) -> None:
    """A batch of ``src``, ``dst``, ``add`` as ``read_changes`` reads it."""
    batch.agg(F.count("*").cast("string").alias("value")).write.text(path)
    batch.select(F.concat_ws(" ", "src", "dst", F.col("add").cast("int")).alias("value")).write.mode("append").text(path)


def read_meta(spark: SparkSession, path: str) -> dict[str, int]:
    """The KEY and value lines of a graph's metadata file."""
    rows = spark.read.text(path).collect()  # six lines
    return {m[1]: int(m[2]) for m in (re.match(r"(\w+)\s+(\d+)", r["value"]) for r in rows) if m}
