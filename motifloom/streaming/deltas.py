"""Keeping a pattern's count up to date under a stream of edge changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifloom.operators.delta import delta_count, effective
from motifloom.operators.graph import Graph
from motifloom.operators.match import match
from motifloom.plans.pattern import Pattern
from motifloom.sources.edges import changes

CHANGE = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType()), T.StructField("add", T.IntegerType())])


class RunningCount:
    """``process`` is for ``foreachBatch``: each batch's change of the count is computed from the batch.

    ``state`` is a folder that the cluster shares. It has a table of all edges
    as they were after some epoch, the effect of each epoch since then, and a
    table of counts. Every ``compact_every`` epochs the edges are written anew
    and what they hold already is removed, so an epoch writes no more than it
    changes, and the state stays bounded. An epoch that comes again after a
    failure is recognised by its row of counts, so results are exactly-once.
    """

    def __init__(self, spark: SparkSession, state: str, pattern: Pattern, induced: str = "edge", labels: DataFrame | None = None, compact_every: int = 16):
        self.spark, self.state, self.pattern, self.induced, self.labels, self.compact_every = spark, state.rstrip("/"), pattern, induced, labels, compact_every

    def start(self, graph: Graph) -> None:
        graph.edges.write.mode("overwrite").parquet(f"{self.state}/edges/epoch=-1")
        n = match(Graph(self._base(-1), self.labels), self.pattern, self.induced)
        self._note(n.select(F.lit(-1).cast("long").alias("epoch"), "n", F.lit(-1).cast("long").alias("base")), -1)

    def _base(self, epoch: int) -> DataFrame:
        return self.spark.read.schema("src long, dst long").parquet(f"{self.state}/edges/epoch={epoch}")

    def _graph(self, base: int, epoch: int) -> Graph:
        """The graph after ``epoch``: the edges after ``base`` with the last word on each pair that changed since."""
        edges = self._base(base)
        since = [f"{self.state}/changes/epoch={e}" for e in range(base + 1, epoch + 1)]
        if since:
            told = self.spark.read.schema("src long, dst long, add int, epoch long").parquet(*since)
            last = told.groupBy("src", "dst").agg(F.max_by("add", "epoch").alias("add"))
            edges = edges.join(last, ["src", "dst"], "left_anti").union(last.where("add > 0").select("src", "dst"))
        return Graph(edges, self.labels)

    def _note(self, row: DataFrame, epoch: int) -> None:
        row.coalesce(1).write.mode("overwrite").parquet(f"{self.state}/counts/at={epoch}")

    def counts(self) -> DataFrame:
        """``epoch`` (-1: the start) and ``n``."""
        return self.spark.read.parquet(f"{self.state}/counts").select("epoch", "n")

    def process(self, batch: DataFrame, epoch: int) -> None:
        done = self.spark.read.parquet(f"{self.state}/counts").where(F.col("epoch") <= epoch).orderBy(F.col("epoch").desc()).first()
        if done["epoch"] == epoch:
            return
        base, last = int(done["base"]), int(done["epoch"])
        graph = self._graph(base, last)
        canonical = changes(batch)
        removed, added = effective(graph, canonical)
        told = removed.withColumn("add", F.lit(0)).union(added.withColumn("add", F.lit(1))).withColumn("epoch", F.lit(epoch).cast("long"))
        for skipped in range(last + 1, epoch):  # epochs without a batch changed nothing
            told.limit(0).write.mode("overwrite").parquet(f"{self.state}/changes/epoch={skipped}")
        told.write.mode("overwrite").parquet(f"{self.state}/changes/epoch={epoch}")
        mine = self.spark.read.schema(told.schema).parquet(f"{self.state}/changes/epoch={epoch}").where("src < dst").select("src", "dst", "add")
        change = delta_count(graph, mine, self.pattern, self.induced)  # read only when noted, before anything is removed
        stale = []
        if epoch - base >= self.compact_every:
            self._graph(base, epoch).edges.write.mode("overwrite").parquet(f"{self.state}/edges/epoch={epoch}")
            stale = [f"edges/epoch={base}", *[f"changes/epoch={e}" for e in range(base + 1, epoch)]]
            base = epoch
        self._note(change.select(F.lit(epoch).cast("long").alias("epoch"), (F.lit(done["n"]) + F.col("change")).cast("long").alias("n"), F.lit(base).cast("long").alias("base")), epoch)
        for path in stale:  # only now does nothing refer to them
            self._remove(path)

    def _remove(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.state}/{path}")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    def attach(self, stream: DataFrame, checkpoint: str):
        """A query over a stream of ``a``, ``b``, ``add`` rows."""
        return stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
