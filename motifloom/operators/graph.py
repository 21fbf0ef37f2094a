"""The data graph: a symmetric edge table, and what is derived from it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from motifloom.functions import sets
from motifloom.operators.lookup import Lists
from motifloom.plans.planner import GraphStats
from motifloom.sources import edges as sources
from motifloom.sources.scratch import shared_dir, written


# A fixed value: bytes of the tables that a graph is made of, up to which it is not written for later readings.
SMALL_BYTES = 16 << 20


def global_rank(df: DataFrame, by: list[Column]) -> DataFrame:
    """``rank`` from 0 over all rows in the order ``by``, which must be total.

    Rows are range-partitioned and ranked inside their partition; offsets come
    from the partitions' counts, one row each, so no task sees all rows. The
    partitioned rows are checkpointed, as range bounds are sampled anew on
    every evaluation.
    """
    shared_dir(df.sparkSession)
    part, n, base, place = _fresh(df, "part", "n", "base", "place")
    ranged = df.repartitionByRange(*by).withColumn(part, F.spark_partition_id()).checkpoint()
    counts = ranged.groupBy(part).agg(F.count("*").alias(n))
    offsets = counts.select(part, F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(base))
    inner = ranged.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(*by)))
    return inner.join(F.broadcast(offsets), part).select(*df.columns, (F.col(base) + F.col(place) - 1).alias("rank"))


def _fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that ``df`` hasn't."""
    taken = {c.lower() for c in df.columns} | {"rank"}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


class Graph:
    """``edges``: ``src``, ``dst`` in both directions, no loops, no repeats. ``labels``: ``id``, ``label``, or None.

    Vertices are the ends of edges. Use a constructor that cleans its input.
    """

    def __init__(self, edges: DataFrame, labels: DataFrame | None = None):
        self.edges = sources.never_broadcast(edges)
        self.labels = labels
        self._lists: dict[str, Lists] = {}

    @staticmethod
    def from_edges(edges: DataFrame, src: str = "src", dst: str = "dst", labels: DataFrame | None = None) -> Graph:
        """From any edge rows: both directions or one, with loops, repeats or null ends."""
        return Graph(sources.symmetric(edges, src, dst), labels)

    @staticmethod
    def from_snap(spark: SparkSession, path: str, mode: str = "DROPMALFORMED") -> Graph:
        return Graph.from_edges(sources.read_snap(spark, path, mode))

    @staticmethod
    def complete(spark: SparkSession, n: int) -> Graph:
        return Graph(sources.complete(spark, n))

    @staticmethod
    def load(spark: SparkSession, path: str) -> Graph:
        """What ``save`` wrote."""
        saved = spark.read.parquet(f"{path}/edges")
        has = "src_label" in saved.columns
        labels = saved.select(F.col("src").alias("id"), F.col("src_label").alias("label")).distinct() if has else None
        return Graph(saved.select("src", "dst"), labels)

    def save(self, path: str) -> None:
        """Parquet, sorted by source inside files, so that scans of id ranges skip most of it."""
        edges = self.edges
        if self.labels is not None:
            edges = edges.join(self.labels.select(F.col("id").alias("src"), F.col("label").alias("src_label")), "src")
        sources.dealt(edges, "src").sortWithinPartitions("src", "dst").write.mode("overwrite").parquet(f"{path}/edges")

    def vertex_table(self) -> DataFrame:
        """``id``, ``degree``, ``lower_degree`` and ``triangles`` of each vertex."""
        return sources.never_broadcast(self._stored).select("id", F.size("nbrs").cast("long").alias("degree"), sets.bounded_count("nbrs", "id").alias("lower_degree")).join(self.triangles_by_vertex(), "id")

    def save_vertices(self, path: str) -> None:
        """``vertex_table`` as Parquet, sorted by id inside files."""
        self.vertex_table().repartition("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{path}/vertices")

    def save_bucketed(self, table: str, buckets: int) -> None:
        """The adjacency as a table bucketed by id: later matches join it without shuffling it."""
        self.adj().write.mode("overwrite").bucketBy(buckets, "id").sortBy("id").saveAsTable(table)

    def persist(self) -> Graph:
        """Keep the edges and the adjacency for several queries."""
        self.edges = self.edges.persist()
        self._adj = self._adj.persist()
        return self

    def unpersist(self) -> None:
        self.edges.unpersist()
        self._adj.unpersist()

    def vertices(self) -> DataFrame:
        """``id``, and ``label`` if there are labels."""
        ids = self.edges.select(F.col("src").alias("id")).distinct()
        return ids if self.labels is None else ids.join(self.labels, "id")

    @cached_property
    def _adj(self) -> DataFrame:
        return sources.dealt(self.edges, "src").groupBy(F.col("src").alias("id")).agg(F.sort_array(F.collect_list("dst")).alias("nbrs"))

    @cached_property
    def _stored(self) -> DataFrame:
        """The adjacency, to be read several times: that of a large input is written, that of a small one is worked out again."""
        read = sources.bytes_read(self._adj)
        return written(self._adj, "lists") if read is None or read > SMALL_BYTES else self._adj

    def lists(self, which: str = "all") -> Lists:
        """``nbrs`` of each ``id`` for lookups: 'all' neighbours, those 'below' the id, or 'labelled' ones, as ``labelled_adj`` has them."""
        if which not in self._lists:
            if which == "labelled":
                table = written(self.labelled_adj().select("id", F.col("by_label").alias("nbrs")), "lists")
                self._lists[which] = Lists(table, F.size(F.flatten(F.map_values("nbrs"))))
            else:
                below = sets.bounded("nbrs", "id").alias("nbrs")
                self._lists[which] = Lists(self._stored.select("id", "nbrs" if which == "all" else below), F.size("nbrs"))
        return self._lists[which]

    def degree_lookup(self) -> Lists:
        if "degrees" not in self._lists:
            self._lists["degrees"] = Lists(self._stored.select("id", F.size("nbrs").cast("long").alias("degree")), F.lit(0))
        return self._lists["degrees"]

    def adj(self) -> DataFrame:
        """``id``, ``nbrs`` (sorted), ``degree`` and ``lower_degree`` (neighbours of smaller id)."""
        return self._adj.select("id", "nbrs", F.size("nbrs").cast("long").alias("degree"), sets.bounded_count("nbrs", "id").alias("lower_degree"))

    def degrees(self) -> DataFrame:
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))

    def labelled_adj(self) -> DataFrame:
        """``id``, ``label`` and ``by_label``: sorted neighbours by their label."""
        if self.labels is None:
            raise ValueError("the graph has no labels")
        one = self.labels.select("id", F.col("label").cast("int").alias("label"))
        far = self.edges.join(one.select(F.col("id").alias("dst"), F.col("label").alias("dst_label")), "dst")
        lists = far.groupBy("src", "dst_label").agg(F.sort_array(F.collect_list("dst")).alias("n"))
        maps = lists.groupBy(F.col("src").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("dst_label", "n"))).alias("by_label"))
        return maps.join(one, "id").select("id", "label", "by_label")

    def label_sizes(self) -> DataFrame:
        return self.vertices().groupBy("label").agg(F.count("*").alias("n"))

    def oriented(self) -> DataFrame:
        """Each edge once, from the end of smaller (degree, id) to the other; hubs get short lists."""
        size = F.size("nbrs").cast("long")
        near = self._stored.select(F.col("id").alias("src"), size.alias("ds"), F.col("nbrs").alias("ids"))
        both = self.degree_lookup().beside(near, "dst", {"degree": "dd"}, ["src"])
        return sources.never_broadcast(both.where("ds < dd or (ds = dd and src < dst)").select("src", "dst"))

    def triangles_by_vertex(self) -> DataFrame:
        """``id`` and the number of ``triangles`` it is in; every triangle is found once, from oriented edges."""
        up = Lists(written(self.oriented().groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("up")), "lists"), F.size("up"))
        near = up.table.select(F.col("id").alias("src"), "up", F.col("up").alias("ids"))
        third = up.beside(near, "dst", {"up": "far_up"}, ["src"]).select("src", "dst", F.explode(F.array_intersect("up", "far_up")).alias("w"))
        per = third.select(F.explode(F.array("src", "dst", "w")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))
        return sources.never_broadcast(self._stored).select("id").join(per, "id", "left").select("id", F.coalesce("triangles", F.lit(0)).cast("long").alias("triangles"))

    def stats_frame(self) -> DataFrame:
        """One row: vertices, edges (both directions), triangles (once), greatest degree, lower degree and triangles of a vertex."""
        d = self.vertex_table()
        total = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
        most = lambda x: F.coalesce(F.max(x), F.lit(0)).cast("long")
        return d.agg(F.count("*").alias("vertices"), total("degree").alias("edges"), F.floor(total("triangles") / 3).cast("long").alias("triangles"), most("degree").alias("max_degree"), most("lower_degree").alias("max_lower_degree"), most("triangles").alias("max_triangles"))

    def stats(self) -> GraphStats:
        return GraphStats(**self.stats_frame().first().asDict())

    def relabel_by_degree(self) -> Graph:
        """Ids replaced by ranks of falling (degree, id)."""
        ranks = global_rank(self.degrees(), [F.col("degree").desc(), F.col("id").desc()])
        ranks = sources.never_broadcast(ranks)
        one = ranks.select(F.col("id").alias("src"), F.col("rank").alias("s"))
        two = ranks.select(F.col("id").alias("dst"), F.col("rank").alias("d"))
        edges = self.edges.join(one, "src").join(two, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
        labels = None if self.labels is None else self.labels.join(ranks, "id").select(F.col("rank").alias("id"), "label")
        return Graph(edges, labels)

    def with_labels(self, labels: DataFrame) -> Graph:
        return Graph(self.edges, labels)

    def changed(self, batch: DataFrame) -> Graph:
        """After a batch of ``sources.changes``: added edges are there, removed ones aren't."""
        both = batch.select("src", "dst", "add").union(batch.select("dst", "src", "add"))
        kept = self.edges.join(both.where("add = 0"), ["src", "dst"], "left_anti")
        return Graph(kept.union(both.where("add > 0").select("src", "dst")).distinct(), self.labels)
