"""Contiguous shards of near equal bytes, cut by global prefix sums.

Only DataFrame functions are used. Rows are range-partitioned by id, so each
partition is a stretch of the global order; a table of partition totals (one
row for each partition, whatever the number of documents) gives each
partition's offset, and a running sum inside the partition does the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from motifloom.llm.durable import durable

#: Bytes counted for each document besides its text.
ROW_BYTES = 8


def shard_by_bytes(docs: DataFrame, shards: int = 24, partitions: int | None = None) -> DataFrame:
    """Put documents, in the order of ``doc_id``, into ``shards`` stretches of near equal size.

    A document's size is its text's UTF-8 bytes (null: none) plus 8. With T
    the sum of sizes and m the middle of a document's stretch of the running
    sum, its shard is floor(m * shards / T), so a shard's bytes differ from
    T / shards by at most one document. Returns ``doc_id``, ``size``,
    ``text_crc32`` (of the UTF-8 text; null: empty), ``law`` ('bytes'),
    ``shard`` and ``slot`` (place in the shard, from 0). Null ids come first;
    ties of ids are ordered by checksum and size, and repeated rows get slots
    of their own. An empty table gives an empty table. Other columns are not
    read.

    The rows that move are 28 bytes each, texts never do. ``partitions``: of
    the range partitioning, the session's shuffle partitions by default.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size")]
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The range bounds come from a sample: partition numbers are written down so that all later steps see the same ones.
    ranged = durable(sized.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), "shards")

    running = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = ranged.withColumn("upto", F.sum("size").over(running)).withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(*order)))

    # One row for each partition: a table whose size doesn't depend on the documents.
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("base"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    middle = F.expr(f"cast(((2 * (base + upto) - size) * {int(shards)}) div (2 * total) as int)")
    placed = inner.join(F.broadcast(offsets), "part").withColumn("shard", middle)

    # At most partitions + shards rows: where each shard begins in each partition.
    stretches = placed.groupBy("part", "shard").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = stretches.select("part", "shard", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first")).alias("shift"))
    return placed.join(F.broadcast(starts), ["part", "shard"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") + F.col("shift")).alias("slot"))
