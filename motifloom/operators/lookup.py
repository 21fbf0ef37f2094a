"""Looking up the lists of many ids for each row, without shipping the row once for each of them.

A join by id ships every row, with the lists that it carries, once for each of its
ids: in a graph of degree d, d times. Here the table of lists is dealt into blocks
small enough for a task's memory, and a row goes once to each block that has any of
its ids, where its ids are looked up in memory. Tasks of one block share its rows,
each with a copy of the block. A table of one block is in every task: there rows
need not move again for further lookups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.sources.scratch import written

# Bytes of a table that one task holds, what a row takes of them beside its list, and ids of one row that are looked up by one task.
BLOCK_BYTES, ROW_BYTES, PIECE = 512 << 20, 160, 256


def _hashed(x: int) -> int:
    """Spark's hash of an int."""
    m = 0xFFFFFFFF
    turn = lambda v, r: (v << r | v >> 32 - r) & m
    h = turn(42 ^ turn(x * 0xCC9E2D51 & m, 15) * 0x1B873593 & m, 13) * 5 + 0xE6546B64 & m
    h ^= 4
    h = (h ^ h >> 16) * 0x85EBCA6B & m
    h = (h ^ h >> 13) * 0xC2B2AE35 & m
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


def places(n: int) -> list[int]:
    """Numbers that ``repartition(n, ...)`` puts in partition 0, 1, 2 ..."""
    found: dict[int, int] = {}
    x = 0
    while len(found) < n:
        found.setdefault(_hashed(x) % n, x)
        x += 1
    return [found[k] for k in range(n)]


class Lists:
    """``table``: ``id``, which doesn't repeat, and further columns; ``members``: how many ids a row's lists have."""

    def __init__(self, table: DataFrame, members: Column):
        self.table = table
        # Else Spark deals both sides anew, by place and id.
        table.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        told = table.agg(F.count("*").alias("rows"), F.coalesce(F.sum(members), F.lit(0)).alias("ids")).first()
        cores = table.sparkSession.sparkContext.defaultParallelism
        self.blocks = max(1, math.ceil((told["rows"] * ROW_BYTES + told["ids"] * 8) / BLOCK_BYTES))
        self.shares = max(1, math.ceil(2 * cores / self.blocks))
        self.places = F.array(*map(F.lit, places(self.blocks * self.shares)))
        own = F.slice(self.places, self.block(F.col("id")) * self.shares + 1, F.lit(self.shares))
        self.dealt = self.deal(table.withColumn("place", F.explode(own)))

    def block(self, x: Column) -> Column:
        return F.pmod(F.xxhash64(x), F.lit(self.blocks)).cast("int")

    def deal(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.blocks * self.shares, "place")

    def beside(self, rows: DataFrame, key: str, names: dict[str, str], split: list[str]) -> DataFrame:
        """``rows`` for each of their ``ids`` that the table has: as ``key``, with the table's columns under new ``names``.

        ``split``: columns by whose hash rows are shared among tasks. A column
        ``place`` says where the rows are; leave it in for the next lookup.
        """
        if "place" not in rows.columns or self.blocks > 1:
            kept = [c for c in rows.columns if c not in ("place", "ids")]
            if self.blocks > 1:
                parts = F.transform(F.sequence(F.lit(0), F.lit(self.blocks - 1)), lambda b: F.struct(b.alias("block"), F.filter("ids", lambda x: self.block(x) == b).alias("ids")))
                rows = rows.select(*kept, F.explode(parts).alias("p")).select(*kept, "p.*")
            else:
                rows = rows.select(*kept, F.lit(0).alias("block"), "ids")
            pieces = F.transform(F.sequence(F.lit(0), F.expr(f"int((size(ids) - 1) div {PIECE})")), lambda k: F.slice("ids", k * PIECE + 1, PIECE))
            rows = rows.where(F.size("ids") > 0).select(*kept, "block", F.posexplode(pieces).alias("piece", "ids"))
            share = F.pmod(F.xxhash64(*split, "piece"), F.lit(self.shares)).cast("int")
            rows = self.deal(rows.select(*kept, "ids", F.element_at(self.places, F.col("block") * self.shares + share + 1).alias("place")))
        else:
            kept = [c for c in rows.columns if c not in ("place", "ids")]
        rows = rows.select("place", *kept, F.explode("ids").alias(key))
        # Both sides are dealt by place already; the hint says which one is held in memory.
        table = self.dealt.select("place", F.col("id").alias(key), *[F.col(c).alias(n) for c, n in names.items()]).hint("shuffle_hash")
        return rows.join(table, ["place", key])
