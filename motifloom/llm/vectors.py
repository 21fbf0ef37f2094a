"""Near duplicates among embeddings by Euclidean p-stable hashing.

Vectors are normalised, so cosines are distances. Each of several tables hashes
a vector by quantised random projections; vectors of one label that share a
bucket in any table are compared by exact cosines. Equal vectors are one from
the start, buckets are compared in blocks of bounded size, and a pair counts
only in the first table that brings it together, so pairs are never written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.components import connected_components
from motifloom.llm.durable import durable, ship
from motifloom.llm.textkit import mix, signed

#: Width of a projection's cells.
CELL = 2.0
#: Chance that a pair just at the threshold shares a bucket.
RECALL = 0.99
#: Unrelated vectors of the largest label that share a bucket of one, in the mean.
STRANGERS = 0.05
#: Rows of half a block.
BLOCK = 512
#: Labels up to which their sizes are sent to every executor; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000


def _same_cell(distance: float, cell: float = CELL) -> float:
    """Chance that two points of this distance fall into one cell of a projection."""
    r = cell / distance
    return 1 - math.erfc(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan_tables(largest_label: int, cosine: float, recall: float = RECALL) -> tuple[int, int]:
    """(projections of a table, tables) for the size of the largest label."""
    near, far = _same_cell(math.sqrt(2 - 2 * cosine)), _same_cell(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(2.0, largest_label / STRANGERS)) / -math.log(far)))
    return k, max(1, math.ceil(math.log(1 - recall) / math.log(1 - near**k)))


def bucket_keys(units: np.ndarray, salt: np.ndarray, k: int, tables: int) -> np.ndarray:
    """rows x tables: a 64-bit bucket of each normalised vector in each table; ``salt`` keeps labels apart."""
    rng = np.random.default_rng(units.shape[1] * 1_000_003 + 11)
    lines = rng.standard_normal((units.shape[1], tables * k))
    cells = np.floor((units @ lines + rng.uniform(0, CELL, tables * k)) / CELL).astype(np.int64).view(np.uint64).reshape(len(units), tables, k)
    out = mix(np.repeat(salt[:, None], tables, 1) + np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    for j in range(k):
        out = (out ^ cells[:, :, j]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out)


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal-length float64 bytes."""
    return np.stack([np.frombuffer(x.as_buffer(), np.float64) for x in column])


def _links(vectors: np.ndarray, keys: np.ndarray, table: int, part: np.ndarray, lo: int, hi: int, cosine: float) -> np.ndarray:
    """Matrix of the links that a block is the first to see: within one part, or between two."""
    linked = vectors @ vectors.T >= cosine
    if lo == hi:
        linked &= ~np.eye(len(vectors), dtype=bool)
    else:
        linked &= part[:, None] != part[None, :]
    for t in range(table):
        i, j = np.nonzero(np.triu(linked))
        if not len(i):
            break
        old = keys[i, t] == keys[j, t]
        linked[i[old], j[old]] = linked[j[old], i[old]] = False
    return linked


def _tree(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges that connect what ``linked`` connects."""
    fresh = linked.any(axis=1)
    out = []
    for root in range(len(linked)):
        if not fresh[root]:
            continue
        fresh[root] = False
        queue = [root]
        while queue:
            one = queue.pop()
            found = np.flatnonzero(linked[one] & fresh)
            fresh[found] = False
            out += [(one, int(x)) for x in found]
            queue += found.tolist()
    return out


def _compare(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Blocks, each in rows that follow one another: (table, bucket, lo, hi, part, gid, copies, vector, keys)."""
    held: list[pa.RecordBatch] = []

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        ids = [np.asarray(rows[c].combine_chunks()) for c in ("table_no", "bucket", "lo", "hi")]
        cut = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1 if len(rows) > 1 else np.zeros(0, np.int64)
        gid, copies, part = (np.asarray(rows[c].combine_chunks()) for c in ("gid", "copies", "part"))
        vectors, keys = rows["vector"].combine_chunks(), rows["keys"].combine_chunks()
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        n: list[np.ndarray] = []
        for first, last in zip(np.append(0, cut), np.append(cut, len(rows)), strict=True):
            if last - first < 2:
                continue
            own = _matrix(vectors.slice(first, last - first))
            own_keys = np.asarray(keys.slice(first, last - first).flatten()).reshape(last - first, -1)
            linked = _links(own, own_keys, int(ids[0][first]), part[first:last], int(ids[2][first]), int(ids[3][first]), cosine)
            some = np.flatnonzero(linked.any(axis=1))
            if len(some):
                who, weight = gid[first:last], copies[first:last]
                tree = np.array(_tree(linked))
                a += [who[some], who[tree[:, 0]]]
                b += [np.full(len(some), -1), who[tree[:, 1]]]
                n += [linked[some] @ weight, np.full(len(tree), -1)]
        if not a:
            return None
        links = np.concatenate(n)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b), mask=links >= 0), pa.array(links, mask=links < 0)], names=["a", "b", "n"])

    def whole(rows: pa.Table) -> int:
        """Rows before the last block, which may go on in the next batch."""
        names = ("table_no", "bucket", "lo", "hi")
        last = [rows[c][-1].as_py() for c in names]
        same = np.all([np.asarray(rows[c].combine_chunks()) == v for c, v in zip(names, last, strict=True)], axis=0)
        other = np.flatnonzero(~same)
        return int(other[-1]) + 1 if len(other) else 0

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([*held, batch])
        done = whole(rows)
        if done and (out := work(rows.slice(0, done).combine_chunks())):
            yield out
        held = rows.slice(done).combine_chunks().to_batches()
    if held and (out := work(pa.Table.from_batches(held))):
        yield out


def link_vectors(vectors: DataFrame, cosine: float = 0.93, recall: float = RECALL) -> DataFrame:
    """Link vectors of one label whose cosine is at least ``cosine``.

    Takes ``vec_id``, ``embedding`` and ``label``; returns for each row
    ``vec_id``, ``n_links`` (rows linked directly, equal vectors included),
    ``component_id`` (the least id reachable, its own included) and ``kept``
    (whether that is its own). Vectors that are null, empty, zero or hold null
    or non-finite values, and rows without a label, link with nothing, nor do
    vectors of different lengths. Rows that repeat are rows; a null id stays
    null and never names a component that has another id. An empty table gives
    an empty table. Other columns are not read.
    """
    spark = vectors.sparkSession
    ship(spark)
    e = F.transform("embedding", lambda x: x.cast("double"))
    fine = F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = durable(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), e.alias("e"), F.coalesce(fine, F.lit(False)).alias("fine")).withColumn("gid", F.when(F.col("fine"), F.xxhash64("label", "e"))).select("vec_id", "gid", F.when(F.col("fine"), F.col("label")).alias("label"), F.when(F.col("fine"), F.col("e")).alias("e")), "vectors")
    # Equal vectors of a label are one from here on; a 64-bit hash stands for them.
    groups = durable(rows.where("gid is not null").groupBy("gid").agg(F.first("label").alias("label"), F.first("e").alias("e"), F.count("*").alias("copies"), F.min("vec_id").alias("least")), "vector-groups")
    # Labels are planned for by size, up to a factor of four, so that small ones have few tables.
    sizes = durable(groups.groupBy("label").agg(F.ceil(F.log2(F.count("*")) / 2).cast("int").alias("tier")), "vector-labels")
    plans = {r["tier"]: plan_tables(4 ** r["tier"], cosine, recall) for r in sizes.select("tier").distinct().collect()}  # some 30 at most
    tiered = groups.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_LABELS else sizes, "label")

    def hash_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                lists = part.column("e")
                at = np.asarray(lists.offsets)
                values = np.asarray(lists.values)
                kind = np.stack([np.diff(at), np.asarray(part.column("tier"))], axis=1)
                for size, tier in np.unique(kind, axis=0).tolist():
                    members = np.flatnonzero((kind == (size, tier)).all(axis=1))
                    one = values[at[members][:, None] + np.arange(size)]
                    one = one / np.abs(one).max(axis=1, keepdims=True)  # no overflow in the norm
                    one /= np.linalg.norm(one, axis=1, keepdims=True)
                    own = part.take(pa.array(members))
                    k, tables = plans[tier]
                    keys = bucket_keys(one, np.asarray(own.column("salt")).view(np.uint64), k, tables)
                    lists_ = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, tables, dtype=np.int32)), pa.array(signed(keys.ravel())))
                    yield pa.RecordBatch.from_arrays([own.column("gid"), own.column("copies"), pa.array([x.tobytes() for x in one]), lists_], names=["gid", "copies", "vector", "keys"])

    hashed = tiered.select("gid", "copies", "e", F.xxhash64("label", F.size("e")).alias("salt"), "tier").mapInArrow(hash_all, "gid long, copies long, vector binary, keys array<long>")
    hashed = durable(hashed, "vector-keys")
    cells = hashed.select("gid", F.posexplode("keys").alias("table_no", "bucket"))
    crowded = cells.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    members = cells.join(crowded, "bucket").withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("gid", F.lit(3)), F.col("parts")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    members = members.select("gid", "table_no", "bucket", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    block = ["table_no", "bucket", "lo", "hi"]
    # Half of each key tells whether two vectors have met in an earlier table.
    dealt = members.join(hashed.withColumn("keys", F.expr("transform(keys, x -> cast(shiftright(x, 32) as int))")), "gid").repartition(n, *block).sortWithinPartitions(*block)
    seen = durable(dealt.select(*block, "part", "gid", "copies", "vector", "keys").mapInArrow(lambda batches: _compare(batches, cosine), "a long, b long, n long"), "vector-links")

    links = seen.where("n is not null").groupBy(F.col("a").alias("gid")).agg(F.sum("n").alias("n"))
    stars = connected_components(seen.where("b is not null").select("a", "b"))
    least = stars.join(groups.select(F.col("gid").alias("node"), "least"), "node").groupBy("component").agg(F.min("least").alias("least"))
    least = stars.join(least, "component").select(F.col("node").alias("gid"), F.col("least").alias("reached"))
    told = groups.select("gid", "copies", "least").join(links, "gid", "left").join(least, "gid", "left")
    told = told.select("gid", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("reached", "least").alias("component_id"))
    out = rows.select("vec_id", "gid").join(told, "gid", "left")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
