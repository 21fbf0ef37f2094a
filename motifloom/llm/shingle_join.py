"""Near duplicates by Jaccard similarity of word shingles: an exact parity-sketch join.

Tokens (shingles) of a set are dealt by hash to the lanes of a sketch, and each
lane holds the exclusive or of its tokens' hashes. One token changes one lane,
so the number of lanes in which two sketches differ is at most the size of the
sets' symmetric difference. Sets of sizes a and b have a similarity of at least
3/4 only if that is at most D = (a + b) / 7; so of a set's more than D filled
lanes at least one is the same in the other (pigeonhole). Sizes are cut into
bands by powers of two, each with its number of lanes, and a set also enters the
next band if a set there can be similar to it.

Lanes that many sets share say little, and a set is found without them as long
as it has more than D others. Sets for which they are needed (families of many
near copies, texts made of common passages) are compared in blocks, with
one-bit parity sketches and then exactly. So no pair is missed whatever the
frequencies, and no group's pairs are all written out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.llm.components import connected_components
from motifloom.llm.durable import columns, durable, fresh, giving_back, ship
from motifloom.llm.textkit import Words, chunks, mix, shingles, signed, text_buffer

#: Sets that may share a lane before it counts as common.
COMMON = 32
#: Bytes of lanes that a task gathers before it hands them on, and of lanes compared at once.
FLUSH_BYTES, PART_BYTES = 32 << 20, 16 << 20
#: Bytes of token sets in half a block.
BLOCK_BYTES = 4 << 20
#: Sets to fetch up to which their keys are sent to every executor; more are joined by a shuffle.
BROADCAST_KEYS = 1_000_000
#: Added to the band of the tokens that a set enters one by one, as its lanes are too few.
_TOKENWISE = 64


def lanes_of(band: np.ndarray) -> np.ndarray:
    """Lanes of the sketches of a band, of sizes from 2^band."""
    return (np.left_shift(1, band) * 7 + 9) // 10 + 8


def most_different(n: np.ndarray, band: np.ndarray) -> np.ndarray:
    """The largest symmetric difference that a similar partner in the band can have."""
    return (n + np.minimum(4 * n // 3, np.left_shift(2, band) - 1)) // 7


def sketch_words(n: np.ndarray) -> np.ndarray:
    """64-bit words of the one-bit sketches of sets of these sizes: 2 to 4 bits for a token, 256 bits at least."""
    return np.maximum(4, np.left_shift(1, np.maximum(0, np.frexp(np.maximum(n, 1).astype(float))[1].astype(np.int64) - 1 + 2 - 6)))


class Sets:
    """Token sets of a chunk: sorted (row, token), sizes, and a 64-bit name for each set."""

    def __init__(self, words: Words, width: int):
        self.row, self.token, _ = shingles(words, width)
        self.n = np.bincount(self.row, minlength=words.rows)
        self.begin = np.concatenate(([0], np.cumsum(self.n)))
        full = self.n > 0
        self.name = np.zeros(words.rows, np.uint64)
        if full.any():
            at = self.begin[:-1][full]
            self.name[full] = mix(np.add.reduceat(mix(self.token ^ np.uint64(0x5851F42D4C957F2D)), at) + self.n[full].astype(np.uint64))

    def bit_sketches(self) -> list[np.ndarray]:
        """Words of each set's one-bit sketch, at least two bits for a token; a token flips the bit that its last digits name.

        Of two sketches one may have twice the other's bits; its halves'
        exclusive or is the sketch of the other's size.
        """
        out: list[np.ndarray] = [np.zeros(0, np.uint64)] * len(self.n)
        words = sketch_words(self.n)
        for size in np.unique(words[self.n > 0]):
            rows = np.flatnonzero((words == size) & (self.n > 0))
            step = max(1, (1 << 22) // (64 * int(size)))
            for some in (rows[k : k + step] for k in range(0, len(rows), step)):
                count = self.n[some]
                place = np.arange(int(count.sum())) + np.repeat(self.begin[some] - (np.cumsum(count) - count), count)
                bit = np.repeat(np.arange(len(some)), count) * (64 * int(size)) + (self.token[place] & np.uint64(64 * int(size) - 1)).astype(np.int64)
                flips = np.bincount(bit, minlength=len(some) * 64 * int(size)) & 1
                packed = np.packbits(flips.astype(np.uint8).reshape(len(some), -1), axis=1, bitorder="little").view(np.uint64)
                for r, bits in zip(some.tolist(), packed, strict=True):
                    out[r] = bits
        return out

    def lanes(self, rows: np.ndarray, band: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index into ``rows``, band, signature) of each filled lane of the sets ``rows`` in the bands given beside them.

        Tokens are sorted, so those of a lane follow one another. Sets with no
        more lanes than they may differ in also give a signature for each token,
        marked by its band.
        """
        size = self.n[rows]
        total = int(size.sum())
        own = np.repeat(np.arange(len(rows)), size)
        place = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.begin[rows], size)
        token = self.token[place]
        lane = ((token >> np.uint64(32)) * lanes_of(band).astype(np.uint64)[own]) >> np.uint64(32)
        new = np.ones(total, bool)
        new[1:] = (own[1:] != own[:-1]) | (lane[1:] != lane[:-1])
        at = np.flatnonzero(new)
        value = np.bitwise_xor.reduceat(mix(token + np.uint64(77)), at) if total else token
        own_at, level = own[at], band[own[at]]
        poor = np.bincount(own_at, minlength=len(rows)) <= most_different(size, band)
        lane = lane[at]
        if poor.any():
            single = np.flatnonzero(poor[own])
            lane = np.concatenate([lane, np.zeros(len(single), np.uint64)])
            value = np.concatenate([value, mix(token[single] + np.uint64(78))])
            own_at = np.concatenate([own_at, own[single]])
            level = np.concatenate([level, band[own[single]] + _TOKENWISE])
        return own_at, level, mix(value + mix(lane * np.uint64(256) + level.astype(np.uint64)))


def bands_of(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, band) of every band that a set enters: its own, and the next if a similar set can be there."""
    rows = np.flatnonzero(n > 0)
    own = np.frexp(n[rows].astype(float))[1].astype(np.int64) - 1
    higher = 4 * n[rows] // 3 >= np.left_shift(2, own)
    return np.concatenate([rows, rows[higher]]), np.concatenate([own, own[higher] + 1])


def _each_sets(batches: Iterator[pa.RecordBatch], column: int, width: int) -> Iterator[tuple[pa.RecordBatch, int, int, Sets]]:
    for batch in batches:
        raw, at = text_buffer(batch.column(column))
        for first, last in chunks(at):
            yield batch, first, last, Sets(Words(raw, at, first, last), width)


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)), pa.array(signed(matrix.ravel())))


def _ragged(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in rows]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(np.concatenate(rows)) if offsets[-1] else np.zeros(0, np.int64)))


def _describe(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, set, n, bits, filled lanes in its own and the next band) of each text; set is null for an empty set."""
    for batch, first, last, sets in _each_sets(batches, 2, width):
        none = sets.n == 0
        rows, band = bands_of(sets.n)
        own, level, _ = sets.lanes(rows, band)
        count = np.bincount(own[level < _TOKENWISE], minlength=len(rows))
        higher = np.concatenate([np.zeros(int((~none).sum()), np.int64), np.ones(len(rows) - int((~none).sum()), np.int64)])
        filled = np.zeros((len(sets.n), 2), np.uint64)
        filled[rows, higher] = count
        yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(signed(sets.name), mask=none), pa.array(sets.n.astype(np.int64)), _ragged(sets.bit_sketches()), _lists(filled)], names=["doc_id", "key", "set", "n", "bits", "filled"])


def _sketch(batches: Iterator[pa.RecordBatch], width: int, parts: int) -> Iterator[pa.RecordBatch]:
    """Lanes of the partition's distinct sets, dealt to ``parts``: (part, count, blob of signatures, bands and sets)."""
    known: set[int] = set()
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        signature, level, name = (np.concatenate(x) for x in zip(*held, strict=True))
        part = (signature >> np.uint64(32)) % np.uint64(parts)
        order = np.argsort(part, kind="stable")
        edge = np.flatnonzero(np.diff(part[order])) + 1
        rows = []
        for at in np.split(order, edge):
            rows.append((int(part[at[0]]), len(at), signature[at].astype(np.uint32).tobytes() + level[at].astype(np.uint8).tobytes() + name[at].tobytes()))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["part", "n", "blob"])

    size = 0
    for _, _, _, sets in _each_sets(batches, 0, width):
        rows, band = bands_of(sets.n)
        names = sets.name.tolist()
        fresh = np.array([names[r] not in known for r in range(len(names))], bool)
        if len(known) < 2_000_000:
            known.update(names)
        keep = fresh[rows] if len(rows) else np.zeros(0, bool)
        rows, band = rows[keep], band[keep]
        if not len(rows):
            continue
        own, level, signature = sets.lanes(rows, band)
        held.append((signature, level, sets.name[rows[own]]))
        size += 21 * len(signature)
        if size >= FLUSH_BYTES:
            yield flush()
            size = 0
    if held:
        yield flush()


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets that share a lane. Blobs of a part follow one another.

    Rows: a list of 2 to COMMON sets, without a band; or one set and a
    signature that more sets share, with its band.
    """
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    now = None

    def work() -> pa.RecordBatch | None:
        signature, level, name = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        full = signature.astype(np.uint64) << np.uint64(8) | level
        order = np.argsort(full, kind="stable")
        full, name = full[order], name[order]
        edge = np.flatnonzero(np.concatenate(([True], full[1:] != full[:-1], [True])))
        crowded = np.flatnonzero(np.diff(edge) > 1)
        if not len(crowded):
            return None
        take = np.concatenate([np.arange(edge[g], edge[g + 1]) for g in crowded])
        full, name = full[take], name[take]
        order = np.lexsort((name, full))
        full, name = full[order], name[order]
        once = np.concatenate(([True], (full[1:] != full[:-1]) | (name[1:] != name[:-1])))
        full, name = full[once], name[once]
        edge = np.flatnonzero(np.concatenate(([True], full[1:] != full[:-1], [True])))
        count = np.diff(edge)
        lists: dict[bytes, np.ndarray] = {}
        for g in np.flatnonzero((count > 1) & (count <= COMMON)):
            members = name[edge[g] : edge[g + 1]]
            lists[members.tobytes()] = members
        common = np.repeat(count > COMMON, count)
        members = list(lists.values())
        n, m = len(members), int(common.sum())
        if not n + m:
            return None
        offsets = np.concatenate(([0], np.cumsum([*map(len, members), *[1] * m]))).astype(np.int32)
        values = np.concatenate([*members, name[common]]) if n else name[common]
        spot = mix(full[common] + np.uint64(now * 0x9E3779B97F4A7C15 % 2**64))
        key = np.concatenate([np.array([int(mix(x * np.uint64(31) + np.uint64(len(x))).sum()) for x in members], np.uint64), spot])
        band = np.concatenate([np.zeros(n, np.int32), (full[common] & np.uint64(255)).astype(np.int32)])
        return pa.RecordBatch.from_arrays([pa.array(signed(key)), pa.array(band, mask=np.arange(n + m) < n), pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(values)))], names=["key", "band", "sets"])

    for batch in batches:
        for part, n, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            if part != now and held and (out := work()):
                yield out
            if part != now:
                held.clear()
            now = part
            raw = blob.as_buffer()
            held.append((np.frombuffer(raw, np.uint32, n), np.frombuffer(raw, np.uint8, n, 4 * n), np.frombuffer(raw[5 * n :].to_pybytes(), np.uint64, n)))
    if held and (out := work()):
        yield out


def similar(one: np.ndarray, two: np.ndarray) -> bool:
    """Whether two sorted token arrays have a Jaccard similarity of at least 3/4."""
    both = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * both >= 75 * (len(one) + len(two) - both)


def _block_links(names: np.ndarray, part: np.ndarray, bits: list[np.ndarray], tokens: list[np.ndarray], within: bool) -> list[tuple[int, int]]:
    """Links that connect what similarity connects: within one part, or between two.

    Sets are taken by size, each against the smaller ones that the sizes allow;
    of those that the sketches leave, the nearest come first, and none that is
    connected already is compared.
    """
    n = np.array([len(t) for t in tokens])
    order = np.argsort(n, kind="stable")
    names, part, n, bits, tokens = names[order], part[order], n[order], [bits[k] for k in order], [tokens[k] for k in order]
    words = np.array([len(b) for b in bits])
    first = {int(w): int(np.searchsorted(words, w)) for w in np.unique(words)}
    table = {w: np.stack(bits[at : int(np.searchsorted(words, w, side="right"))]) for w, at in first.items()}
    root = np.arange(len(n))
    out = []
    for x in range(1, len(n)):
        low = int(np.searchsorted(n, -(-3 * n[x] // 4)))
        for w in {int(words[x]), int(words[x]) // 2} & set(first):
            start = max(low, first[w])
            stop = min(x, first[w] + len(table[w]))
            if start >= stop:
                continue
            own = bits[x] if w == words[x] else bits[x][:w] ^ bits[x][w:]
            others = np.arange(start, stop)
            fine = root[others] != root[x]
            if not within:
                fine &= part[others] != part[x]
            others = others[fine]
            apart = np.bitwise_count(table[w][others - first[w]] ^ own).sum(axis=1)
            near = apart <= (n[others] + n[x]) // 7
            for y in others[near][np.argsort(apart[near], kind="stable")]:
                if root[y] != root[x] and similar(tokens[x], tokens[y]):
                    out.append((int(names[x]), int(names[y])))
                    root[root == root[x]] = root[y]
    return out


def _compare_blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Blocks in rows that follow one another: (cluster, lo, hi, part, set, text)."""
    held: dict[int, tuple[int, str]] = {}  # by set, as rows may repeat
    now = None

    def work() -> pa.RecordBatch | None:
        names, (part, texts) = list(held), zip(*held.values(), strict=True)
        held.clear()
        tokens, bits = [], []
        whole = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])
        for _, _, _, sets in _each_sets(iter([whole]), 0, width):
            tokens += np.split(sets.token, sets.begin[1:-1])
            bits += sets.bit_sketches()
        links = _block_links(np.array(names), np.array(part), bits, tokens, now[1] == now[2])
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], names=["a", "b"]) if links else None

    for batch in batches:
        ids = list(zip(*(batch.column(c).to_pylist() for c in ("cluster", "lo", "hi")), strict=True))
        for block, part, name, text in zip(ids, batch.column("part").to_pylist(), batch.column("set").to_pylist(), batch.column("text"), strict=True):
            if block != now and held and (out := work()):
                yield out
            now = block
            held[name] = (part, text.as_py())
    if held and (out := work()):
        yield out


def _differ(a: str, b: str) -> Column:
    """Bits in which two sketches differ, the longer folded to the other's size; sets of further sizes aren't similar."""
    count = lambda x, y: f"aggregate(zip_with({x}, {y}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    folded = lambda long, short: f"transform(slice({long}, 1, size({short})), (x, i) -> x ^ get({long}, i + size({short})))"
    return F.expr(f"case when size({a}) = size({b}) then {count(a, b)} when size({a}) = 2 * size({b}) then {count(folded(a, b), b)} when size({b}) = 2 * size({a}) then {count(a, folded(b, a))} else 2147483647 end")


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) whose sizes and bit sketches don't rule out that they are similar."""
    side = lambda x: classes.select(F.col("set").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return durable(both.where((F.least("n_a", "n_b") * 4 >= F.greatest("n_a", "n_b") * 3) & (_differ("bits_a", "bits_b") <= F.floor((F.col("n_a") + F.col("n_b")) / 7))).select("a", "b"), "join-near")


def _grouped(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``key`` (of the text), ``set``, ``n``, and ``component`` and its least id (``reached``) of each row; empty sets have no component."""
    spark = docs.sparkSession
    ship(spark)
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), text.alias("text"))
    told = durable(keyed.mapInArrow(giving_back(lambda x: _describe(x, width)), "doc_id long, key long, set long, n long, bits array<long>, filled array<long>"), "join-documents")
    classes = durable(told.where("set is not null").groupBy("set").agg(F.min("doc_id").alias("least"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("row"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("filled").alias("filled")), "join-sets")

    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    expected = classes.agg(F.sum("n")).first()[0] or 0
    parts = max(shuffles, int(expected * 0.8 * 13 // PART_BYTES) + 1)
    lanes = docs.select(text).mapInArrow(giving_back(lambda x: _sketch(x, width, parts)), "part int, n int, blob binary")
    met = lanes.repartition(shuffles, "part").sortWithinPartitions("part").mapInArrow(giving_back(_meet), "key long, band int, sets array<long>")
    met = durable(met, "join-met")
    lists = durable(met.where("band is null").groupBy("key").agg(F.first("sets").alias("sets")), "join-lists")

    # Clusters of sets that may be similar. Sizes rule out most pairs of a list before their sketches are fetched: first
    # those of its smallest set with the others, then those of sets that still are in different clusters.
    sized = lists.select("key", F.explode("sets").alias("node")).join(classes.select(F.col("set").alias("node"), "n"), "node")
    sized = durable(sized.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("n", "node"))).alias("m")), "join-sized")
    pair = "named_struct('a', least(x.node, y.node), 'b', greatest(x.node, y.node))"
    star = sized.select(F.explode(F.expr(f"transform(filter(slice(m, 2, size(m)), y -> 3 * y.n <= 4 * m[0].n), y -> transform(array(m[0]), x -> {pair})[0])")).alias("p")).select("p.*").distinct()
    near = _near(star, classes)
    member = sized.where("size(m) > 2").select("key", F.explode("m").alias("x")).select("key", "x.*").join(connected_components(near), "node", "left").select("key", F.struct("n", "node", F.coalesce("component", "node").alias("group")).alias("x"))
    mixed = member.groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("m"), F.count_distinct("x.group").alias("groups")).where("groups > 1")
    rest = mixed.select(F.explode(F.expr(f"flatten(transform(m, (x, i) -> transform(filter(slice(m, i + 2, size(m)), y -> y.group != x.group and 3 * y.n <= 4 * x.n), y -> {pair})))")).alias("p")).select("p.*").distinct()
    near = near.unionByName(_near(rest, classes))
    placed = connected_components(near).select(F.col("node").alias("set"), F.xxhash64("component", F.lit(0)).alias("cluster"))

    # Sets that have too few lanes besides common ones, by band.
    common = met.where("band is not null").select(F.col("sets")[0].alias("set"), "band", "key")
    band = F.col("band") % _TOKENWISE
    entered = F.when(F.col("band") >= _TOKENWISE, F.col("n")).otherwise(F.col("filled")[F.when(band == F.floor(F.log2(F.col("n") + 0.5)), 0).otherwise(1)])
    most = F.floor((F.col("n") + F.least(F.floor(4 * F.col("n") / 3), F.pow(F.lit(2.0), band + 1) - 1)) / 7)
    counted = common.groupBy("set", "band").agg(F.count("*").alias("n_common")).join(classes.select("set", "n", "filled"), "set")
    needy = counted.where(entered - F.col("n_common") <= most).select("set", "band", "n")
    needy = durable(needy, "join-needy")
    their = durable(common.join(needy, ["set", "band"]).select(F.xxhash64("set", "band").alias("node"), "key"), "join-common")
    hub = their.groupBy("key").agg(F.min("node").alias("hub"))
    coarse = connected_components(their.join(hub, "key").select(F.col("node").alias("a"), F.col("hub").alias("b")))
    also = needy.withColumn("node", F.xxhash64("set", "band")).join(coarse, "node").select("set", F.xxhash64("component", F.lit(1)).alias("cluster"))

    # Every cluster is compared exactly, in blocks of bounded size; one text of each set travels to its blocks.
    placed = durable(placed.unionByName(also).distinct().join(classes.select("set", "n", "row"), "set"), "join-clusters")
    sizes = placed.groupBy("cluster").agg(F.ceil(F.sum(F.col("n") * 8) / BLOCK_BYTES).cast("int").alias("parts"))
    dealt = placed.join(sizes, "cluster").withColumn("part", F.pmod(F.xxhash64("set", F.lit(9)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    block = ["cluster", "lo", "hi"]
    dealt = dealt.select("cluster", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "part", "set", F.col("row.doc_id").alias("row_id"), F.col("row.key").alias("row_key"))
    dealt = durable(dealt, "join-blocks")
    side = F.broadcast(dealt) if dealt.count() <= BROADCAST_KEYS else dealt
    texts = keyed.join(side, (F.col("key") == F.col("row_key")) & F.col("doc_id").eqNullSafe(F.col("row_id")))
    full = texts.select(*block, "part", "set", "text").repartition(shuffles, *block).sortWithinPartitions(*block)
    links = durable(full.mapInArrow(giving_back(lambda x: _compare_blocks(x, width)), "a long, b long"), "join-links")

    groups = connected_components(links)
    least = classes.select("set", "least").join(groups.select(F.col("node").alias("set"), "component"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    least = durable(least, "join-groups")
    reached = least.groupBy("component").agg(F.min("least").alias("reached"))
    named = least.join(reached, "component").select("set", "component", "reached")
    return told.select("doc_id", "key", "set", "n").join(named, "set", "left")


def similar_documents(docs: DataFrame, width: int = 5) -> DataFrame:
    """Group documents whose sets of ``width``-word shingles have a Jaccard similarity of at least 3/4.

    Takes ``doc_id`` and ``text``; returns for each row ``doc_id``,
    ``n_shingles`` and ``component_id``, the least id reachable by links, its
    own included. A text of fewer words has its whole sequence as its only
    shingle; null texts and texts without words have empty sets and link with
    nothing, so their group is their own id. Rows that repeat, and texts with
    equal sets, are one set from the start. Rows with a null id link like
    others, and get the least known id of their group, or null. An empty table
    gives an empty table. Other columns are not read. Shingles and sets are
    compared by 64-bit hashes.
    """
    own = F.when(F.col("set").isNull(), F.col("doc_id")).otherwise(F.col("reached"))
    return _grouped(docs, width).select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))


def drop_near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group of ``similar_documents`` the row of the least id stays.

    Known ids come before null ones; of rows that are equal in id and text one
    stays. Texts without shingles are nobody's duplicates and all stay. Only
    the ids of what goes are joined to the texts.
    """
    told = durable(_grouped(docs, width).where("set is not null").select("component", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key").alias("row")), "dedup-rows")
    best = told.groupBy("component").agg(F.min("row").alias("best"))
    judged = told.groupBy("component", "row").agg(F.count("*").alias("n")).join(best, "component")
    own, id_, key, one = fresh(docs, "own_key", "gone_id", "gone_key", "stays")
    gone = durable(judged.where("row != best or n > 1").select(F.col("row.doc_id").alias(id_), F.col("row.key").alias(key), (F.col("row") == F.col("best")).alias(one)), "dedup-gone")
    side = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    marked = docs.withColumn(own, F.xxhash64(F.col("text").cast("string"))).join(side, (F.col(own) == F.col(key)) & F.col("doc_id").cast("long").eqNullSafe(F.col(id_)), "left")
    stays = marked.where(F.col(key).isNull()).select(*columns(docs))
    return stays.union(marked.where(F.col(one)).dropDuplicates([id_, key]).select(*columns(docs)))
