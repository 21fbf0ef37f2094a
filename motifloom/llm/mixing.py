"""Mixing sources to target weights by pivotal rounding.

Only DataFrame functions are used. Every document of a source starts with the
same fractional number of copies. Inside blocks of bounded size, fractions are
paired and mass (in words) moves at random from one to the other until one
is whole; each block leaves at most one fraction, and those are combined in
the same way, level by level, so a source's taken words differ from its target
by less than one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.llm.durable import columns, durable, fresh

#: Mean number of fractions of a block.
BLOCK = 64
#: Sources up to this many are broadcast as a table; more are joined by key.
BROADCAST_SOURCES = 50_000
_WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Number of maximal runs of other characters than space and \\t to \\r; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source``, ``source_size``, ``target`` of each source from rows of ``source`` and ``size``.

    Sources by code point, null last, have the weights in turn. Targets share
    ``share`` times all sizes by weight; those above ``most`` times their
    source's size stop there and the excess is shared by weight again, until
    none is above. That is min(most * size, weight * level) with the level at
    which the targets have their sum; the stopped sources are those of the
    smallest size for their weight, found by running sums over sources in that
    order (one row for each source).
    """
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).select("source", "source_size", turn.alias("weight"))
    ratio = F.col("source_size") * F.lit(most) / F.col("weight")
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    led = totals.withColumn("ratio", ratio).withColumn("stopped", F.coalesce(F.sum(F.col("source_size")).over(upto), F.lit(0)) * F.lit(most)).withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0)))
    led = led.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - F.col("stopped")) / F.col("open"))
    # The first source in this order that isn't above its stop sets the level of the rest.
    led = led.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source", "level"))).over(everything)["level"])
    stop = F.col("source_size") * F.lit(most)
    return led.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("ratio") < F.col("level")), stop).otherwise(F.least(stop, F.col("weight") * F.col("level"))).alias("target"))


_UNIT = "struct<place:bigint,key:bigint,words:bigint,p:double>"
_DONE = "struct<key:bigint,extra:int>"


def _settle(units: str, level: int, seed: int) -> str:
    """SQL: the state after the fractions of an array met one by one: what is left open, and what became whole."""
    u = f"(pmod(xxhash64(s.open.key, x.key, {level}, {seed}), 9007199254740992) / 9007199254740992D)"
    none = f"cast(null as {_UNIT})"
    # a: the open fraction, x: the next; up: words that a can take from x, down: words that x can take from a.
    up, down = "least(s.open.words * (1 - s.open.p), x.words * x.p)", "least(s.open.words * s.open.p, x.words * (1 - x.p))"
    to_open = f"{u} * ({up} + {down}) < {down}"
    open_p = f"if({to_open}, if({up} = s.open.words * (1 - s.open.p), 1D, s.open.p + ({up}) / s.open.words), if({down} = s.open.words * s.open.p, 0D, s.open.p - ({down}) / s.open.words))"
    next_p = f"if({to_open}, if({up} = x.words * x.p, 0D, x.p - ({up}) / x.words), if({down} = x.words * (1 - x.p), 1D, x.p + ({down}) / x.words))"
    moved = f"transform(array(named_struct('a', {open_p}, 'b', {next_p})), m -> named_struct('open', if(m.a > 0D and m.a < 1D, named_struct('place', s.open.place, 'key', s.open.key, 'words', s.open.words, 'p', m.a), if(m.b > 0D and m.b < 1D, named_struct('place', x.place, 'key', x.key, 'words', x.words, 'p', m.b), {none})), 'done', concat(s.done, filter(array(named_struct('key', s.open.key, 'extra', cast(m.a as int), 'p', m.a), named_struct('key', x.key, 'extra', cast(m.b as int), 'p', m.b)), y -> y.p <= 0D or y.p >= 1D))))[0]"
    keep = f"struct<open:{_UNIT},done:array<struct<key:bigint,extra:int,p:double>>>"
    return f"aggregate({units}, cast(named_struct('open', {none}, 'done', array()) as {keep}), (s, x) -> cast(if(s.open is null, named_struct('open', x, 'done', s.done), {moved}) as {keep}))"


def _rounded(docs: DataFrame, weights: tuple[int, ...], share: float, most: float, seed: int, block: int) -> DataFrame:
    """Units (``key``, rows equal in ``doc_id``, ``source`` and ``size``, ``n`` of them) with their ``copies``."""
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))
    # Rows that repeat are one unit, so that blocks can't overflow with them.
    units = durable(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n")), "mix-units")
    targets = source_targets(units.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most)
    blocks = units.groupBy("source").agg(F.count("*").alias("docs"))
    sources = durable(targets.alias("t").join(blocks.alias("b"), F.col("t.source").eqNullSafe(F.col("b.source"))).select("t.*", "docs"), "mix-sources")
    held = sources.agg(F.count("*"), F.max("docs")).first()
    side = F.broadcast(sources) if held[0] <= BROADCAST_SOURCES else sources
    wanted = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    base = F.floor(F.col("wanted")).cast("long")
    open_units = (
        units.alias("u").join(side.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source")))
        .select("doc_id", "u.source", "size", "n", "source_size", "target", "docs", wanted.alias("wanted"))
        .withColumn("base", base).withColumn("p", F.when(F.col("size") > 0, F.col("wanted") - F.col("base")).otherwise(F.lit(0.0)))
        .withColumn("key", F.xxhash64("doc_id", "source", "size"))
        .withColumn("place", F.xxhash64("key", F.lit(seed)))
    )
    prepared = durable(open_units, "mix-fractions")

    # Level by level: arrays of about ``block`` fractions of one source, what became whole and what stays open.
    fractions = prepared.where("p > 0 and p < 1").select("source", "docs", F.struct("place", "key", (F.col("size") * F.col("n")).alias("words"), "p").cast(_UNIT).alias("unit"))
    most_docs, level, settled = held[1] or 0, 0, []
    while most_docs > 0:
        spread = F.greatest(F.lit(1), F.ceil(F.col("docs") / F.lit(float(block) ** (level + 1))))
        dealt = fractions.withColumn("block", F.pmod(F.xxhash64("unit.place", F.lit(level)), spread))
        gathered = dealt.groupBy("source", "block").agg(F.max("docs").alias("docs"), F.array_sort(F.collect_list("unit")).alias("units"))
        state = durable(gathered.select("source", "docs", F.expr(_settle("units", level, seed)).alias("state")), f"mix-level{level}")
        settled.append(state.select(F.explode("state.done").alias("one")).select("one.key", "one.extra"))
        fractions = state.where("state.open is not null").select("source", "docs", F.col("state.open").alias("unit"))
        level += 1
        if most_docs <= block ** level:
            break
    # The last fraction of a source stands alone: it becomes whole by its own chance.
    chance = F.pmod(F.xxhash64("unit.key", F.lit(seed), F.lit(-1)), F.lit(1 << 53)) / F.lit(float(1 << 53))
    settled.append(fractions.select(F.col("unit.key"), (chance < F.col("unit.p")).cast("int").alias("extra")))
    rounded = settled[0]
    for more in settled[1:]:
        rounded = rounded.unionByName(more)
    copies = (F.col("base") + F.coalesce(F.col("extra"), F.lit(0))).cast("long")
    return prepared.join(rounded, "key", "left").withColumn("copies", copies)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """How often each document is taken so that its source comes near its target.

    Returns ``doc_id``, ``source``, ``size`` (words), ``source_size``,
    ``target`` (the source's, double), ``copies`` and ``taken`` (size times
    copies). Copies are the source's target / size rounded down or up, so at
    most ``most`` rounded up; reruns agree, as all randomness is a hash of ids
    and ``seed``. A null text has size 0 and is never drawn; null and empty
    sources are sources; rows equal in doc_id, source and size are rounded
    together and all kept; an empty table gives an empty table. Other columns
    are not read.
    """
    result = _rounded(docs, weights, share, most, seed, block)
    repeated = F.explode(F.when(F.col("n") == 1, F.array(F.lit(1).cast("long"))).otherwise(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return result.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), repeated.alias("_")).drop("_")


def take_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix_sources`` takes it; a document of no words is never drawn, so it goes."""
    copies = _rounded(docs, weights, share, most, seed, block).where("copies > 0 and size > 0")
    mine, key, times, copy = fresh(docs, "own_key", "unit_key", "copies", "copy")
    copies = copies.select(F.col("key").alias(key), F.col("copies").alias(times))
    own = F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")))
    taken = docs.withColumn(mine, own).join(copies, F.col(mine) == F.col(key))
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*columns(docs))
