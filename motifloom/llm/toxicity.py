"""Toxicity by class-conditional language models with Kneser-Ney smoothing.

A bigram model is counted for toxic and one for ordinary texts. Counts lose
absolute discounts, one each for counts of 1, 2 and more, estimated from the
counts of counts. What a class's bigrams lose goes to the bigrams of both classes
together, and what those lose to the class's lower order, in which a word counts
by the different words before it; from there, discounted likewise, to one
distribution of such continuation counts that the classes share. So a rare
expression is judged by what both classes have of it, and says little alone.

Three log-likelihood ratios make a text's score: the mean over its words (the
length-normalised one), the greatest of a word after the word before it, and the
greatest of a word in the lower order. A logistic curve, fitted on labelled texts
that the models haven't counted, turns them into a score.

All labelled rows of folds 0, 1 and 3 are counted, copies too, but for a bounded
number of texts that calibrate. No n-gram is dropped for being rare. The counts
are a table of n-grams cut into ranges of their keys. Texts are dealt in blocks
as sequences of word keys, each block asks every range once for the different
n-grams that it has, and works its scores out from the counts that come back, so
nothing that grows with the corpus is sent to every executor or to the driver.
What travels is packed: sorted keys as differences, counts by their bytes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from motifloom.llm.durable import durable, ship
from motifloom.llm.packed import pack, steps, summed, unpack
from motifloom.llm.textkit import Words, chunks, mix, text_buffer

#: Different labelled texts, at most, that calibrate the score and aren't counted.
CALIBRATION_ROWS = 20_000
#: Labelled rows up to which their ids are sent to every executor; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
#: Bytes of text, about, of each block of texts; and of a range of keys, bytes counted there or asking there, whichever needs more ranges.
BLOCK_BYTES, COUNTED_BYTES, ASKING_BYTES = 64 << 20, 24 << 20, 128 << 20
#: Shuffle partitions, at most, that blocks and ranges are dealt to; a partition's blocks and ranges are worked on one by one.
MOST_PARTITIONS = 32_768
#: Words, or different bigrams, that a task gathers before it hands them on.
HELD_WORDS, HELD_PAIRS = 3 << 20, 2 << 20
#: Different bigrams whose chances are worked out at once.
TOLD_PAIRS = 1 << 17
#: Bits of a key beyond those that number the counted words: a foreign n-gram is taken for a counted one at a chance of 2^-14 at most.
SPARE_BITS = 14
PREDICT_FROM = 0.3

_GAP = np.ones(256, bool)
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = _GAP[128:] = False
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_PAIR = np.uint64(0x8EBC6AF09C88C6E3)
#: What a word's counts tell: in each class the different words before it, in both together; for each class how many
#: different words follow it once, twice and more often, and how many follow in all; the first three for both together.
_OF_WORD = 14
_FEATURES = ("mean_ratio", "bigram_ratio", "word_ratio")
_ROW = "block int, kind int, part int, blob binary"


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is held out. A null id counts as an empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 4


@dataclass(frozen=True)
class Keys:
    """Names of words and bigrams, ``bits`` of their hashes, the ``parts`` that their range is cut into, and the ``blocks`` of texts that ask for them."""

    bits: int
    parts: int
    blocks: int = 1

    @staticmethod
    def of(counted: int, scored: int) -> Keys:
        """For so many bytes of texts."""
        return Keys(min(64, (counted // 5 + 1).bit_length() + SPARE_BITS), max(counted // COUNTED_BYTES, scored // ASKING_BYTES) + 1, scored // BLOCK_BYTES + 1)

    @property
    def start(self) -> np.uint64:
        """The word before a text's first."""
        return np.uint64((1 << self.bits) - 1)

    def short(self, h: np.ndarray) -> np.ndarray:
        return h >> np.uint64(64 - self.bits)

    def pair(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return self.short(mix(first * _PAIR + last))

    def cuts(self, sorted_keys: np.ndarray) -> list[tuple[int, int, int]]:
        """(part, from, to) of the parts that have any of the keys."""
        inner = np.array([-(-(k << self.bits) // self.parts) for k in range(1, self.parts)], np.uint64)
        at = [0, *np.searchsorted(sorted_keys, inner).tolist(), len(sorted_keys)]
        return [(k, at[k], at[k + 1]) for k in range(self.parts) if at[k] < at[k + 1]]


def _labelled(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All labelled texts that may be learnt from, as those that are counted and those that calibrate: ``doc_id``, ``text``, ``toxic``; the latter with ``h``, a hash of the text.

    At most CALIBRATION_ROWS different texts, and at most half of those that
    are found in fold 3 alone, calibrate; all other rows are counted.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("fold", fold_of(F.col("doc_id"))).where("fold != 2")
    known = durable(known, "toxic-labels")
    small = known.count() <= BROADCAST_LABELS
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = own.join(F.broadcast(known) if small else known, "doc_id").withColumn("h", F.xxhash64("text"))
    alone = durable(texts.groupBy("h").agg(F.min("fold").alias("least")).where("least = 3").select("h"), "toxic-texts")
    share = min(0.5, 0.98 * CALIBRATION_ROWS / max(1, alone.count()))
    chosen = F.broadcast(alone.where(F.col("h") < int((share - 0.5) * 2**64)))
    return texts.join(chosen, "h", "left_anti").drop("h", "fold"), texts.join(chosen, "h", "left_semi").drop("fold")


# --- counting --------------------------------------------------------------


def _same(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.zeros(0, np.int64)


def _distinct(*values: np.ndarray) -> np.ndarray:
    """The different values, sorted. ``np.unique`` hashes integers, which takes many times as long as sorting these."""
    out = np.concatenate(values)
    out.sort()
    return out[_same(out)]


def _before(word: np.ndarray, opens: np.ndarray, start: int | np.uint64) -> np.ndarray:
    """The word before each, given which open a text and what is before those."""
    out = np.empty_like(word)
    out[1:] = word[:-1]
    out[opens] = start
    return out


def _merged(key: np.ndarray, carried: list[np.ndarray], summands: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """One row for each key, in their order, with its first carried values and the sums of the others."""
    order = np.argsort(key)
    key = key[order]
    at = _same(key)
    if not len(at):
        return key, carried, summands
    return key[at], [c[order][at] for c in carried], [np.add.reduceat(s[order], at, dtype=np.uint64) for s in summands]


def _count(batches: Iterator[pa.RecordBatch], keys: Keys) -> Iterator[pa.RecordBatch]:
    """(part, blob) rows: the words of bigrams and how often each class has them, of (text, toxic) rows."""
    held: list[tuple] = []
    size = 0

    def merge() -> tuple:
        key, first, last, n0, n1 = (np.concatenate(x) for x in zip(*held, strict=True))
        key, (first, last), (n0, n1) = _merged(key, [first, last], [n0, n1])
        held[:] = [(key, first, last, n0, n1)]
        return held[0]

    def flush() -> pa.RecordBatch:
        key, first, last, n0, n1 = merge()
        held.clear()
        parts, blobs = [], []
        for part, a, b in keys.cuts(key):
            words = _distinct(first[a:b], last[a:b])
            one, two = (np.searchsorted(words, x[a:b]).astype(np.uint32) for x in (first, last))
            order = np.lexsort((one, two))
            parts.append(part)
            blobs.append(pack([steps(words), steps(one[order]), steps(two[order]), n0[a:b][order], n1[a:b][order]]))
        return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(blobs, pa.binary())], names=["part", "blob"])

    for batch in batches:
        raw, at = text_buffer(batch.column(0))
        toxic = np.asarray(batch.column(1).to_numpy(zero_copy_only=False)) > 0
        for first, last in chunks(at):
            words = Words(raw, at, first, last, _FOLD, _GAP)
            if not len(words.hash):
                continue
            word = keys.short(words.hash)
            before = _before(word, _same(words.row), keys.start)
            own = toxic[first:last][words.row]
            key, (b, w), n = _merged(keys.pair(before, word), [before, word], [own.astype(np.uint32), (~own).astype(np.uint32)])
            held.append((key, b, w, *n))
            size += len(key)
            if size > HELD_PAIRS:
                size = len(merge()[0])
                if size > HELD_PAIRS // 2:
                    yield flush()
                    size = 0
    if held:
        yield flush()


def _each_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The blobs of each part; a part's rows follow one another."""
    now, held = None, []
    for batch in batches:
        for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
            if part != now and held:
                yield now, held
                held = []
            now = part
            held.append(blob.as_py())
    if held:
        yield now, held


def _rows(part: list[int], kind: list[int], blob: list[bytes], stats: list[list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary()), pa.array(stats, pa.list_(pa.int64()))], names=["part", "kind", "blob", "stats"])


_COUNTED = "part int, kind int, blob binary, stats array<long>"


def _having(*counts: np.ndarray) -> list[int]:
    """Of each array of counts how many are 1, 2, 3 and 4."""
    return [int((c == k).sum()) for c in counts for k in (1, 2, 3, 4)]


def _merge_pairs(batches: Iterator[pa.RecordBatch], keys: Keys) -> Iterator[pa.RecordBatch]:
    """Kind -1: a part's bigrams with the counts of both classes. Kind 0: by parts of words, what they tell of words."""
    for part, blobs in _each_part(batches):
        held: list[list[np.ndarray]] = [[], [], [], []]
        while blobs:
            (words, one, two, n0, n1), _ = unpack(blobs.pop())
            words = summed(words)
            for column, x in zip(held, (words[summed(one)], words[summed(two)], n0, n1), strict=True):
                column.append(x)
        first, last, n0, n1 = (np.concatenate(held.pop(0)) for _ in range(4))
        key, (first, last), n = _merged(keys.pair(first, last), [first, last], [n0, n1])
        yield _rows([part], [-1], [pack([steps(key), *n])], [_having(*n, n[0] + n[1])])
        words = _distinct(first, last)
        one, two = np.searchsorted(words, first), np.searchsorted(words, last)
        each = lambda at, weights=None: np.bincount(at, weights=weights, minlength=len(words)).astype(np.uint64)
        told = [each(two[n[0] > 0]), each(two[n[1] > 0]), each(two)]
        for c in n:
            told += [each(one[c == 1]), each(one[c == 2]), each(one[c > 2]), each(one, c.astype(float))]
        told += [each(one[sum(n) == 1]), each(one[sum(n) == 2]), each(one[sum(n) > 2])]
        for of, a, b in keys.cuts(words):
            yield _rows([of], [0], [pack([steps(words[a:b]), *[x[a:b] for x in told]])], [[]])


def _merge_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A part's words with all their counts, and what the discounts of the lower order need."""
    for part, blobs in _each_part(batches):
        held = []
        for blob in blobs:
            (words, *told), _ = unpack(blob)
            held.append((summed(words), *told))
        key, *told = (np.concatenate(x) for x in zip(*held, strict=True))
        key, _, told = _merged(key, [], told)
        k0, k1, k = told[:3]
        many = [int((c > 2).sum()) for c in (k0, k1)]
        yield _rows([part], [0], [pack([steps(key), *told])], [[*_having(k0, k1), *many, int(k0.sum()), int(k1.sum()), int(k.sum())]])


def _discounts(having: list[int]) -> tuple[float, float, float]:
    """Absolute discounts of counts of 1, 2 and more, from how many counts are 1, 2, 3 and 4; within bounds where those are too few to tell."""
    n1, n2, n3, n4 = (float(n) for n in having)
    share = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [k - (k + 1) * share * more / fewer if fewer and more else k * 0.5 for k, fewer, more in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    one = min(max(found[0], 0.1), 0.95)
    two = min(max(found[1], one), 1.9)
    return one, two, min(max(found[2], two), 2.9)


@dataclass
class Model:
    """Counts of bigrams (``pairs``) and words by parts, and the discounts and totals that turn them into chances."""

    keys: Keys
    pairs: DataFrame  # part, blob: keys, counts of both classes
    words: DataFrame  # part, blob: keys, _OF_WORD counts
    of_pairs: list[tuple[float, float, float]]  # toxic, ordinary, both together
    of_words: list[tuple[float, float, float]]
    total: list[int]  # of continuation counts: toxic, ordinary, both together
    left: list[float]  # share of the lower order that each class leaves to the shared one

    def chances(self) -> tuple[Callable, Callable]:
        """(of words, of bigrams): what words' counts (_OF_WORD x n) give, and log P(toxic) - log P(ordinary) of bigrams and of their last words in the lower order.

        Of words: their chance in both classes' lower orders, what they leave as
        a context to the next order (both classes, both together), and how many
        words follow them in both classes. Of bigrams: from their counts (2 x n),
        and what their last and their first words give.
        """
        of_pairs, of_words, total, left = self.of_pairs, self.of_words, self.total, self.left

        def lost(n: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
            return np.array([0.0, *by])[np.minimum(n, 3).astype(np.int64)]

        def given(counts: np.ndarray, all_: np.ndarray, by: tuple[float, float, float]) -> np.ndarray:
            """Share that a context leaves to the next order: all, if it was never seen."""
            return np.where(all_ > 0, (by[0] * counts[0] + by[1] * counts[1] + by[2] * counts[2]) / np.maximum(all_, 1), 1.0)

        def words(n: np.ndarray) -> np.ndarray:
            # A word that neither class has counts as one that follows one word in both together.
            shared = np.maximum(n[2], 1).astype(float) / max(1, total[2])
            low = [(n[c] - lost(n[c], of_words[c])) / max(1, total[c]) + left[c] * shared for c in (0, 1)]
            all_ = [n[6].astype(float), n[10].astype(float)]
            return np.stack([*low, given(n[3:], all_[0], of_pairs[0]), given(n[7:], all_[1], of_pairs[1]), given(n[11:], all_[0] + all_[1], of_pairs[2]), *all_])

        def bigrams(n: np.ndarray, low: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            both = n[0] + n[1]
            pooled = (both - lost(both, of_pairs[2])) / np.maximum(first[3] + first[4], 1)
            chance = [(n[c] - lost(n[c], of_pairs[c])) / np.maximum(first[3 + c], 1) + first[c] * (pooled + first[2] * low[c]) for c in (0, 1)]
            return np.log(chance[0] / chance[1]), np.log(low[0] / low[1])

        return words, bigrams


def count_model(texts: DataFrame, keys: Keys) -> Model:
    """The model of ``texts`` (``text``, ``toxic``)."""
    ship(texts.sparkSession)
    tasks = min(keys.parts, MOST_PARTITIONS)
    dealt = lambda df: df.repartitionById(tasks, F.col("part")).sortWithinPartitions("part")
    counted = texts.select("text", "toxic").mapInArrow(lambda x: _count(x, keys), "part int, blob binary")
    merged = durable(dealt(counted).mapInArrow(lambda x: _merge_pairs(x, keys), _COUNTED), "toxic-pairs", by="kind")
    words = durable(dealt(merged.where("kind = 0").select("part", "blob")).mapInArrow(_merge_words, _COUNTED), "toxic-words")
    # One row of sums for each part, added up by Spark.
    added = lambda df, n: [int(x or 0) for x in df.agg(*[F.sum(F.get("stats", F.lit(k))) for k in range(n)]).first()]
    pairs = merged.where("kind = -1")
    having, lower = added(pairs, 12), added(words, 13)
    of_words = [_discounts(lower[:4]), _discounts(lower[4:8])]
    total = lower[10:]
    spent = [of_words[c][0] * lower[4 * c] + of_words[c][1] * lower[4 * c + 1] + of_words[c][2] * lower[8 + c] for c in (0, 1)]
    left = [spent[c] / total[c] if total[c] else 1.0 for c in (0, 1)]
    return Model(keys, pairs.select("part", "blob"), words.select("part", "blob"), [_discounts(having[k : k + 4]) for k in (0, 4, 8)], of_words, total, left)


# --- scoring ---------------------------------------------------------------


def _deal(batches: Iterator[pa.RecordBatch], keys: Keys, keep: int) -> Iterator[pa.RecordBatch]:
    """Texts as word keys: rows of kind 1 by block, each with a dictionary, a sequence of its entries, the texts' lengths in words and the first ``keep`` columns."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    beside: list[pa.RecordBatch] = []
    size = 0

    def flush() -> pa.RecordBatch:
        word, count, block = (np.concatenate(x) for x in zip(*held, strict=True))
        rows = pa.Table.from_batches(beside)
        held.clear()
        beside.clear()
        begin = np.concatenate(([0], np.cumsum(count)))
        order = np.argsort(block, kind="stable")
        edge = [*_same(block[order]).tolist(), len(order)]
        blocks, blobs = [], []
        for a, b in zip(edge[:-1], edge[1:], strict=True):
            own = order[a:b]
            n = count[own]
            place = np.arange(int(n.sum())) + np.repeat(begin[own] - (np.cumsum(n) - n), n)
            entries, at, often = np.unique(word[place], return_inverse=True, return_counts=True)
            by = np.lexsort((entries, -often))  # frequent words get small numbers
            number = np.empty(len(by), np.uint32)
            number[by] = np.arange(len(by), dtype=np.uint32)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(rows.take(pa.array(own)))
            blocks.append(int(block[own[0]]))
            blobs.append(pack([steps(entries[by]), number[at], n.astype(np.uint32)], sink.getvalue().to_pybytes()))
        m = len(blocks)
        return pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), pa.array([1] * m, pa.int32()), pa.array([0] * m, pa.int32()), pa.array(blobs, pa.binary())], names=["block", "kind", "part", "blob"])

    for batch in batches:
        raw, at = text_buffer(batch.column(keep))
        block = batch.column(keep + 1).to_numpy()
        for first, last in chunks(at):
            words = Words(raw, at, first, last, _FOLD, _GAP)
            held.append((keys.short(words.hash), words.per_row(), block[first:last]))
            beside.append(batch.slice(first, last - first).select(list(range(keep))))
            size += len(words.hash) + last - first
            if size > HELD_WORDS:
                yield flush()
                size = 0
    if held:
        yield flush()


class _Texts:
    """What a dealt blob holds: ``entries``, the keys of its different words and of the start, and its bigrams' keys and the places of their words there."""

    def __init__(self, blob: bytes, keys: Keys):
        (entries, self.last, count), self.beside = unpack(blob)
        self.entries = np.append(summed(entries), keys.start)
        self.count = count.astype(np.int64)
        begin = np.cumsum(self.count) - self.count
        self.first = _before(self.last, begin[self.count > 0], len(entries))
        self.pair = keys.pair(self.entries[self.first], self.entries[self.last])


def _asked(blobs: list[bytes], keys: Keys) -> tuple[np.ndarray, np.ndarray]:
    """The different bigrams and words of a block, sorted."""
    pairs, words = [np.zeros(0, np.uint64)], [np.full(1, keys.start)]
    for blob in blobs:
        texts = _Texts(blob, keys)
        pairs.append(_distinct(texts.pair))
        words.append(texts.entries)
        del texts
        if sum(map(len, pairs[1:])) > 2 * HELD_PAIRS:
            pairs, words = [_distinct(*pairs)], [_distinct(*words)]
    return _distinct(*pairs), _distinct(*words)


def _ask(batches: Iterator[pa.RecordBatch], keys: Keys) -> Iterator[pa.RecordBatch]:
    """Rows of kind 1 by part: the bigrams and words that a block looks for there."""
    for block, blobs in _each_block(batches):
        pairs, words = _asked(blobs, keys)
        of = [{k: x[a:b] for k, a, b in keys.cuts(x)} for x in (pairs, words)]
        parts = sorted({*of[0], *of[1]})
        none = np.zeros(0, np.uint64)
        told = [pack([steps(x.get(k, none)) for x in of]) for k in parts]
        m = len(parts)
        yield pa.RecordBatch.from_arrays([pa.array([block] * m, pa.int32()), pa.array([1] * m, pa.int32()), pa.array(parts, pa.int32()), pa.array(told, pa.binary())], names=["block", "kind", "part", "blob"])


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of kind 0 by block: the counts of what it asked a part for, in its order. A part's table comes before what it is asked."""
    empty = lambda n: (np.zeros(0, np.uint64), [np.zeros(0, np.uint64)] * n)
    now, pairs, words = None, empty(2), empty(_OF_WORD)

    def found(table: tuple[np.ndarray, list[np.ndarray]], sought: np.ndarray) -> list[np.ndarray]:
        known, counts = table
        if not len(known):
            return [np.zeros(len(sought), np.uint64)] * len(counts)
        at = np.minimum(np.searchsorted(known, sought), len(known) - 1)
        hit = known[at] == sought
        return [np.where(hit, c[at], np.uint64(0)) for c in counts]

    for batch in batches:
        for block, kind, part, blob in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "part")), batch.column("blob"), strict=True):
            if part != now:
                now, pairs, words = part, empty(2), empty(_OF_WORD)
            arrays, _ = unpack(blob.as_py())
            if kind < 1:
                told = summed(arrays[0]), arrays[1:]
                pairs, words = (told, words) if kind < 0 else (pairs, told)
                continue
            out = pack([*found(pairs, summed(arrays[0])), *found(words, summed(arrays[1]))])
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([0], pa.int32()), pa.array([part], pa.int32()), pa.array([out], pa.binary())], names=["block", "kind", "part", "blob"])


def _each_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes]]]:
    """The dealt texts of each block; a block's rows follow one another."""
    now, held = None, []
    for batch in batches:
        for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob"), strict=True):
            if block != now and held:
                yield now, held
                held = []
            now = block
            held.append(blob.as_py())
    if held:
        yield now, held


def _features(bigram: np.ndarray, word: np.ndarray, count: np.ndarray) -> list[np.ndarray]:
    """_FEATURES of texts of ``count`` words from the ratios of their words; 0 without words."""
    begin = np.concatenate(([0], np.cumsum(count)))
    total = np.concatenate(([0.0], np.cumsum(bigram)))
    full = count > 0
    out = [np.zeros(len(count)) for _ in _FEATURES]
    if full.any():
        out[0][full] = (total[begin[1:]] - total[begin[:-1]])[full] / count[full]
        out[1][full], out[2][full] = (np.maximum.reduceat(x, begin[:-1][full]) for x in (bigram, word))
    return out


def _score(dealt: pa.Table, answers: pa.Table, keys: Keys, chances: tuple[Callable, Callable]) -> pa.Table:
    """The kept columns and the features of a block's texts, from the counts that it was told."""
    blobs = dealt["blob"].to_pylist()
    del dealt
    pairs, words = _asked(blobs, keys)
    of_pairs, of_words = np.empty((2, len(pairs)), np.float32), np.empty((_OF_WORD, len(words)), np.float32)
    at = [0, 0]
    for told in answers.sort_by("part")["blob"]:
        counts, _ = unpack(told.as_py())
        for k, (table, some) in enumerate(((of_pairs, counts[:2]), (of_words, counts[2:]))):
            for row, c in zip(table, some, strict=True):
                row[at[k] : at[k] + len(c)] = c
            at[k] += len(some[0])
    if at != [len(pairs), len(words)]:
        raise ValueError("a block's answers don't fit what it asked")
    given, bigrams = chances
    of_words = given(of_words)

    def features(texts: _Texts) -> list[np.ndarray]:
        if not len(texts.pair):
            return [np.zeros(len(texts.count))] * len(_FEATURES)
        order = np.argsort(texts.pair)
        key = texts.pair[order]
        at = _same(key)
        each, some, own = key[at], np.minimum.reduceat(order, at), np.searchsorted(words, texts.entries)
        place = np.empty(len(order), np.uint32)
        place[order] = np.repeat(np.arange(len(at), dtype=np.uint32), np.diff(at, append=len(order)))
        del order, key
        told = np.empty((2, len(each)))
        for a in range(0, len(each), TOLD_PAIRS):
            now = slice(a, a + TOLD_PAIRS)
            last, first = (own[w[some[now]]] for w in (texts.last, texts.first))
            told[:, now] = bigrams(of_pairs[:, np.searchsorted(pairs, each[now])], of_words[:2, last], of_words[2:, first])
        return _features(told[0][place], told[1][place], texts.count)

    out = []
    for blob in blobs:
        texts = _Texts(blob, keys)
        x, beside = features(texts), texts.beside
        del texts  # before the next one's are unpacked
        begin = 0
        for batch in pa.ipc.open_stream(beside):
            end = begin + batch.num_rows
            out.append(pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(f[begin:end]) for f in x]], names=[*batch.schema.names, *_FEATURES]))
            begin = end
    return pa.Table.from_batches(out)


def text_features(docs: DataFrame, model: Model, keep: list[Column]) -> DataFrame:
    """The columns ``keep``, by place as ``c0``, ``c1`` ..., and _FEATURES of each row's text."""
    ship(docs.sparkSession)
    keys, chances, n = model.keys, model.chances(), len(keep)
    own = F.coalesce(F.col("text").cast("string"), F.lit(""))
    block = F.pmod(F.xxhash64("doc_id", own), F.lit(keys.blocks)).cast("int")
    names = [f"c{k}" for k in range(len(keep))]
    narrow = docs.select(*[c.alias(n) for c, n in zip(keep, names, strict=True)], own.alias("text"), block.alias("block"))
    to = lambda df, name, many: df.repartitionById(min(many, MOST_PARTITIONS), F.col(name))
    dealt = to(narrow.mapInArrow(lambda x: _deal(x, keys, n), _ROW), "block", keys.blocks)
    asked = dealt.sortWithinPartitions("block").mapInArrow(lambda x: _ask(x, keys), _ROW)
    table = lambda df, kind: df.select(F.lit(None).cast("int").alias("block"), F.lit(kind).alias("kind"), "part", "blob")
    tables = table(model.pairs, -1).unionByName(table(model.words, 0)).unionByName(asked)
    told = to(to(tables, "part", keys.parts).sortWithinPartitions("part", "kind").mapInArrow(_answer, _ROW), "block", keys.blocks)
    out = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema.fields[:n]] + [f"{x} double" for x in _FEATURES])
    return dealt.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(lambda a, b: _score(a, b, keys, chances), out)


def calibrate(seen: DataFrame, tests: DataFrame) -> np.ndarray:
    """Weights (constant first) of _FEATURES of texts of hash ``h``, from the labels of ``tests``, at most CALIBRATION_ROWS texts."""
    marks = durable(tests.groupBy("h", (F.col("toxic") > 0).alias("y")).agg(F.count("*").alias("n")), "toxic-tests")
    each = seen.join(F.broadcast(marks.select("h").distinct()), "h", "left_semi").groupBy("h").agg(*[F.first(x).alias(x) for x in _FEATURES])
    rows = each.join(F.broadcast(marks), "h").select("y", "n", *_FEATURES).toPandas()
    y = rows["y"].to_numpy().astype(float)
    if 0 < y.sum() < len(y):
        return fit_logistic(np.column_stack([np.ones(len(y)), rows[list(_FEATURES)]]), y, 1e-4, sample_weight=rows["n"].to_numpy().astype(float))
    return np.array([-8.0, 1.0, 0.5, 3.0])  # nothing to calibrate with: a word of about ten times the likelihood is the middle


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50, sample_weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the first column is the constant and isn't shrunk."""
    w = np.zeros(x.shape[1])
    s = np.ones(len(y)) if sample_weight is None else sample_weight
    penalty = np.full(x.shape[1], ridge * max(1.0, s.sum()))
    penalty[0] = 1e-6 * max(1.0, s.sum())
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (s * (p - y)) + penalty * w
        bend = (x * (s * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 5.0 / max(1e-12, float(np.abs(step).max())))
        if float(np.abs(step).max()) < 1e-7:
            break
    return w


def score_toxicity(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (score from 0.3) of every document.

    Learnt only from labelled rows of folds other than 2. Scores use texts
    alone. Null, empty and wordless texts score as a text with no evidence;
    labels without a value or a document are not used, and of several labels
    of an id the greatest counts, for every text of that id; repeated rows
    stay; an empty table gives an empty table; without toxic labels all scores
    are those of no evidence. Kept columns may have any name but those that
    are added. A text is worked on whole, in one task: about 60 bytes of
    memory a byte of the longest text.
    """
    size = lambda df: df.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0
    counted, tests = _labelled(docs, labels)
    model = count_model(counted, Keys.of(size(counted), size(docs)))
    own = F.coalesce(F.col("text").cast("string"), F.lit(""))
    made = text_features(docs, model, [*[F.col(c) for c in keep], fold_of(F.col("doc_id")) == 2, F.xxhash64(own)])
    n = len(keep)
    made = durable(made, "toxic-features").withColumnsRenamed({f"c{n}": "held", f"c{n + 1}": "h"})
    weights = calibrate(made.select("h", *_FEATURES), tests)
    z = F.lit(float(weights[0]))
    for w, x in zip(weights[1:], _FEATURES, strict=True):
        z = z + float(w) * F.col(x)
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
    return made.select(*[F.col(f"c{k}").alias(c.strip("`")) for k, c in enumerate(keep)], F.col("held").alias("held_out"), score.alias("score"), (score >= PREDICT_FROM).cast("int").alias("predicted"))
