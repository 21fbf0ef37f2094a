"""Quality by co-training a text-content and a page-metadata classifier.

The content view sees letters alone: the words of a text, their shapes and how
they repeat. The metadata view sees the columns beside the text, the page's size
and lines, and its marks, that is every byte that isn't a letter. Each starts from
labelled documents; over some rounds each looks through all unlabelled documents,
and those that it is surest of, with the label it gives them, join what the other
learns from, unless that says the opposite. Each view is calibrated on labelled documents kept apart; their
log-odds add up, less the prior that both have counted, and are calibrated again.

Both views of every document are worked out once and kept as half-precision
numbers; rounds go through that table, in all its partitions. Fitting alone is
bounded: to ``LABELLED_ROWS`` labelled documents, and in each round to
``PSEUDO_ROWS`` of the confident ones, by hashes of their ids and texts. It is
one task's work, of which the driver gets some hundred weights. Every document is
scored, in its own task, by these.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from motifloom.llm.durable import columns, durable, fresh, giving_back, ship
from motifloom.llm.textkit import Words, chunks, text_buffer
from motifloom.llm.toxicity import fit_logistic

#: Documents, at most, that a fit takes: labelled ones, and of each round's confident ones.
LABELLED_ROWS, PSEUDO_ROWS = 12_000, 12_000
#: Labelled rows up to which their ids are sent to every executor; more are joined by a shuffle.
BROADCAST_LABELS = 2_000_000
ROUNDS = 3
#: Share of the unlabelled documents that each view labels for the other, a round; of those it is sure of, by log-odds.
CONFIDENT, SURE = 0.1, 2.0
#: What the documents that a view got from the other weigh together, at most: as much as so many labelled ones.
PSEUDO_WEIGHT = 200
#: Documents with a lower score are rejected.
ACCEPT_FROM = 0.2

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
#: Letters of either case, and all bytes of other alphabets as one more; marks by kinds, rare ones together.
_ALPHABET = np.full(256, 27, np.uint8)
_ALPHABET[97:123] = _ALPHABET[65:91] = np.arange(26)
_ALPHABET[128:] = 26
_MARK = np.full(256, 11, np.uint8)
for _kind, _chars in enumerate((b" ", b"\n\r", b"0123456789", b".", b",;:", b"!?", b"|\t", b"#", b"$%&", b"*_=~^`", b"'\"()[]{}<>")):
    _MARK[np.frombuffer(_chars, np.uint8)] = _kind
_MARK[_LETTER] = 12
_BUCKETS, _LENGTHS, _SOURCES, _LANGS, _MARKS = 64, 12, 32, 8, 12
CONTENT = _BUCKETS + _LENGTHS + 27 + 5
METADATA = _SOURCES + _LANGS + _MARKS + 7


def _hashed(values: list, buckets: int) -> np.ndarray:
    import zlib

    out = np.zeros((len(values), buckets), np.float32)
    for k, v in enumerate(values):
        out[k, zlib.crc32(("\0" if v is None else str(v)).encode("utf-8", "replace")) % buckets] = 1
    return out


def _counts(owner: np.ndarray, kind: np.ndarray, rows: int, kinds: int) -> np.ndarray:
    return np.bincount(owner * kinds + kind, minlength=rows * kinds).reshape(rows, kinds).astype(np.float32)


def _of(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return (part / np.maximum(whole, 1)).astype(np.float32)


def views(raw: np.ndarray, at: np.ndarray, first: int, last: int, source: list, lang: list, n_chars: list) -> tuple[np.ndarray, np.ndarray]:
    """Content and metadata features of the texts ``first..last`` of a buffer, one row each."""
    n = last - first
    bounds = at[first : last + 1] - at[first]
    size = np.diff(bounds)
    piece = raw[int(at[first]) : int(at[last])]
    owner = np.repeat(np.arange(n), size)

    words = Words(raw, at, first, last, _FOLD, ~_LETTER)
    row, many = words.row, words.per_row()
    length = words.end - words.start
    capital = np.concatenate(([0], np.cumsum(_UPPER[piece])))
    start, end = words.start - int(at[first]), words.end - int(at[first])
    upper = capital[end] - capital[start] if len(row) else row
    initial = _UPPER[piece[start]] if len(row) else row
    order = np.lexsort((words.hash, row))
    again = np.zeros(len(row), bool)
    again[1:] = (words.hash[order][1:] == words.hash[order][:-1]) & (row[order][1:] == row[order][:-1])
    twice = np.zeros(len(row), bool)
    twice[1:] = (words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1])
    total = lambda x, o=row: np.bincount(o, weights=x, minlength=n) if len(o) else np.zeros(n)
    letters = _counts(owner, _ALPHABET[piece], n, 28)[:, :27]
    content = np.concatenate([
        np.sqrt(_of(_counts(row, (words.hash >> np.uint64(58)).astype(np.int64), n, _BUCKETS), many[:, None])),
        np.sqrt(_of(_counts(row, np.minimum(length, _LENGTHS) - 1, n, _LENGTHS), many[:, None])),
        np.sqrt(_of(letters, letters.sum(axis=1)[:, None])),
        np.stack([_of(total(again[np.argsort(order)]), many), _of(total(twice), many), _of(total((upper == length) & (length > 1)), many), _of(total(initial), many), _of(total(upper), letters.sum(axis=1))], axis=1),
    ], axis=1)

    kind = _MARK[piece]
    marks = _counts(owner, kind, n, _MARKS + 1)[:, :_MARKS]
    lines = marks[:, 1] + 1
    repeated = np.zeros(len(piece), bool)
    repeated[1:] = (piece[1:] == piece[:-1]) & (kind[1:] > 1) & (kind[1:] < _MARKS) & (owner[1:] == owner[:-1])
    blank = np.zeros(len(piece), bool)
    blank[1:] = (kind[1:] == 1) & (kind[:-1] == 1) & (owner[1:] == owner[:-1])
    told = np.array([-1 if c is None else max(c, 0) for c in n_chars], float)
    page = [np.log1p(np.maximum(told, 0)) / 10, told < 0, np.log1p(size) / 10, np.log1p(lines) / 5, np.log1p(size / lines) / 10, total(blank, owner) / lines, _of(total(repeated, owner), marks[:, 2:].sum(axis=1))]
    return content.astype(np.float32), np.concatenate([_hashed(source, _SOURCES), _hashed(lang, _LANGS), np.sqrt(_of(marks, size[:, None])), np.stack(page, axis=1)], axis=1).astype(np.float32)


@dataclass
class Model:
    """Weights of both views (constant first), the constants and slopes that calibrate each view and their sum, and the prior's log-odds."""

    content: np.ndarray
    metadata: np.ndarray
    curves: np.ndarray  # 3 x 2: content, metadata, both
    prior: float

    def odds(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated log-odds of both together, of the content and of the metadata view."""
        a, b = (c[0] + c[1] * _odds(w, x) for c, w, x in zip(self.curves, (self.content, self.metadata), (content, metadata), strict=False))
        return self.curves[2][0] + self.curves[2][1] * (a + b - self.prior), a, b

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return tuple(1 / (1 + np.exp(-np.clip(x, -30, 30))) for x in self.odds(content, metadata))

    def flat(self) -> list[float]:
        return [*self.content.tolist(), *self.metadata.tolist(), *self.curves.ravel().tolist(), self.prior]

    @staticmethod
    def of(flat: list[float], content: int = CONTENT, metadata: int = METADATA) -> Model:
        x = np.array(flat)
        a, b = 1 + content, 2 + content + metadata
        return Model(x[:a], x[a:b], x[b : b + 6].reshape(3, 2), float(x[b + 6]))


def _odds(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(weights[0] + x @ weights[1:], -12, 12)


def _fit(x: np.ndarray, y: np.ndarray, pseudo: np.ndarray) -> np.ndarray:
    """A view's classifier; both labels weigh the same, and ``pseudo`` rows together no more than PSEUDO_WEIGHT others."""
    own = np.where(pseudo, min(1.0, PSEUDO_WEIGHT / max(1, pseudo.sum())), 1.0)
    share = min(max(np.average(y, weights=own), 1e-3), 1 - 1e-3)
    weight = own * np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    return fit_logistic(np.column_stack([np.ones(len(y)), x]).astype(float), y, 1e-5, 30, weight)


def _curve(odds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Constant and slope of log-odds that fit labels; the slope is positive."""
    w = fit_logistic(np.column_stack([np.ones(len(y)), odds]), y, 1e-3)
    return np.array([w[0], max(w[1], 0.1)])


def fit_views(content: np.ndarray, metadata: np.ndarray, of_content: np.ndarray, of_metadata: np.ndarray, kept: np.ndarray, pseudo: np.ndarray) -> Model:
    """Both views from the labels that each learns from (``pseudo``: rows that views have labelled), calibrated on the labels ``kept`` apart; nan is no label."""
    sides = [(content, of_content), (metadata, of_metadata)]
    known = np.concatenate([of_content[~np.isnan(of_content)], kept[~np.isnan(kept)]])
    mean = float(np.clip(known.mean(), 0.01, 0.99)) if len(known) else 0.99
    prior = float(np.log(mean / (1 - mean)))
    if any(len(np.unique(y[~np.isnan(y)])) < 2 for y in (of_content, of_metadata, kept)):  # nothing to tell apart: everything scores the labels' mean
        return Model(np.zeros(1 + content.shape[1]), np.zeros(1 + metadata.shape[1]), np.array([[prior, 0.0], [prior, 0.0], [0.0, 1.0]]), prior)
    weights = [_fit(x[~np.isnan(y)], y[~np.isnan(y)], pseudo[~np.isnan(y)]) for x, y in sides]
    test = ~np.isnan(kept)
    y = kept[test]
    prior = float(np.log(y.sum() / (len(y) - y.sum())))
    raw = [_odds(w, x[test]) for w, (x, _) in zip(weights, sides, strict=True)]
    curves = [_curve(o, y) for o in raw]
    both = sum(c[0] + c[1] * o for c, o in zip(curves, raw, strict=True)) - prior
    return Model(*weights, np.stack([*curves, _curve(both, y)]), prior)


_WIDTH = 0.1
_BINS = 241


def _bin(odds: np.ndarray) -> np.ndarray:
    return np.rint(odds / _WIDTH).astype(np.int64) + _BINS // 2


def cuts(counts: np.ndarray, many: float, share: float) -> tuple[int, int]:
    """Bins of log-odds up to which, and from which, a view labels documents: about ``many``, of which ``share`` positive, none that it isn't sure of."""
    reach = np.cumsum(counts)
    low = max(int(np.searchsorted(reach, many * (1 - share), side="right")) - 1, int(np.flatnonzero(counts)[0]) if reach[-1] else 0)
    back = np.cumsum(counts[::-1])
    high = _BINS - 1 - max(int(np.searchsorted(back, many * share, side="right")) - 1, int(np.flatnonzero(counts[::-1])[0]) if reach[-1] else 0)
    sure = round(SURE / _WIDTH)
    return min(low, _BINS // 2 - sure), max(high, _BINS // 2 + sure)


def pseudo_labels(odds: list[np.ndarray], cut: list[tuple[int, int]]) -> list[np.ndarray]:
    """What each view labels for the other: where it is sure enough, and the other doesn't say the opposite."""
    out = []
    for own, other, (low, high) in zip(odds, odds[::-1], cut, strict=True):
        at = _bin(own)
        out.append(np.where((at <= low) & (other <= 0), 0.0, np.where((at >= high) & (other >= 0), 1.0, np.nan)))
    return out


def co_train(content: np.ndarray, metadata: np.ndarray, label: np.ndarray, rounds: int = ROUNDS, confident: float = CONFIDENT) -> Model:
    """``train`` over arrays; ``label``: 1, 0, or nan for unlabelled rows. A fourth of the labelled rows calibrates."""
    known = np.flatnonzero(~np.isnan(label))
    kept, learnt = np.full(len(label), np.nan), label.copy()
    kept[known[::4]], learnt[known[::4]] = label[known[::4]], np.nan
    pool = np.isnan(label)
    model = fit_views(content, metadata, learnt, learnt, kept, pool)
    for k in range(rounds):
        if not pool.any() or not model.content.any():
            break
        odds = [_odds(w, x) for w, x in ((model.content, content), (model.metadata, metadata))]
        many, share = confident * (k + 1) * pool.sum(), float(np.nanmean(learnt))
        told = pseudo_labels(odds, [cuts(np.bincount(_bin(o[pool]), minlength=_BINS), many, share) for o in odds])
        told = [np.where(pool, x, learnt) for x in told]
        model = fit_views(content, metadata, told[1], told[0], kept, pool)
    return model


# --- over tables -----------------------------------------------------------


def _view_rows(docs: DataFrame, keep: list[str], finish, extra: str) -> DataFrame:
    """The columns ``keep`` and what ``finish(content, metadata)`` gives for them as Arrow arrays, declared by ``extra``."""
    ship(docs.sparkSession)
    kinds = {"text": "string", "source": "string", "lang": "string", "n_chars": "long"}
    side = [(F.col(c) if c in docs.columns else F.lit(None)).cast(kind).alias(f"__{c}") for c, kind in kinds.items()]
    narrow = docs.select(*keep, *side)
    names = [*narrow.columns[: len(keep)], *T.StructType.fromDDL(extra).names]
    # Columns go through Python by place, so that any name will do.
    narrow = narrow.toDF(*[f"c{k}" for k in range(len(narrow.columns))])
    out = T.StructType([*narrow.schema.fields[: len(keep)], *T.StructType.fromDDL(extra).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(keep)
        for batch in batches:
            raw, at = text_buffer(batch.column(k))
            side = [batch.column(k + j).to_pylist() for j in (1, 2, 3)]
            for first, last in chunks(at):
                made = finish(*views(raw, at, first, last, *[x[first:last] for x in side]))
                yield pa.RecordBatch.from_arrays([c.slice(first, last - first) for c in batch.columns[:k]] + made, names=out.names)

    return narrow.mapInArrow(giving_back(run), out).toDF(*names)


def _packed(content: np.ndarray, metadata: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in np.concatenate([content, metadata], axis=1).astype("<f2")], pa.binary())


def _unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(column.to_pylist()), "<f2").reshape(len(column), CONTENT + METADATA).astype(np.float32)
    return x[:, :CONTENT], x[:, CONTENT:]


def _tally(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """How many rows have which log-odds: (view, bin, n)."""
    counts = np.zeros((2, _BINS), np.int64)
    for batch in batches:
        for k, (w, x) in enumerate(zip((model.content, model.metadata), _unpacked(batch.column(0)), strict=True)):
            counts[k] += np.bincount(_bin(_odds(w, x)), minlength=_BINS)
    view, at = np.nonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(view.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[view, at])], names=["view", "bin", "n"])


_SAMPLE = "h long, x binary, of_content double, of_metadata double, kept double, pseudo boolean"


def _confident(batches: Iterator[pa.RecordBatch], model: Model, cut: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    """Rows (h, x) that a view is sure of, with the label it gives them for the other."""
    for batch in batches:
        told = pseudo_labels([_odds(w, x) for w, x in zip((model.content, model.metadata), _unpacked(batch.column(1)), strict=True)], cut)
        some = pa.array(~(np.isnan(told[0]) & np.isnan(told[1])))
        made = [batch.column(0), batch.column(1), pa.array(told[1]), pa.array(told[0]), pa.array(np.full(batch.num_rows, np.nan)), pa.array(np.ones(batch.num_rows, bool))]
        yield pa.RecordBatch.from_arrays(made, names=["h", "x", "of_content", "of_metadata", "kept", "pseudo"]).filter(some)


def _fit_sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The model's numbers, from the rows of a bounded sample."""
    rows = [b for b in batches if b.num_rows]
    parts = [_unpacked(b.column("x")) for b in rows] or [(np.zeros((0, CONTENT), np.float32), np.zeros((0, METADATA), np.float32))]
    labels = [np.concatenate([np.zeros(0), *[b.column(c).to_numpy(zero_copy_only=False) for b in rows]]) for c in ("of_content", "of_metadata", "kept", "pseudo")]
    labels[3] = labels[3].astype(bool)
    model = fit_views(*(np.concatenate(x) for x in zip(*parts, strict=True)), *labels)
    yield pa.RecordBatch.from_arrays([pa.array([model.flat()], pa.list_(pa.float64()))], names=["flat"])


def _sampled(rows: DataFrame, many: int, of: int) -> DataFrame:
    """About ``of`` rows thinned to at most ``many`` with different ``h``, by it; equal rows, however many, are one."""
    share = min(1.0, 2.0 * many / max(1, of))
    order = F.xxhash64("h", F.lit(5))
    thin = rows if share >= 1 else rows.where(order < int((share - 0.5) * 2**64))
    return thin.groupBy("h").agg(*[F.first(c).alias(c) for c in ("x", "of_content", "of_metadata", "kept", "pseudo")]).orderBy(order, "h").limit(many)


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS) -> Model:
    """Co-train over all documents; see the module's text."""
    known = durable(labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("__id")).agg(F.min("quality").alias("__quality")), "quality-labels")
    side = F.broadcast(known) if known.count() <= BROADCAST_LABELS else known
    have = [c for c in ("text", "source", "lang", "n_chars") if c in docs.columns]
    own = docs.select(F.col("doc_id").cast("long").alias("__id"), *have)
    told = own.join(side, "__id", "left").select(F.xxhash64("__id", F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("__h"), (F.col("__quality") > 0).cast("double").alias("__quality"), *have)
    rows = durable(_view_rows(told, ["__h", "__quality"], lambda a, b: [_packed(a, b)], "x binary").toDF("h", "quality", "x"), "quality-views")
    n, n_known = rows.agg(F.count("*"), F.count("quality")).first()
    none = F.lit(float("nan"))
    kept = F.pmod(F.xxhash64("h", F.lit(7)), F.lit(4)) == 0
    learnt = F.when(kept, none).otherwise(F.col("quality"))
    labelled = rows.where("quality is not null").select("h", "x", learnt.alias("of_content"), learnt.alias("of_metadata"), F.when(kept, F.col("quality")).otherwise(none).alias("kept"), F.lit(False).alias("pseudo"))
    labelled = durable(_sampled(labelled, LABELLED_ROWS, n_known), "quality-labelled")
    fitted = lambda sample: Model.of(sample.repartition(1).mapInArrow(giving_back(_fit_sample), "flat array<double>").first()["flat"])
    model = fitted(labelled)
    share = labelled.agg(F.avg(F.nanvl("of_content", F.lit(None).cast("double")))).first()[0] or 0.5
    pool = rows.where("quality is null")
    for k in range(rounds if n > n_known and model.content.any() else 0):
        counts = np.zeros((2, _BINS), np.int64)
        for r in pool.select("x").mapInArrow(giving_back(lambda x, m=model: _tally(x, m)), "view int, bin int, n long").groupBy("view", "bin").agg(F.sum("n").alias("n")).collect():  # at most 482 rows
            counts[r["view"], r["bin"]] = r["n"]
        cut = [cuts(c, CONFIDENT * (k + 1) * (n - n_known), share) for c in counts]
        sure = int(sum(c[: low + 1].sum() + c[high:].sum() for c, (low, high) in zip(counts, cut, strict=True)))
        found = pool.select("h", "x").mapInArrow(giving_back(lambda x, m=model, c=cut: _confident(x, m, c)), _SAMPLE)
        model = fitted(labelled.unionByName(_sampled(found, PSEUDO_ROWS, sure)))
    return model


def score_quality(docs: DataFrame, labels: DataFrame, keep: list[str], rounds: int = ROUNDS) -> DataFrame:
    """The columns ``keep``, ``quality_score``, ``content_score``, ``metadata_score`` and ``accepted`` (score from 0.2) of every document.

    Null and empty texts have no content features and are scored by the rest;
    null or missing ``source``, ``lang`` and ``n_chars`` are values of their
    own; of several labels of an id the least counts, for every text of that
    id; repeated rows stay, and are one where models are fitted; an empty
    table gives an empty table. With labels of one kind only, or none, all
    documents score that kind's share (none: 0.99), so nothing is rejected
    without evidence.
    """
    model = train(docs, labels, rounds)
    scored = _view_rows(docs, keep, lambda a, b: [pa.array(x) for x in model.scores(a, b)], "quality_score double, content_score double, metadata_score double")
    return scored.withColumn("accepted", (F.col("quality_score") >= ACCEPT_FROM).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with all their columns."""
    model = train(docs, labels)
    (score,) = fresh(docs, "quality_score")
    scored = _view_rows(docs, columns(docs), lambda a, b: [pa.array(model.scores(a, b)[0])], f"`{score}` double")
    return scored.where(F.col(score) >= ACCEPT_FROM).select(*columns(docs))
