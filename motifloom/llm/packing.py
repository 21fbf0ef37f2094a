"""Packing of token sequences into windows of several lengths.

Every document's ids (with the end id) are routed to context tiers: whole long
windows are cut first, and the rest goes to the shortest tier that holds it.
Each tier is packed best-fit, gaps of longer windows are filled with pieces of
shorter tiers, and windows of a tier are dealt to steps so that the attention
cost of steps is even. Blocks of a bounded number of tokens are packed apart,
in the task that reads them, so there is no shuffle and memory is bounded.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motifloom.llm.durable import giving_back, ship

#: Context lengths, longest first; powers of two.
TIERS = (2048, 1024, 512, 256)
#: Tokens that are packed together.
BLOCK_TOKENS = 1 << 20
#: Windows of a step.
STEP_WINDOWS = 16


@dataclass
class Piece:
    doc: int
    start: int
    length: int


@dataclass
class Window:
    size: int
    pieces: list[Piece] = field(default_factory=list)
    used: int = 0

    def put(self, piece: Piece) -> None:
        self.pieces.append(piece)
        self.used += piece.length

    def cost(self) -> int:
        return sum(p.length * p.length for p in self.pieces)


def _fill(window: Window, rest: list[tuple[int, int, Piece]], whole: bool) -> None:
    """Fill a window from ``rest`` (sorted by length): best fits first, then, if ``whole``, a cut of the longest."""
    while rest and window.used < window.size:
        gap = window.size - window.used
        at = _fits(rest, gap)
        if at:
            window.put(rest.pop(at - 1)[2])
        elif whole:
            length, order, piece = rest.pop()
            window.put(Piece(piece.doc, piece.start, gap))
            left = Piece(piece.doc, piece.start + gap, length - gap)
            bisect.insort(rest, (left.length, order, left), key=lambda x: x[:2])
        else:
            return


def _fits(rest: list[tuple[int, int, Piece]], gap: int) -> int:
    """How many of ``rest`` are no longer than ``gap``."""
    return bisect.bisect_right(rest, gap, key=lambda x: x[0])


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[Window]:
    """Windows that hold every token of documents of these lengths once.

    All windows but a block's last few are full: those last are of powers of
    two, so no window is padded.
    """
    longest = tiers[0]
    done: list[Window] = []
    routed: dict[int, list[tuple[int, int, Piece]]] = {t: [] for t in tiers}
    for doc, length in enumerate(lengths):
        whole = length // longest * longest
        for start in range(0, whole, longest):
            window = Window(longest)
            window.put(Piece(doc, start, longest))
            done.append(window)
        if length > whole:
            tier = min(t for t in tiers if t >= length - whole)
            routed[tier].append((length - whole, doc, Piece(doc, whole, length - whole)))
    for tier in tiers:
        routed[tier].sort(key=lambda x: x[:2])
    for k, tier in enumerate(tiers):
        sources = [routed[t] for t in tiers[k:]]
        left = sum(map(_total, sources))
        while routed[tier] and left >= tier:
            window = Window(tier)
            if _fits(routed[tier], tier) == len(routed[tier]):  # the longest first
                window.put(routed[tier].pop()[2])
            for source in sources:  # gaps: own pieces first, then those of shorter tiers
                _fill(window, source, whole=False)
            for source in sources:
                _fill(window, source, whole=True)
            done.append(window)
            left -= tier
        if k + 1 < len(tiers):  # too little for a full window: it goes to the next tier
            routed[tiers[k + 1]] = sorted(routed[tiers[k + 1]] + routed[tier], key=lambda x: x[:2])
    rest = routed[tiers[-1]]
    while rest:  # less than the shortest tier: windows of its binary digits
        window = Window(1 << (_total(rest).bit_length() - 1))
        _fill(window, rest, whole=True)
        done.append(window)
    return done


def _total(pieces: list[tuple[int, int, Piece]]) -> int:
    return sum(x[0] for x in pieces)


def deal_steps(windows: list[Window], size: int = STEP_WINDOWS) -> list[tuple[int, int]]:
    """(window length, step) of each window.

    Windows of one length are dealt to ceil(n / size) steps by falling
    attention cost, there and back, so steps cost about the same.
    """
    by_length: dict[int, list[int]] = {}
    for k, window in enumerate(windows):
        by_length.setdefault(window.size, []).append(k)
    out: list[tuple[int, int]] = [(0, 0)] * len(windows)
    for length, members in by_length.items():
        members.sort(key=lambda k: (-windows[k].cost(), k))
        steps = -(-len(members) // size)
        for place, k in enumerate(members):
            turn, step = divmod(place, steps)
            out[k] = (length, steps - 1 - step if turn % 2 else step)
    return out


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step long"


def pack_documents(docs: DataFrame, vocabulary: str, pattern: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, block_tokens: int = BLOCK_TOKENS, ids: bool = False) -> DataFrame:
    """Pack the texts of ``docs`` (``doc_id``, ``text``) into windows.

    A document is the ids of its text by the vocabulary file and then
    ``end_id``; null and empty texts are ``end_id`` alone. One row for each
    piece: ``start`` (its document's ids before it), ``length``,
    ``ids_crc32``, ``doc_tokens``, ``sequence_id``, ``offset`` in the sequence,
    ``tier`` (the sequence's length), ``step``, and with ``ids`` the ids
    themselves. A repeated row is packed again as a document of its own; a
    null ``doc_id`` stays null; an empty table gives none. Other columns are
    not read. Sequence and step numbers are those of the partition and, below,
    of the window or step in it, so that they need no count of the others'.
    """
    from motifloom.llm.tokens import encoder

    ship(docs.sparkSession)
    schema = _PIECES + (", ids array<int>" if ids else "")

    def close(doc_ids: list, tokens: list[np.ndarray], windows_before: int, steps_before: int) -> tuple[pa.RecordBatch, int, int]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 40
        windows = pack([len(t) for t in tokens], tiers)
        steps = deal_steps(windows)
        number = {key: k for k, key in enumerate(sorted(set(steps)))}
        rows: list[tuple] = []
        parts: list[np.ndarray] = []
        for k, window in enumerate(windows):
            offset = 0
            for p in window.pieces:
                part = tokens[p.doc][p.start : p.start + p.length]
                rows.append((doc_ids[p.doc], p.start, p.length, zlib.crc32(part.astype("<u4").tobytes()), len(tokens[p.doc]), base + windows_before + k, offset, window.size, base + steps_before + number[steps[k]]))
                parts.append(part)
                offset += p.length
        names = [x.split()[0] for x in _PIECES.split(", ")]
        types = [pa.int32() if n == "tier" else pa.int64() for n in names]
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        if ids:
            names.append("ids")
            columns.append(pa.array([p.astype(np.int32) for p in parts], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, names=names), windows_before + len(windows), steps_before + len(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode: Callable[[str], np.ndarray] = encoder(vocabulary, pattern)
        doc_ids: list = []
        tokens: list[np.ndarray] = []
        held = windows = steps = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                doc_ids.append(doc_id.as_py())
                tokens.append(np.append(encode(text.as_py() or ""), np.uint32(end_id)))
                held += len(tokens[-1])
                if held >= block_tokens:
                    out, windows, steps = close(doc_ids, tokens, windows, steps)
                    yield out
                    doc_ids, tokens, held = [], [], 0
        if tokens:
            yield close(doc_ids, tokens, windows, steps)[0]

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(giving_back(run), schema)
