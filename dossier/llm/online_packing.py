"""Bounded-space online packing.

Each task keeps at most `windows` open sequences, however many documents it reads. A document goes into the open sequence that it
fills best; if none has room for it, a new one is opened, and where all are taken the fullest one leaves: it is topped up
with the head of the document, so that it leaves without a gap, and the rest of the document is placed as before. What
is longer than a sequence is cut into full ones and a rest first.

What is open at the end of a task is merged: the fullest is topped up from the emptiest until one is left. These last
sequences of all tasks, of some KB each, are merged in the same way, `fan` of them in a group, round by round until one is
left. It is cut into lengths that are powers of two, which need no padding. So nothing is padded, and each sequence cuts one
document at most, apart from the last one.

Results of a pass are written to the shared folder before they are read again, so a lost executor can't make the parts of
a document differ.

Defined results: a null or empty text is one token, the closing id. Repeated rows and rows without an id are packed each by
itself. Very long texts are read whole. An empty table gives no rows. Other columns are ignored. sequence_id has the round,
task and running number.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialized, sliced, text_rows
from .packing import word_ids

RESULT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
MADE = f"{RESULT}, owner long, ids binary"
ARROW = pa.schema([(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "owner")] + [("ids", pa.binary())])

#: doc_id, place of its first id in the document, ids, ids of the document
Piece = tuple[int | None, int, np.ndarray, int]
Window = list[Piece]


def cut(piece: Piece, at: int) -> tuple[Piece, Piece]:
    doc, start, ids, total = piece
    return (doc, start, ids[:at], total), (doc, start + at, ids[at:], total)


def size(window: Window) -> int:
    return sum(len(p[2]) for p in window)


class OpenWindows:
    """At most `most` sequences that aren't full; those that leave are collected in `done`."""

    def __init__(self, capacity: int, most: int) -> None:
        self.capacity, self.most = capacity, most
        self.gaps: list[tuple[int, int]] = []  # room and number of each open sequence, rising
        self.held: dict[int, Window] = {}
        self.opened = 0
        self.done: list[Window] = []

    def put(self, piece: Piece) -> None:
        while (n := len(piece[2])) >= self.capacity:
            head, piece = cut(piece, self.capacity)
            self.done.append([head])
        if not n:
            return
        at = bisect_left(self.gaps, (n, -1))
        if at < len(self.gaps):
            self._add(at, piece)
        elif len(self.gaps) < self.most:
            self.held[self.opened] = [piece]
            insort(self.gaps, (self.capacity - n, self.opened))
            self.opened += 1
        else:
            head, rest = cut(piece, self.gaps[0][0])
            self._add(0, head)
            self.put(rest)

    def _add(self, at: int, piece: Piece) -> None:
        gap, number = self.gaps.pop(at)
        self.held[number].append(piece)
        if gap > len(piece[2]):
            insort(self.gaps, (gap - len(piece[2]), number))
        else:
            self.done.append(self.held.pop(number))


def merged(windows: list[Window], capacity: int) -> tuple[list[Window], Window]:
    """(full sequences, the rest of less than a full one): the fullest is topped up from the emptiest."""
    left, done = sorted((list(w) for w in windows if w), key=size), []
    while len(left) > 1:
        top, low = left[-1], left[0]
        gap = capacity - size(top)
        while gap and low:
            piece = low.pop()
            if len(piece[2]) > gap:
                piece, rest = cut(piece, gap)
                low.append(rest)
            top.append(piece)
            gap -= len(piece[2])
        if not gap:
            done.append(left.pop())
        if not low:
            left.pop(0)
    if left and size(left[0]) == capacity:
        done.append(left.pop())
    return done, left[0] if left else []


def powers(window: Window) -> list[Window]:
    """The pieces of one sequence in sequences of falling powers of two."""
    out, pieces, left = [], list(reversed(window)), size(window)
    while left:
        room = 1 << (left.bit_length() - 1)
        left -= room
        out.append([])
        while room:
            piece = pieces.pop()
            if len(piece[2]) > room:
                piece, rest = cut(piece, room)
                pieces.append(rest)
            out[-1].append(piece)
            room -= len(piece[2])
    return out


def told(windows: list[Window], first: int, owner: int) -> pa.RecordBatch:
    """The pieces of finished sequences, numbered from `first` on."""
    cols: list[list] = [[] for _ in range(7)]
    for k, window in enumerate(windows, first):
        offset = 0
        for doc, start, ids, total in window:
            for c, v in zip(cols, (doc, start, len(ids), zlib.crc32(np.ascontiguousarray(ids)), total, k, offset), strict=True):
                c.append(v)
            offset += len(ids)
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([owner] * len(cols[0]), pa.int64()), pa.nulls(len(cols[0]), pa.binary())], schema=ARROW)


def handed_on(window: Window, owner: int) -> pa.RecordBatch:
    """The pieces of a sequence that is still open, with their ids."""
    doc, start, ids, total = zip(*window, strict=True) if window else ((), (), (), ())
    own = {"doc_id": doc, "start": start, "length": [len(x) for x in ids], "doc_tokens": total, "offset": range(len(ids)), "owner": [owner] * len(ids), "ids": [x.tobytes() for x in ids]}
    return pa.RecordBatch.from_arrays([pa.array(own[f.name], f.type) if f.name in own else pa.nulls(len(ids), f.type) for f in ARROW], schema=ARROW)


def number(round_: int, owner: int) -> int:
    return round_ << 58 | owner << 32


def streamed(tokenizer_path: str, capacity: int, end_id: int, windows: int, max_words: int):
    """Arrow work: one task's documents through its open sequences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(tokenizer_path, max_words), np.array([end_id], "<u4")
        owner = TaskContext.get().partitionId()
        state, first = OpenWindows(capacity, windows), number(0, owner)
        for part in sliced(batches):
            texts = [x or "" for x in part.column("text").to_pylist()]
            for doc, ids in zip(part.column("doc_id").to_pylist(), words.encode_many(texts), strict=True):
                ids = np.concatenate([ids, end]).astype("<u4")
                state.put((doc, 0, ids, len(ids)))
            # what stays open must not keep the ids of whole documents
            state.held = {k: [(d, s, ids.copy(), n) if ids.base is not None else (d, s, ids, n) for d, s, ids, n in w] for k, w in state.held.items()}
            yield told(state.done, first, owner)
            first += len(state.done)
            state.done = []
        done, rest = merged(list(state.held.values()), capacity)
        yield told(done, first, owner)
        yield handed_on(rest, owner)

    return run


def merging(capacity: int, round_: int, fan: int, last: bool):
    """Arrow work: one group of sequences that tasks, or the groups of the round before, have handed on."""

    def run(rows: pa.Table) -> pa.Table:
        held: dict[int, Window] = {}
        rows = rows.sort_by([("owner", "ascending"), ("offset", "ascending")])
        for owner, doc, start, ids, total in zip(*(rows.column(c).to_pylist() for c in ("owner", "doc_id", "start", "ids", "doc_tokens")), strict=True):
            held.setdefault(owner, []).append((doc, start, np.frombuffer(ids, "<u4"), total))
        group = min(held) // fan
        done, rest = merged(list(held.values()), capacity)
        if last:
            done, rest = done + powers(rest), []
        return pa.Table.from_batches([told(done, number(round_, group), group), handed_on(rest, group)])

    return run


def pack_online(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, windows: int = 32, fan: int = 64, id_col: str = "doc_id", text_col: str = "text", max_words: int = 1_500_000) -> DataFrame:
    """Each piece of each document with its sequence and its place there. A round of merging has a row for each piece of the open
    sequences, so `fan` of them make a small group; the rounds grow with the logarithm of the number of tasks."""
    made = materialized(text_rows(docs, id_col, text_col).mapInArrow(streamed(tokenizer_path, capacity, end_id, windows, max_words), MADE), "online")
    done, round_ = [made], 0
    while True:
        open_ = made.where(F.col("sequence_id").isNull())
        most = open_.agg(F.max("owner")).first()[0]
        if most is None:
            break
        round_ += 1
        last = most < fan
        made = materialized(open_.groupBy(F.floor(F.col("owner") / fan)).applyInArrow(merging(capacity, round_, fan, last), MADE), "online")
        done.append(made)
    out = done[0]
    for df in done[1:]:
        out = out.union(df)
    return out.where(F.col("sequence_id").isNotNull()).drop("owner", "ids")
