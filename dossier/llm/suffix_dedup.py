"""Removal of long byte strings that occur twice, by enhanced suffix arrays over the places where that can be.

A string of `least` bytes has an anchor: the place in it whose 32-byte sequence has the smallest hash. Equal strings
have equal anchors at equal distances, so they meet when anchors meet. A chunk of documents sends the hashes of its
anchors; those that occur twice in the corpus come back, and for them the chunk sends the bytes around the anchor, each
different context once. All contexts of an anchor form a sparse enhanced suffix array: the stack scan of its
common-prefix interval tree gives the groups that share bytes to the right, and the diversity of left extensions tells
which parts of a group share how many bytes to the left. Each part that has `least` bytes and that neither side can
extend is a maximal repeat, with all its members. `suffix_dedup` removes what the repeats cover; `repeat_groups` returns
them, those that adjoining anchors tell of the same occurrences as one.

An anchor with more than `hot` different contexts is not gathered in one task: its contexts are split into their windows,
which meet by two independent hashes (96 bits), each sent once by a chunk. A window that occurs twice is a repeat of
`least` bytes with all its occurrences. The removed bytes are the same either way, and so are groups of adjoining windows
with the same occurrences.

Defined results: a null text is empty; texts shorter than `least` keep all bytes. Copies and repeated rows cover each
other. Very long texts are cut into overlapping segments and joined again. Other columns are ignored; null ids are
carried through. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialized, text_rows
from .esa import SuffixArray, common_prefix
from .exchange import MB, by_bucket, chunk_plan, chunked, gather, member, mixed, pack, pack_sorted, parts, scatter, unpack, unpack_sorted, unparts

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, end: long>>, kept_text string"
GRAM = 32
PLACE = np.uint64((1 << 28) - 1)


class Anchored:
    """A chunk's bytes in one buffer, and the runs of windows that have the same anchor."""

    def __init__(self, texts: pa.Table, least: int, segment: int = 64 << 10, block: int = 64 << 10) -> None:
        self.least = least
        self.ids = texts.column("doc_id").to_pylist()
        self.rows = texts.column("row").to_pylist() if "row" in texts.column_names else []
        self.raw = [t or b"" for t in texts.column("text").cast(pa.binary()).to_pylist()]
        #: (text, offset in it, start in the buffer, bytes)
        self.segments: list[tuple[int, int, int, int]] = []
        held, at = [], 0
        for t, raw in enumerate(self.raw):
            for off in range(0, len(raw) - least + 1, segment):
                own = raw[off : off + segment + least - 1]
                held.append(own)
                self.segments.append((t, off, at, len(own)))
                at += len(own)
        self.buffer = b"".join(held)
        self._runs(block)

    def grams(self, size: int, seed: int, at: int = 0, end: int | None = None) -> np.ndarray:
        """A hash of the `size` (any sum of powers of two) bytes from each byte of a part of the buffer on."""
        factors = mixed(np.arange(seed * 64 + 1, seed * 64 + 33, dtype=np.uint64)) | np.uint64(1)
        own = mixed(np.arange(256, dtype=np.uint64) + np.uint64(1000 + seed * 256))[np.frombuffer(self.buffer, np.uint8)[at:end]]
        out, have, width, k = None, 0, 1, 0
        with np.errstate(over="ignore"):
            while True:
                if size & width:
                    if out is None:
                        out = own.copy()
                    else:
                        n = len(own) - have
                        out = out[: max(n, 0)] * factors[31 - k] + own[have:]
                    have += width
                if have == size:
                    return mixed(out)
                own = own[:-width] * factors[k] + own[width:] if len(own) > width else own[:0]
                width *= 2
                k += 1

    def _runs(self, block: int) -> None:
        """Runs of all windows; the buffer in blocks of whole segments, which fit the processor's caches, and whose places fit PLACE."""
        done, first = [], 0
        for k, (_, _, at, size) in enumerate(self.segments):
            last = k + 1 == len(self.segments)
            if last or at + size + self.segments[k + 1][3] - self.segments[first][2] > block:
                done.append(self._runs_of(self.segments[first : k + 1]))
                first = k + 1
        kinds = (np.int64, np.int64, np.int64, np.uint64)
        self.lo, self.hi, self.at, self.key = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, t) for t in kinds)

    def _runs_of(self, segments: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, ...]:
        begin, end = segments[0][2], segments[-1][2] + segments[-1][3]
        hashes = self.grams(GRAM, 1, begin, end)
        least = (hashes & ~PLACE) | np.arange(len(hashes), dtype=np.uint64)
        wide, width = self.least - GRAM + 1, 1
        while 2 * width <= wide:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < wide:
            least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
        place = (least & PLACE).astype(np.int64)
        starts = np.concatenate([np.arange(at, at + size - self.least + 1) for _, _, at, size in segments])
        place = place[starts - begin]
        new = np.flatnonzero(np.diff(place)) + 1
        own = place[np.concatenate([[0], new])]
        return starts[np.concatenate([[0], new])], starts[np.concatenate([new - 1, [len(starts) - 1]])], own + begin, mixed(hashes[own] + np.uint64(1))

    def context(self, run: int) -> tuple[bytes, bytes]:
        """The bytes right of the anchor's start, and those left of it, reversed."""
        lo, hi, at = int(self.lo[run]), int(self.hi[run]), int(self.at[run])
        return self.buffer[at : hi + self.least], self.buffer[lo:at][::-1]

    def contexts(self, runs: np.ndarray) -> list[tuple[int, tuple[bytes, bytes], list[int]]]:
        """(key, context, its runs) for each different one, in an order that rests on the bytes alone."""
        held: dict[tuple, list[int]] = defaultdict(list)
        for run, key in zip(runs.tolist(), self.key[runs].tolist(), strict=True):
            held[(key, self.context(run))].append(run)
        return [(key, context, own) for (key, context), own in sorted(held.items())]

    def repeated_keys(self) -> np.ndarray:
        keys = np.sort(self.key)
        return np.unique(keys[1:][keys[1:] == keys[:-1]])

    def windows(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and both hashes of all windows of some runs."""
        lens = self.hi[runs] - self.lo[runs] + 1
        starts = np.arange(lens.sum()) + np.repeat(self.lo[runs] - np.cumsum(lens) + lens, lens)
        return starts, self.grams(self.least, 2)[starts], self.grams(self.least, 3)[starts] >> np.uint64(32)


Context = tuple[bytes, bytes]


def group_repeats(contexts: list[Context], several: list[bool], least: int) -> Iterator[tuple[list[int], int, int]]:
    """(members, bytes to the left, bytes to the right) of every maximal repeat of one anchor's different contexts; a context
    that occurs several times is a repeat by itself."""
    if len(contexts) > 1:
        array = SuffixArray([c[0] for c in contexts], [c[1] for c in contexts])
        for left, right, members in array.maximal_repeats(least):
            yield members, left, right
    for k, (right, left) in enumerate(contexts):
        if several[k]:
            yield [k], len(left), len(right)


def reaches(contexts: list[Context], several: list[bool], least: int) -> dict[int, tuple[int, int]]:
    """How far the repeats that each context takes part in reach to the left and right of the anchor."""
    out: dict[int, tuple[int, int]] = {}
    for members, left, right in group_repeats(contexts, several, least):
        for k in members:
            a, b = out.get(k, (0, 0))
            out[k] = (max(a, left), max(b, right))
    return out


def in_pairs(first: np.ndarray, second: np.ndarray, of_first: np.ndarray, of_second: np.ndarray) -> np.ndarray:
    """Which (first, second) are among the pairs (of_first, of_second)."""
    out = member(first, np.unique(of_first))
    here = np.flatnonzero(out)
    if len(here):
        kind = np.dtype([("a", "<u8"), ("b", "<u8")])
        mine, theirs = np.empty(len(here), kind), np.empty(len(of_first), kind)
        mine["a"], mine["b"], theirs["a"], theirs["b"] = first[here], second[here], of_first, of_second
        out[here] = np.isin(mine, theirs)
    return out


def repeated_anchors(hot: int):
    """Bucket work: the anchors that several chunks have, and whether they have more than `hot` different contexts. If the
    chunks sent hashes of contexts, one that several chunks have counts once, else once for each chunk."""

    def work(chunk_ids: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
        sent = [unparts(p) for p in payloads]
        held = [(unpack_sorted(p[0]), unpack(p[1])) for p in sent]
        keys, counts = np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held])
        every, back, times = np.unique(keys, return_inverse=True, return_counts=True)
        total = np.bincount(back, counts)
        if len(sent[0]) > 2:
            hashes = np.concatenate([np.frombuffer(p[2], "<u8") for p in sent])
            total = np.bincount(np.searchsorted(every, unique_pairs(np.repeat(keys, counts), hashes)[0]), minlength=len(every))
        shared, total = every[times > 1], total[times > 1]
        if len(shared):
            for chunk, (own, _) in zip(chunk_ids, held, strict=True):
                found = own[member(own, shared)]
                if len(found):
                    yield chunk, parts(pack_sorted(found), (total[np.searchsorted(shared, found)] > hot).astype(np.uint8).tobytes())

    return work


def answered_anchors(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(anchors to be gathered, hot anchors), both rising."""
    held = [(unpack_sorted(a), np.frombuffer(b, np.uint8) > 0) for a, b in map(unparts, payloads)]
    if not held:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    keys, hot = np.concatenate([k for k, _ in held]), np.concatenate([h for _, h in held])
    return np.sort(keys[~hot]), np.sort(keys[hot])


def received(chunk_ids: list[int], payloads: list[bytes]) -> Iterator[dict[Context, list[tuple[int, int]]]]:
    """For each anchor of a bucket its different contexts, and the (chunk, number) of each."""
    import zstandard

    open_ = zstandard.ZstdDecompressor().decompress
    groups: dict[int, dict[Context, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for chunk, payload in zip(chunk_ids, payloads, strict=True):
        if payload[:1] == b"c":
            keys, rank, right, left, blob = unparts(payload[1:])
            blob, at = open_(blob), 0
            for key, r, n, m in zip(unpack_sorted(keys).tolist(), unpack(rank).tolist(), unpack(right).tolist(), unpack(left).tolist(), strict=True):
                groups[key][blob[at : at + n], blob[at + n : at + n + m]].append((chunk, r))
                at += n + m
    yield from groups.values()


def repeated_windows(chunk_ids: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """For each chunk the windows of hot anchors that another chunk has, too."""
    hot = [(c, *unparts(p[1:])) for c, p in zip(chunk_ids, payloads, strict=True) if p[:1] == b"h"]
    if hot:
        held = [(unpack_sorted(a), np.frombuffer(b, "<u4").astype(np.uint64)) for _, a, b in hot]
        first, second = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        order = np.lexsort((second, first))
        same = (first[order][1:] == first[order][:-1]) & (second[order][1:] == second[order][:-1])
        several = np.zeros(len(first), bool)
        several[order[1:][same]] = several[order[:-1][same]] = True
        ends = np.cumsum([len(h[0]) for h in held]).tolist()
        for (chunk, *_), i, j in zip(hot, [0, *ends[:-1]], ends, strict=True):
            if several[i:j].any():
                yield chunk, b"h" + parts(pack_sorted(first[i:j][several[i:j]]), second[i:j][several[i:j]].astype("<u4").tobytes())


def gathered(least: int):
    """Bucket work: interval trees of all contexts of an anchor; each chunk gets how far repeats reach in its contexts."""

    def work(chunk_ids: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
        answers: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
        for different in received(chunk_ids, payloads):
            places = list(different.values())
            for k, (left, right) in reaches(list(different), [len(p) > 1 for p in places], least).items():
                for chunk, r in places[k]:
                    answers[chunk].append((r, left, right))
        for chunk, found in answers.items():
            yield chunk, b"c" + parts(*map(pack, np.array(found, np.int64).T))
        yield from repeated_windows(chunk_ids, payloads)

    return work


def unique_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, rising, and how often it occurs."""
    order = np.lexsort((second, first))
    a, b = first[order], second[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new], np.diff(np.append(np.flatnonzero(new), len(a)))


def sent_anchors(chunk: Anchored, n_buckets: int) -> list[tuple[int, bytes]]:
    keys = np.unique(chunk.key)
    counts = np.ones(len(keys), np.int64)
    repeated = chunk.repeated_keys()
    if len(repeated):
        for key, *_ in (found := chunk.contexts(np.flatnonzero(member(chunk.key, repeated)))):
            counts[np.searchsorted(keys, np.uint64(key))] += 1
        counts[member(keys, repeated)] -= 1
        del found
    return [(b, parts(pack_sorted(keys[i:j]), pack(counts[i:j]))) for b, i, j in by_bucket(keys, n_buckets)]


def sent_anchors_and_contexts(chunk: Anchored, n_buckets: int) -> list[tuple[int, bytes]]:
    """As sent_anchors, with a hash of each different context."""
    found = chunk.contexts(np.arange(len(chunk.key)))
    keys, first, counts = np.unique(np.array([f[0] for f in found], np.uint64), return_index=True, return_counts=True)
    hashes = np.array([named(*f[1]) for f in found], "<u8")
    first = np.append(first, len(found))
    return [(b, parts(pack_sorted(keys[i:j]), pack(counts[i:j]), hashes[first[i] : first[j]].tobytes())) for b, i, j in by_bucket(keys, n_buckets)]


def sent_contexts(chunk: Anchored, answers: list[bytes], n_buckets: int) -> list[tuple[int, bytes]]:
    import zstandard

    press = zstandard.ZstdCompressor(level=3).compress
    shared, hot = answered_anchors(answers)
    out = []
    found = chunk.contexts(np.flatnonzero(member(chunk.key, shared)))
    keys = np.array([f[0] for f in found], np.uint64)
    for b, i, j in by_bucket(keys, n_buckets):
        own = [f[1] for f in found[i:j]]
        right, left = np.array([len(c[0]) for c in own]), np.array([len(c[1]) for c in own])
        blob = press(b"".join(x for c in own for x in c))
        out.append((b, b"c" + parts(pack_sorted(keys[i:j]), pack(np.arange(i, j)), pack(right), pack(left), blob)))
    if len(hot):
        _, first, second = chunk.windows(np.flatnonzero(member(chunk.key, hot)))
        first, second, _ = unique_pairs(first, second)
        out += [(b, b"h" + parts(pack_sorted(first[i:j]), second[i:j].astype("<u4").tobytes())) for b, i, j in by_bucket(first, n_buckets)]
    return out


def covered_bytes(chunk: Anchored, anchors: list[bytes], answers: list[bytes]) -> np.ndarray:
    """Which bytes of the buffer the repeats cover."""
    change = np.zeros(len(chunk.buffer) + 1, np.int64)

    def mark(runs: list[int], left: int, right: int) -> None:
        at = chunk.at[runs]
        np.add.at(change, at - left, 1)
        np.add.at(change, at + right, -1)

    shared, hot = answered_anchors(anchors)
    told = {}
    for raw in answers:
        if raw[:1] == b"c":
            for rank, left, right in zip(*(unpack(p).tolist() for p in unparts(raw[1:])), strict=True):
                told[rank] = (left, right)
    for rank, (_, (right, left), runs) in enumerate(chunk.contexts(np.flatnonzero(member(chunk.key, shared)))):
        if len(runs) > 1:
            mark(runs, len(left), len(right))
        elif rank in told:
            mark(runs, *told[rank])
    # anchors that only this chunk has
    own = chunk.repeated_keys()
    own = own[~member(own, shared) & ~member(own, hot)]
    groups: dict[int, list[tuple[tuple[bytes, bytes], list[int]]]] = defaultdict(list)
    for key, context, runs in chunk.contexts(np.flatnonzero(member(chunk.key, own))):
        groups[key].append((context, runs))
    for group in groups.values():
        for k, reach in reaches([c for c, _ in group], [len(r) > 1 for _, r in group], chunk.least).items():
            mark(group[k][1], *reach)
    if len(hot):
        starts, first, second = chunk.windows(np.flatnonzero(member(chunk.key, hot)))
        a, b, times = unique_pairs(first, second)
        elsewhere = [unparts(raw[1:]) for raw in answers if raw[:1] == b"h"]
        a = np.concatenate([a[times > 1], *(unpack_sorted(x) for x, _ in elsewhere)])
        b = np.concatenate([b[times > 1], *(np.frombuffer(y, "<u4").astype(np.uint64) for _, y in elsewhere)])
        found = starts[in_pairs(first, second, a, b)]
        np.add.at(change, found, 1)
        np.add.at(change, found + chunk.least, -1)
    return np.cumsum(change[:-1]) > 0


def cleaned(chunk: Anchored, covered: np.ndarray, with_text: bool) -> pa.Table:
    gone: dict[int, np.ndarray] = {}
    for t, off, at, size in chunk.segments:
        own = covered[at : at + size]
        if own.any():
            gone.setdefault(t, np.zeros(len(chunk.raw[t]), bool))[off : off + size] |= own
    out: list[list] = [[] for _ in range(7)]
    for t, (doc, raw) in enumerate(zip(chunk.ids, chunk.raw, strict=True)):
        spans, kept = [], raw
        if t in gone:
            edges = np.flatnonzero(np.diff(gone[t], prepend=False, append=False)).tolist()
            spans = [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]
            kept = b"".join(raw[a:b] for a, b in zip([0, *edges[1::2]], [*edges[::2], len(raw)], strict=True))
        values = (doc, len(raw), len(raw) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), spans, kept.decode("utf-8", "replace") if with_text else None)
        for c, v in zip(out, values, strict=True):
            c.append(v)
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept_text"]
    return pa.table({n: pa.array(c, t) for n, c, t in zip(names, out, kinds, strict=True)})


def suffix_dedup(docs: DataFrame, least: int = 400, hot: int = 2000, with_text: bool = True, chunk_bytes: int = 4 * MB, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document with the byte spans that a string of `least` bytes covers which starts anywhere else as well.

    Exchanges: the texts once (each reading of a chunk shares it), 8 bytes for each anchor (about one in 185 bytes at
    400), and the different contexts of anchors that occur twice. least must be above 32.
    """
    if least <= GRAM:
        raise ValueError(f"least must be above {GRAM}")
    docs = text_rows(docs, id_col, text_col)
    n_chunks, n_buckets = chunk_plan(docs, chunk_bytes)
    chunks = chunked(docs, n_chunks)
    anchors = gather(scatter(chunks, lambda _, t, __: sent_anchors(Anchored(t, least), n_buckets)), repeated_anchors(hot))
    answers = gather(scatter(chunks, lambda _, t, a: sent_contexts(Anchored(t, least), a.column("payload").to_pylist(), n_buckets), anchors), gathered(least))
    both = anchors.selectExpr("chunk", "true as anchor", "payload").unionByName(answers.selectExpr("chunk", "false as anchor", "payload"))

    def finished(texts: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Anchored(texts, least)
        held = list(zip(answers.column("anchor").to_pylist(), answers.column("payload").to_pylist(), strict=True))
        return cleaned(chunk, covered_bytes(chunk, [p for a, p in held if a], [p for a, p in held if not a]), with_text)

    return chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(finished, RESULT)


# ---------------------------------------------------------------- the groups themselves

GROUPS = "repeat_id string, length long, doc_id long, start long, row long"


def named(right: bytes, left: bytes) -> int:
    from xxhash import xxh3_64_intdigest

    return xxh3_64_intdigest(left[::-1] + right)


def named_repeats(contexts: list[Context], several: list[bool], least: int) -> Iterator[tuple[int, int, int, int]]:
    """(context, name, bytes to the left, bytes to the right) for each member of each repeat."""
    for members, left, right in group_repeats(contexts, several, least):
        name = named(contexts[members[0]][0][:right], contexts[members[0]][1][:left])
        for k in members:
            yield k, name, left, right


def gathered_groups(least: int):
    """Bucket work: for each chunk the repeats that its contexts take part in."""

    def work(chunk_ids: list[int], payloads: list[bytes]) -> Iterator[tuple[int, bytes]]:
        answers: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
        for different in received(chunk_ids, payloads):
            places = list(different.values())
            for k, name, left, right in named_repeats(list(different), [len(p) > 1 for p in places], least):
                for chunk, r in places[k]:
                    answers[chunk].append((r, name, left, right))
        for chunk, found in answers.items():
            rank, name, left, right = zip(*found, strict=True)
            yield chunk, b"c" + parts(pack(np.array(rank)), np.array(name, "<u8").tobytes(), pack(np.array(left)), pack(np.array(right)))
        yield from repeated_windows(chunk_ids, payloads)

    return work


def repeat_groups(docs: DataFrame, least: int = 400, hot: int = 2000, chunk_bytes: int = 4 * MB, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(repeat_id, length, doc_id, start) of all occurrences of repeats of at least `least` bytes that can't be extended.

    An anchor tells repeats as far as its windows reach, and adjoining anchors that tell the same occurrences are put together,
    however long the repeat is. A repeat is cut only where a part of it, longer than an anchor's windows reach (some
    2 x `least` bytes), occurs elsewhere, too: that part is a group with all its occurrences, and so is what lies on either
    side, with as much of the part as the anchors there see. Exchanges are those of `suffix_dedup`, 8 bytes more for each
    context, and the occurrences twice, by repeat; a frequent one is split by the adaptive planner.
    """
    docs = text_rows(docs, id_col, text_col)
    n_chunks, n_buckets = chunk_plan(docs, chunk_bytes)
    chunks = chunked(docs, n_chunks, row="row")
    anchors = gather(scatter(chunks, lambda _, t, __: sent_anchors_and_contexts(Anchored(t, least), n_buckets)), repeated_anchors(hot))
    found = gather(scatter(chunks, lambda _, t, a: sent_contexts(Anchored(t, least), a.column("payload").to_pylist(), n_buckets), anchors), gathered_groups(least))
    both = anchors.selectExpr("chunk", "true as anchor", "payload").unionByName(found.selectExpr("chunk", "false as anchor", "payload"))

    def finished(texts: pa.Table, answers: pa.Table) -> pa.Table:
        chunk = Anchored(texts, least)
        held = list(zip(answers.column("anchor").to_pylist(), answers.column("payload").to_pylist(), strict=True))
        told = list(occurrences(chunk, [p for a, p in held if a], [p for a, p in held if not a]))
        columns = list(zip(*told, strict=True)) or [[], [], [], [], []]
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("repeat_id", "length", "doc_id", "start", "row"), columns, kinds, strict=True)})

    return joined_groups(materialized(chunks.groupBy("chunk").cogroup(both.groupBy("chunk")).applyInArrow(finished, GROUPS), "repeats"))


def joined_groups(told: DataFrame) -> DataFrame:
    """Repeats that overlap or adjoin in their first occurrence and have the same occurrences, relative to it, as one."""
    home = told.groupBy("repeat_id", "length").agg(F.min(F.struct("row", "start")).alias("home"), F.count("*").alias("n"))
    away = F.xxhash64("row", F.col("start") - F.col("home.start"))
    marked = told.join(home, ["repeat_id", "length"]).groupBy("repeat_id", "length", "home", "n").agg(F.bit_xor(away).alias("mark"))
    # a repeat belongs to the ones before it unless it starts behind the end of all of them
    alike = W.partitionBy("home.row", "n", "mark").orderBy("home.start", "length", "repeat_id")
    end = F.max(F.col("home.start") + F.col("length")).over(alike.rowsBetween(W.unboundedPreceding, -1))
    numbered = marked.withColumn("begins", F.coalesce(F.col("home.start") > end, F.lit(True)).cast("long")).withColumn("island", F.sum("begins").over(alike.rowsBetween(W.unboundedPreceding, 0)))
    first = F.min(F.struct("home.start", "length", "repeat_id")).alias("first")
    islands = numbered.groupBy("home.row", "n", "mark", "island").agg(first, F.max(F.col("home.start") + F.col("length")).alias("end"))
    kept = islands.select(F.col("first.repeat_id").alias("repeat_id"), F.col("first.length").alias("length"), (F.col("end") - F.col("first.start")).alias("whole"))
    # the first of an island starts where the island does, in every occurrence
    return told.join(kept, ["repeat_id", "length"]).select("repeat_id", F.col("whole").alias("length"), "doc_id", "start")


def occurrences(chunk: Anchored, anchors: list[bytes], answers: list[bytes]) -> Iterator[tuple[str, int, int | None, int, int]]:
    starts = np.array([at for _, _, at, _ in chunk.segments], np.int64)

    def place(at: int) -> tuple[int | None, int, int]:
        text, off, first, _ = chunk.segments[int(np.searchsorted(starts, at, side="right")) - 1]
        return chunk.ids[text], off + at - first, chunk.rows[text]

    shared, hot = answered_anchors(anchors)
    known = chunk.contexts(np.flatnonzero(member(chunk.key, shared)))
    local: dict[tuple[int, int, int], set[int]] = defaultdict(set)
    for raw in answers:
        if raw[:1] == b"c":
            rank, name, left, right = unparts(raw[1:])
            for r, n, a, b in zip(unpack(rank).tolist(), np.frombuffer(name, "<u8").tolist(), unpack(left).tolist(), unpack(right).tolist(), strict=True):
                local[n, a, b].update(known[r][2])
    for _, (right, left), runs in known:  # copies that only this chunk has of a context
        if len(runs) > 1:
            local[named(right, left), len(left), len(right)].update(runs)
    own = chunk.repeated_keys()
    own = own[~member(own, shared) & ~member(own, hot)]
    groups: dict[int, list[tuple[Context, list[int]]]] = defaultdict(list)
    for key, context, runs in chunk.contexts(np.flatnonzero(member(chunk.key, own))):
        groups[key].append((context, runs))
    for group in groups.values():
        for k, name, left, right in named_repeats([c for c, _ in group], [len(r) > 1 for _, r in group], chunk.least):
            local[name, left, right].update(group[k][1])
    told: set[tuple[int, int, int]] = set()
    for (name, left, right), runs in local.items():
        told.update((name, left + right, int(chunk.at[run]) - left) for run in runs)
    if len(hot):
        at, first, second = chunk.windows(np.flatnonzero(member(chunk.key, hot)))
        a, b, times = unique_pairs(first, second)
        elsewhere = [unparts(raw[1:]) for raw in answers if raw[:1] == b"h"]
        a = np.concatenate([a[times > 1], *(unpack_sorted(x) for x, _ in elsewhere)])
        b = np.concatenate([b[times > 1], *(np.frombuffer(y, "<u4").astype(np.uint64) for _, y in elsewhere)])
        told.update((int(first[k]), chunk.least, int(at[k])) for k in np.flatnonzero(in_pairs(first, second, a, b)))
    # a long text's segments overlap: what lies in two is told once
    for name, length, doc, start, row in sorted({(f"{name:016x}", length, *place(at)) for name, length, at in told}, key=repr):
        yield name, length, doc, start, row
