"""Benchmark decontamination by suffix arrays of the training text.

Each shard of training documents, some MB of text, has a suffix array over all its words: the places of all words in the
order of the words that follow, made by doubling the sorted length until it is at least `window` words. Every suffix of
every test item is binary-searched in it, which gives all places that agree in as many words as are needed; from there
the longest verbatim match is followed word by word. An item matches a document where `window` consecutive words agree
(an item with fewer words must agree as a whole). The shards are parts of the batches that a task reads, so there is no
shuffle: texts are read once and stay where they are.

The test items are a stated query set. They are sent to all tasks in blocks of at most `block_words` words. There is one
pass over the texts for each block, and only its block is held by driver and tasks; with several, what is found in each
pass is written to the shared folder and put together by row.

Words are runs of ASCII letters and digits and of all other non-ASCII characters, with A-Z in lower case.

Defined results: null and empty texts have no words and no hits; items without words match nothing. Repeated training rows are
searched each by itself, items with the same id count once. Very long texts are searched whole. Null item ids are
ignored in the list of items. Other columns are ignored. An empty table on either side gives no hits.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept_rows, materialized, sliced, text_rows
from .exchange import placed
from .terms import encoded, tokens, words_of

SPAN = "struct<start: long, end: long>"
MATCH = "struct<item_id: string, doc_start: long, item_start: long, n_words: long>"
RESULT = f"doc_id long, n_words long, n_hit long, hit_spans array<{SPAN}>, matches array<{MATCH}>, items array<string>"

Block = list[tuple[str | None, bytes]]


class Searched:
    """A block of test items: their words one after the other, and all suffixes that are as long as needed."""

    def __init__(self, items: Block, window: int) -> None:
        self.ids: list[str | None] = []
        self.words: list[bytes] = []
        ends = []
        for item, raw in items:
            if own := words_of(raw):
                self.ids.append(item)
                self.words += own
                ends.append(len(self.words))
        self.ends = np.array(ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64) if ends else self.ends
        held = pa.array(self.words, pa.binary()).dictionary_encode()
        self.names, self.codes = held.dictionary, held.indices.to_numpy()
        counts = np.diff(self.ends, prepend=0)
        need = np.minimum(counts, window)
        suffixes = counts - need + 1
        #: item number, first word and needed words of each suffix
        self.item = np.repeat(np.arange(len(counts)), suffixes)
        self.at = np.arange(suffixes.sum()) + np.repeat(self.ends - counts - np.cumsum(suffixes) + suffixes, suffixes)
        self.need = need[self.item]


class ShardSuffixes:
    """The suffix array of one shard of documents. Codes are the words' numbers; 0 stands behind each document."""

    def __init__(self, docs: pa.Array, depth: int) -> None:
        data, first, end, doc = tokens(docs)
        self.names, code = encoded(data, first, end)
        self.counts = np.bincount(doc, minlength=len(docs))
        self.ends = np.cumsum(self.counts + 1) - 1
        self.codes = np.zeros(len(code) + len(docs), np.int32)
        self.codes[np.arange(len(code)) + doc] = code + 1
        self.order = self._sorted(depth)

    def _sorted(self, depth: int) -> np.ndarray:
        """Places in the order of the next `depth` words or more."""
        rank, width, n = self.codes.astype(np.uint64), 1, len(self.codes)
        order = np.argsort(rank, kind="stable")
        while width < depth:
            key = rank << np.uint64(32)
            key[: max(n - width, 0)] |= rank[width:]
            order = np.argsort(key, kind="stable")
            new = np.ones(n, bool)
            new[1:] = key[order[1:]] != key[order[:-1]]
            rank[order] = np.cumsum(new).astype(np.uint64)
            width *= 2
        return order

    def codes_of(self, searched: Searched) -> np.ndarray:
        """The items' words in this shard's numbers; -1 for words that it doesn't have."""
        at = pc.fill_null(pc.index_in(searched.names, value_set=self.names), -2).to_numpy()[searched.codes]
        return at.astype(np.int64) + 1

    def range_of(self, wanted: np.ndarray, searched: Searched) -> tuple[np.ndarray, np.ndarray]:
        """Binary search of all test suffixes at once: which part of the array agrees with each in the words it needs."""
        bounds = []
        for upper in (False, True):
            low, high = np.zeros(len(searched.at), np.int64), np.full(len(searched.at), len(self.order))
            while len(open_ := np.flatnonzero(low < high)):
                mid = (low[open_] + high[open_]) // 2
                before = self._compared(self.order[mid], wanted, searched.at[open_], searched.need[open_]) < (1 if upper else 0)
                low[open_[before]] = mid[before] + 1
                high[open_[~before]] = mid[~before]
            bounds.append(low)
        return bounds[0], bounds[1]

    def _compared(self, place: np.ndarray, wanted: np.ndarray, at: np.ndarray, need: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: how the suffixes at some places compare with needed words of test suffixes."""
        out, left, k = np.zeros(len(place), np.int64), np.arange(len(place)), 0
        while len(left):
            mine = self.codes[np.minimum(place[left] + k, len(self.codes) - 1)]
            differ = np.sign(mine - wanted[at[left] + k])
            out[left] = differ
            k += 1
            left = left[(differ == 0) & (need[left] > k)]
        return out

    def longest(self, place: int, wanted: np.ndarray, at: np.ndarray, end: int, need: int) -> tuple[int, int]:
        """(first word, words) of the suffix of an item that agrees in the most words from a place on, given that all agree in `need`."""
        n, ahead = need, np.arange(32)
        while True:
            here = self.codes[np.minimum(place + n + ahead, len(self.codes) - 1)]
            word = at[:, None] + (n + ahead)
            same = (word < end) & (wanted[np.minimum(word, len(wanted) - 1)] == here)
            more = np.where(same.all(axis=1), len(ahead), same.argmin(axis=1))
            if more.max() < len(ahead):
                return int(at[more.argmax()]), n + int(more.max())
            at, n = at[more == len(ahead)], n + len(ahead)


class Shard:
    """What the suffixes of a block of items find in the documents of one shard.

    Suffixes of equal needed words have one range of the array, so a place is taken once for each item, however often the words are repeated
    on either side. With `told`, what covers the hit words of each item is told as longest matches from left to right: at a place the
    suffix that agrees farthest, drawn out to the left as well, and then the first place whose needed words go beyond it.
    """

    def __init__(self, docs: pa.Array, searched: Searched, window: int, told: bool = True) -> None:
        self.array, self.searched = ShardSuffixes(docs, window), searched
        array = self.array
        self.counts = array.counts.tolist()
        self.wanted = array.codes_of(searched)
        first, last = array.range_of(self.wanted, searched)
        self.matches: dict[int, list[dict]] = defaultdict(list)
        covered = np.zeros(len(array.codes) + 1, np.int32)
        some = np.flatnonzero(last > first)
        ranges = np.unique(np.stack([first[some], last[some], searched.need[some]], axis=1), axis=0)
        for a, b, need in ranges.tolist():
            np.add.at(covered, array.order[a:b], 1)
            np.add.at(covered, array.order[a:b] + need, -1)
        gone = np.cumsum(covered[:-1]) > 0
        self.starts = array.ends - array.counts
        self.spans = [spans_of(gone[a:b]) for a, b in zip(self.starts.tolist(), array.ends.tolist(), strict=True)]
        if told and len(some):
            edges = np.flatnonzero(np.diff(searched.item[some])) + 1
            for own in np.split(some, edges):
                self._tell(int(searched.item[own[0]]), own, first[own], last[own], int(searched.need[own[0]]))

    def _tell(self, item: int, suffix: np.ndarray, first: np.ndarray, last: np.ndarray, need: int) -> None:
        """The matches of one item; `suffix` are its suffixes that occur and [first, last) their ranges."""
        array, start, end = self.array, int(self.searched.starts[item]), int(self.searched.ends[item])
        order = np.argsort(first, kind="stable")
        cut = np.flatnonzero(np.diff(first[order])) + 1
        same = np.split(order, cut)  # suffixes of one range
        places = np.concatenate([array.order[first[k[0]] : last[k[0]]] for k in same])
        which = np.repeat(np.arange(len(same)), [last[k[0]] - first[k[0]] for k in same])
        by_place = np.argsort(places, kind="stable")
        places, which = places[by_place], which[by_place]
        i = 0
        while i < len(places):
            place = int(places[i])
            at, n = array.longest(place, self.wanted, self.searched.at[suffix[same[which[i]]]], end, need)
            reached = place + n
            while at > start and place > 0 and array.codes[place - 1] and array.codes[place - 1] == self.wanted[at - 1]:
                at, place, n = at - 1, place - 1, n + 1
            doc = int(np.searchsorted(array.ends, place))
            self.matches[doc].append({"item_id": self.searched.ids[item], "doc_start": place - int(self.starts[doc]), "item_start": at - start, "n_words": n})
            i = int(np.searchsorted(places, reached - need + 1))

    def told(self, ids: list[int | None]) -> pa.RecordBatch:
        n_hit = [sum(x["end"] - x["start"] for x in own) for own in self.spans]
        matches = [self.matches.get(doc, []) for doc in range(len(ids))]
        items = [sorted({m["item_id"] for m in own if m["item_id"] is not None}) for own in matches]
        long, text = pa.int64(), pa.string()
        kinds = [long, long, long, pa.list_(pa.struct([("start", long), ("end", long)])), pa.list_(pa.struct([("item_id", text), ("doc_start", long), ("item_start", long), ("n_words", long)])), pa.list_(text)]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip((ids, self.counts, n_hit, self.spans, matches, items), kinds, strict=True)], ["doc_id", "n_words", "n_hit", "hit_spans", "matches", "items"])


def spans_of(flags: np.ndarray) -> list[dict[str, int]]:
    if not flags.any():
        return []
    edges = np.flatnonzero(np.diff(flags, prepend=False, append=False)).tolist()
    return [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)]


def searching(block: Broadcast, window: int):
    """Arrow work: search a block of items in rows with columns doc_id and text; other columns come after the result's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searched = Searched(block.value, window)
        for shard in sliced(batches):
            told = Shard(shard.column("text"), searched, window).told(shard.column("doc_id").to_pylist())
            others = [c for c in shard.schema.names if c not in ("doc_id", "text")]
            yield pa.RecordBatch.from_arrays([*told.columns, *(shard.column(c) for c in others)], [*told.schema.names, *others])

    return run


def blocks(benchmark: DataFrame, block_words: int, item_col: str, text_col: str) -> Iterator[Block]:
    """The test items in blocks, at least one; one block is held at a time."""
    block: Block = []
    size, some = 0, False
    for item, text in benchmark.select(F.col(item_col).cast("string"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull()).toLocalIterator():
        raw = text.encode()
        n = len(raw) // 2 + 1
        if block and size + n > block_words:
            yield block
            block, size, some = [], 0, True
        block.append((item, raw))
        size += n
    if block or not some:
        yield block


def followed(found: Iterator[Block]) -> Iterator[tuple[Block, bool]]:
    """Each block, and whether it is the only one or the last."""
    held = next(found)
    for block in found:
        yield held, False
        held = block
    yield held, True


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 2_000_000, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Each document with its words, how many of them and which spans items hit, the longest matches and the items found."""
    context, texts, done = docs.sparkSession.sparkContext, text_rows(docs, id_col, text_col), []
    for block, last in followed(blocks(benchmark, block_words, item_col, text_col)):
        shared = context.broadcast(block)
        if last and not done:
            return texts.mapInArrow(searching(shared, window), RESULT)
        if not done:
            texts, _ = placed(texts)
            place = texts.metadataColumn("_metadata")
            texts = texts.select("doc_id", "text", F.xxhash64(place.getField("file_path")).alias("file"), place.getField("row_index").alias("row"))
        done.append(materialized(texts.mapInArrow(searching(shared, window), f"{RESULT}, file long, row long"), "hits"))
        shared.destroy()
    return together(done)


def together(done: list[DataFrame]) -> DataFrame:
    """What several passes found, by row. Spans of a row that overlap or adjoin become one."""

    def joined(spans):
        def step(held, x):
            last = F.element_at(held, -1)
            longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
            return F.when((F.size(held) > 0) & (x["start"] <= F.get(held, F.size(held) - 1)["end"]), F.concat(F.slice(held, 1, F.size(held) - 1), F.array(longer))).otherwise(F.concat(held, F.array(x)))

        return F.aggregate(F.sort_array(spans), F.array().cast(f"array<{SPAN}>"), step)

    every = done[0]
    for df in done[1:]:
        every = every.union(df)
    lists = {c: F.flatten(F.collect_list(c)).alias(c) for c in ("hit_spans", "matches", "items")}
    rows = every.groupBy("file", "row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), *lists.values())
    rows = rows.withColumn("hit_spans", joined(F.col("hit_spans")))
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return rows.select("doc_id", "n_words", n_hit.alias("n_hit"), "hit_spans", "matches", F.array_sort(F.array_distinct("items")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 2_000_000, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """The documents without a hit, with all their columns; with several blocks one pass after the other."""
    context = docs.sparkSession.sparkContext
    for block, last in followed(blocks(benchmark, block_words, item_col, text_col)):
        shared = context.broadcast(block)
        docs = kept_rows(docs, text_col, unhit(shared, window))
        if not last:
            docs = materialized(docs, "clean")
            shared.destroy()
    return docs


def unhit(block: Broadcast, window: int):
    def judge(parts: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        searched = Searched(block.value, window)
        for part in parts:
            yield part, pa.array([not spans for spans in Shard(part.column(text), searched, window, told=False).spans], pa.bool_())

    return judge
