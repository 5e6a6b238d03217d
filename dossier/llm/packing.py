"""Best-fit packing by minimum bin slack.

Documents become token ids, longer ones are cut, and the pieces go into sequences of a fixed size. The choice of which
lengths share a sequence needs only the histogram of lengths, which has at most `capacity` entries however large the
corpus is. On it, each bin is filled as full as any combination of the available lengths allows: it is opened with the
longest one left, and a bitset subset-sum over the rest finds the fullest feasible total. The combination is then taken
as often as the counts allow, so the number of steps depends on the number of different lengths, not of pieces. Pieces
find their place by their rank among the pieces of their length: ranks come from windows over (length, salt), so
no length, however frequent, is ranked in one task.

Defined results: a null or empty text is one token, the closing id. Repeated rows are packed each by itself. A text
longer than a sequence is cut into full pieces and a rest. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialized, sliced, text_rows
from .exchange import placed as placed_rows

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ---------------------------------------------------------------- which lengths share a sequence


def fullest(counts: dict[int, int], room: int) -> list[int]:
    """A multiset of the lengths in counts whose sum is the greatest possible one of at most room.

    Longer lengths first; bit s of reach[i] tells that the first i items can sum to s. A count c is split into
    1, 2, 4, ... copies, so that the bitset is shifted log(c) times for each length.
    """
    full, reach, items = (1 << (room + 1)) - 1, [1], []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        times = 1
        while left > 0:
            take = min(times, left)
            items.append((length, take))
            reach.append((reach[-1] | reach[-1] << (length * take)) & full)
            left -= take
            times *= 2
            if reach[-1] >> room & 1:
                left = 0
        if reach[-1] >> room & 1:
            break
    total, chosen = reach[-1].bit_length() - 1, []
    for i in range(len(items), 0, -1):
        length, take = items[i - 1]
        if not reach[i - 1] >> total & 1:
            chosen += [length] * take
            total -= length * take
    return chosen


def minimum_slack(histogram: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths of one sequence, number of such sequences) for all pieces of the histogram."""
    left, out = {k: v for k, v in histogram.items() if v > 0}, []
    while left:
        longest = max(left)
        rest = dict(left)
        rest[longest] -= 1
        bin_ = [longest, *fullest({k: v for k, v in rest.items() if v and k <= capacity - longest}, capacity - longest)]
        need: dict[int, int] = {}
        for length in bin_:
            need[length] = need.get(length, 0) + 1
        times = min(left[k] // n for k, n in need.items())
        out.append((bin_, times))
        for k, n in need.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
    return out


def slots(plan: list[tuple[list[int], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, pieces of the length in each sequence, offset of the first)."""
    out, used, sequence = [], {}, 0
    for lengths, times in plan:
        offset, counted = 0, {}
        for length in sorted(lengths, reverse=True):  # pieces of a length lie side by side
            counted.setdefault(length, [0, offset])[0] += 1
            offset += length
        for length, (n, at) in counted.items():
            first = used.get(length, 0)
            out.append((length, first, first + n * times, sequence, n, at))
            used[length] = first + n * times
        sequence += times
    return sorted(out)


# ---------------------------------------------------------------- token ids


class Codes(dict):
    """Numbers for words in the order in which they are first asked for; fresh holds those not looked up before."""

    def __init__(self) -> None:
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


#: Characters that are neither letters nor numbers nor white space, in ASCII.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class WordIds:
    """Ids of white-space separated words, which the tokenizer reads independently of each other.

    A word is letters (Latin-1, for which lower-casing is all that the normalizer does) and then marks, or anything
    else. Letters are read by the tokenizer's own merges, many words at a time: the last token of each says that a
    word ends. Marks and all other words go through the whole tokenizer. The ids of all words seen lie in one flat
    array, and start anew above max_words, so memory has a bound.
    """

    def __init__(self, path: str, max_words: int = 1_500_000, slice_chars: int = 1_000_000) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks of an executor already use its cores
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.letters = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.letters.normalizer = None
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.whole.get_vocab_size() + 1, bool)
        for token, i in self.whole.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.max_words, self.slice_chars = max_words, slice_chars
        self.clear()

    def clear(self) -> None:
        self.code, self.tails = Codes(), {"": (0, 0)}
        self.ids, self.n_ids = np.zeros(1 << 20, np.uint32), 0
        #: of each word: start and number of its first ids, start and number of its last ids
        self.place = np.zeros((1 << 18, 4), np.int64)

    def keep(self, ids: np.ndarray) -> int:
        start = self.n_ids
        while start + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[start : start + len(ids)] = ids
        self.n_ids += len(ids)
        return start

    def keep_each(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Start and number of the ids of words that the whole tokenizer reads."""
        got = [e.ids for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        lens = np.fromiter(map(len, got), np.int64, len(got))
        start = self.keep(np.fromiter(chain.from_iterable(got), np.uint32, int(lens.sum())))
        return start + np.cumsum(lens) - lens, lens

    def learn(self, words: list[str]) -> None:
        first, n = len(self.code) - len(words), len(words)
        while first + n > len(self.place):
            self.place = np.concatenate([self.place, np.zeros_like(self.place)])
        new: dict[str, int] = {}
        lettered, core_of, tail_of, other = [], [], [], []
        for k, word in enumerate(words):
            core = word
            if not (plain := word.isalpha()):
                core = word.rstrip(MARKS)
            if (plain or core.isalpha()) and (core.isascii() or max(core) <= "\xff"):
                lettered.append(first + k)
                core_of.append(new.setdefault(core.lower(), len(new)))
                tail_of.append("" if plain else word[len(core) :])
            else:
                other.append(k)
        if new:
            got = self.letters.encode_batch_fast([" ".join(new)], add_special_tokens=False)[0].ids
            got = np.array(got, np.uint32)
            stops = np.flatnonzero(self.ends[got]) + 1
            assert len(stops) == len(new), "a word of letters has one last token"
            start = self.keep(got)
            starts = np.concatenate([[0], stops[:-1]])
            core = np.array(core_of)
            at = np.array(lettered)
            self.place[at, 0], self.place[at, 1] = start + starts[core], (stops - starts)[core]
            if unknown := list({t for t in tail_of if t not in self.tails}):
                self.tails.update(zip(unknown, zip(*(x.tolist() for x in self.keep_each(unknown)), strict=True), strict=True))
            self.place[at, 2:] = [self.tails[t] for t in tail_of]
        if other:
            at = first + np.array(other)
            self.place[at, 0], self.place[at, 1] = self.keep_each([words[k] for k in other])
            self.place[at, 2:] = 0

    def looked_up(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the words in turn, number of ids up to the end of each word)"""
        if len(self.code) > self.max_words:
            self.clear()
        at = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        if self.code.fresh:
            self.learn(self.code.fresh)
            self.code.fresh = []
        place = self.place[at]
        start, lens = place[:, ::2].ravel(), place[:, 1::2].ravel()
        stops = np.cumsum(lens)
        return self.ids[np.arange(stops[-1]) + np.repeat(start - stops + lens, lens)], stops[1::2]

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text; of a very long one slice by slice, each ending at a space or line end."""
        out, at = [], 0
        while at < len(text):
            end = at + self.slice_chars
            if end < len(text):
                ends = [x for x in (text.find(" ", end), text.find("\n", end)) if x >= 0]
                end = min(ends, default=len(text))
            out.append(self.looked_up(text[at:end].replace("\n", " ").split(" "))[0])
            at = end
        return np.concatenate(out) if out else np.zeros(0, np.uint32)

    def encode_many(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The same for many texts; the words of about slice_chars characters are looked up at once."""
        held: list[list[str]] = []
        size = 0
        for text in chain(texts, [None]):
            if held and (text is None or size + len(text) > self.slice_chars):
                flat, stops = self.looked_up(list(chain.from_iterable(held)))
                ends = np.cumsum([len(words) for words in held])
                yield from np.split(flat, stops[ends[:-1] - 1])
                held, size = [], 0
            if text is None:
                return
            if len(text) > self.slice_chars:
                yield self.encode(text)
            else:
                held.append(text.replace("\n", " ").split(" "))
                size += len(text)


@lru_cache(maxsize=1)
def word_ids(path: str, max_words: int) -> WordIds:
    return WordIds(path, max_words)


def cut(tokenizer_path: str, capacity: int, end_id: int, max_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        words, end = word_ids(tokenizer_path, max_words), np.array([end_id], "<u4")
        for batch in sliced(batches):
            cols: list[list[int]] = [[], [], [], [], []]
            texts = [x or "" for x in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("doc_id").to_pylist(), words.encode_many(texts), strict=True):
                ids = np.concatenate([ids, end]).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    own = ids[start : start + capacity]
                    for c, v in zip(cols, (doc, piece, start, len(own), zlib.crc32(own.tobytes())), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", max_words: int = 1_500_000) -> DataFrame:
    """Token pieces of every document: only documents longer than a sequence are cut. max_words bounds a task's table of known words."""
    return text_rows(docs, id_col, text_col).mapInArrow(cut(tokenizer_path, capacity, end_id, max_words), PIECES)


# ---------------------------------------------------------------- the operator


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, rows_per_salt: int = 200_000, id_col: str = "doc_id", text_col: str = "text", max_words: int = 1_500_000) -> DataFrame:
    """Each piece with its sequence and its place there.

    The pieces (numbers only, no texts) are written once, so that a lost executor cannot make ranks and counts differ.
    To the driver goes the histogram, of at most `capacity` rows; to the executors the slot table, whose size depends on
    `capacity` alone. The number of salts follows the most frequent length.
    """
    spark = docs.sparkSession
    made = materialized(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col, max_words), "pieces")
    histogram = {r[0]: r[1] for r in made.groupBy("length").count().collect()}
    plan = minimum_slack(histogram, capacity)
    table = spark.sparkContext.broadcast(slot_arrays(slots(plan)))
    salts = max(8, -(-max(histogram.values(), default=1) // rows_per_salt))
    made, place = placed_rows(made)
    salted = made.withColumn("place", place).withColumn("salt", F.pmod("place", F.lit(salts)).cast("int"))
    counts = salted.groupBy("length", "salt").count()
    before = W.Window.partitionBy("length").orderBy("salt").rowsBetween(W.Window.unboundedPreceding, -1)
    offsets = counts.select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    rank = F.row_number().over(W.Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "place"))
    ranked = salted.withColumn("rank", rank.cast("long")).join(F.broadcast(offsets) if salts * len(histogram) <= 100_000 else offsets, ["length", "salt"])
    placed = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("ahead") + F.col("rank") - 1).alias("rank"))
    return placed.mapInArrow(seated(table), f"{PIECES}, sequence_id long, offset long")


def slot_arrays(table) -> np.ndarray:
    return np.array(table, np.int64).reshape(-1, 6)


def seated(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        # (length, rank) as one rising number: ranks of a length lie below the count of all pieces
        far = int(table[:, 2].max()) + 1 if len(table) else 1
        edges = table[:, 0] * far + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            own = table[np.searchsorted(edges, length * far + rank, side="right") - 1]
            step = rank - own[:, 1]
            sequence, offset = own[:, 3] + step // own[:, 4], own[:, 5] + step % own[:, 4] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return run
