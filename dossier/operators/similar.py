"""Similarity join of texts: all pairs whose matching-block ratio reaches a threshold, by an inverted index of segments.

A ratio 2 M / (m + n) >= t of texts of m and n characters leaves at most (1 - t) (m + n) characters without a partner, so a right text of n
characters has at most `most_edits(n)` edits, whatever its partner. It is cut into one segment more than that. Walking through the segments, the
edits so far less the segments so far start at 0 and end below it, and fall by one at most; where they first fall below 0 lies a segment
without an edit, with exactly as many edits before it as segments. So its first characters, as many as all segments have, stand in the left
text as well, shifted by at most that many places, and the rest of the edits bounds the shift against the end. A left text
asks with all its substrings of these lengths.

Keys hold the substring, the class of the right text's length and a range of places, so a frequent substring is many keys. A bitmap of the right
side's keys, of a fixed size, is the only thing that goes to all tasks; left substrings without a bit there are never sent. The rest is
a join on the key with the exact test of places, and each candidate pair is compared once. No pair is lost: hashes that
collide only make candidates.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import floor, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import DASHES, ZERO_WIDTH

PLACES, SLACK = 16, 1e-9
#: Lengths of right texts fall into classes that grow by this factor.
CLASS = 1.2


#: What a comparison drops, and what it reads as a hyphen.
REPLACED = dict.fromkeys(map(ord, ZERO_WIDTH), "") | dict.fromkeys(map(ord, DASHES), "-")


@F.pandas_udf(T.StringType())
def comparable(s: pd.Series) -> pd.Series:
    """The comparison form of functions.text, compatibility forms unified, in one call."""
    from unicodedata import normalize

    def form(t: str | None) -> str | None:
        if t is None:
            return None
        return " ".join((t if t.isascii() else normalize("NFKC", t).translate(REPLACED)).split())

    return pd.Series([form(t) for t in s], dtype=object)


def longest_partner(n: int, threshold: float) -> float:
    """How many characters the partner of a text of n can have: all n match, and lengths differ by a quarter at most."""
    return min(2 * n / threshold - n, n / 0.75) + SLACK


def most_edits(n: int, threshold: float) -> int:
    return floor((1 - threshold) * (n + floor(longest_partner(n, threshold))) + SLACK)


def class_of(n: int) -> int:
    return floor(log(n) / log(CLASS))


def segments(n: int, threshold: float) -> tuple[np.ndarray, int]:
    """(first places of the segments of a text of n characters, how many characters of each are a key)"""
    k = most_edits(n, threshold) + 1
    return np.arange(k) * n // k, n // k


@lru_cache(maxsize=100_000)
def asked(m: int, threshold: float) -> list[tuple[int, int]]:
    """(length of substrings, class of the right text) of all right texts that a text of m characters may match."""
    low = max(1, floor(min(m * threshold / (2 - threshold), m * 0.75) * (1 - SLACK)))
    high = floor(longest_partner(m, threshold)) + 1
    return sorted({(n // (most_edits(n, threshold) + 1), class_of(n)) for n in range(low, high + 1)})


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def hashes(code: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each place on."""
    out = np.full(max(len(code) - q + 1, 0), q, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(q):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + code[k : k + len(out)])
    return out


def keys(hashed: np.ndarray, class_: int, range_: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mixed(hashed + np.uint64(class_ + 1000) * np.uint64(0xD1B54A32D192ED03) + range_.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7)).view(np.int64)


def right_keys(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(key, y, n, class, segment, at) of right texts; a segment has a key for each range of places where the left text may have it."""
    for batch in batches:
        out: list[tuple] = []
        for y, text in dict(zip(batch.column("y").to_pylist(), batch.column("form").to_pylist(), strict=True)).items():
            if not (n := len(text or "")):
                continue
            code = codes(text)
            at, q = segments(n, threshold)
            number = np.arange(len(at))
            own = hashes(code, q)[at]
            first, last = np.maximum(at - number, 0) // PLACES, (at + number) // PLACES
            for step in range(int((last - first).max()) + 1):
                k = np.flatnonzero(first + step <= last)
                out.append((keys(own[k], class_of(n), (first + step)[k]), np.full(len(k), y), np.full(len(k), n), np.full(len(k), class_of(n)), number[k], at[k]))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*out, strict=True)], ["key", "y", "n", "class", "segment", "at"])


#: Characters that are hashed at once.
CHARS = 1_000_000


def packed_texts(numbers: list[int], texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    """The different texts with their numbers, about CHARS characters at a time."""
    held: dict[int, str] = {}
    size = 0
    for n, text in zip(numbers, texts, strict=True):
        if n not in held:
            held[n] = text
            size += len(text)
            if size > CHARS:
                yield np.array(list(held), np.int64), list(held.values())
                held, size = {}, 0
    if held:
        yield np.array(list(held), np.int64), list(held.values())


def left_keys(bits: Broadcast, classes: frozenset[int], threshold: float):
    """(key, x, m, at) of the left texts' substrings that the bitmap knows, for the classes of length that right texts have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, asks = bits.value, {}

        def wanted(m: int) -> list[tuple[int, int]]:
            if m not in asks:
                asks[m] = [(q, c) for q, c in asked(m, threshold) if c in classes and q <= m]
            return asks[m]

        size = np.uint64(8 * len(known) - 1)
        for batch in batches:
            own = [(x, t) for x, t in zip(batch.column("x").to_pylist(), batch.column("form").to_pylist(), strict=True) if t and wanted(len(t))]
            for x, texts in packed_texts([x for x, _ in own], [t for _, t in own]):
                m = np.fromiter(map(len, texts), np.int64, len(texts))
                start, code = np.cumsum(m) - m, codes("".join(texts))
                lines: dict[tuple[int, int], list[int]] = {}
                for k, n in enumerate(m.tolist()):
                    for ask in wanted(n):
                        lines.setdefault(ask, []).append(k)
                made = {q: hashes(code, q) for q in {q for q, _ in lines}}
                out = []
                for (q, class_), asking in lines.items():
                    k = np.array(asking)
                    n = m[k] - q + 1
                    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    line = np.repeat(k, n)
                    key = keys(made[q][start[line] + at], class_, at // PLACES)
                    bit = key.view(np.uint64) & size
                    hit = np.flatnonzero(known[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8) & 1)
                    out.append((key[hit], x[line[hit]], m[line[hit]], at[hit]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["key", "x", "m", "at"])

    return run


def bitmap(keyed: DataFrame, bits: int) -> np.ndarray:
    """Which of 2^bits low ends of keys there are; the engine makes it in rows of 4 KB, so it has at most 2^(bits - 3) bytes."""
    place = F.expr(f"(key & {(1 << bits) - 1}L) + 1")  # the engine counts places from 1
    rows = keyed.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    out = np.zeros(max((1 << bits) // 8, 4096), np.uint8)
    for b, own in rows.toLocalIterator():
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(bytes(own), np.uint8)
    return out[: (1 << bits) // 8]


def histograms(texts: list[str], width: int, bins: int) -> np.ndarray:
    """How often each text has the substrings of `width` characters of each bin."""
    lens = np.fromiter(map(len, texts), np.int64, len(texts))
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    rows = np.repeat(np.arange(len(texts)), lens)
    value = code[: max(len(code) - width + 1, 0)]
    for k in range(1, width):
        value = value * 31 + code[k : k + len(value)]
    own = rows[: len(value)] == rows[width - 1 :]  # not over the end of a text
    return np.bincount((rows[: len(value)] * bins + value % bins)[own], minlength=len(texts) * bins).reshape(-1, bins).astype(np.int32)


#: Pairs whose histograms are held at once.
AT_ONCE = 4000


def apart(x: list[str], y: list[str], width: int, bins: int) -> np.ndarray:
    """How far the histograms of pairs are from each other; each different text has one."""
    (of_x, x), (of_y, y) = ((np.array([number.setdefault(t, len(number)) for t in texts]), list(number)) for texts, number in ((x, {}), (y, {})))
    return np.abs(histograms(x, width, bins)[of_x] - histograms(y, width, bins)[of_y]).sum(axis=1)


def ratios(a: list[str], b: list[str], threshold: float) -> np.ndarray:
    """Matching-block ratios of pairs; NaN for those that stay below the threshold. An edit changes the count of one character,
    and of three pairs of adjoining characters at most, so most pairs are told apart by counting."""
    from difflib import SequenceMatcher

    out, known = np.full(len(a), np.nan), {}
    matcher = SequenceMatcher(None, "", "")
    for first in range(0, len(a), AT_ONCE):
        x, y = a[first : first + AT_ONCE], b[first : first + AT_ONCE]
        edits = (1 - threshold + SLACK) * (np.fromiter(map(len, x), np.int64, len(x)) + np.fromiter(map(len, y), np.int64, len(y)))
        near = np.arange(len(x))
        for width, bins in ((1, 64), (2, 512)):
            if len(near):
                near = near[apart([x[i] for i in near], [y[i] for i in near], width, bins) <= (2 * width - 1) * edits[near]]
        for i in sorted(near.tolist(), key=y.__getitem__):
            pair = x[i], y[i]
            if pair not in known:
                if matcher.b is not y[i]:
                    matcher.set_seq2(y[i])
                matcher.set_seq1(x[i])
                known[pair] = matcher.ratio()
            if known[pair] >= threshold:
                out[first + i] = known[pair]
    return out


def candidates(left: DataFrame, right: DataFrame, threshold: float, bits: int) -> DataFrame:
    """(x, y): numbers of left forms (x, form) and right ones (y, form) that have a segment in common where an edit script allows it.
    Forms may be repeated."""
    y = right.mapInArrow(lambda batches: right_keys(batches, threshold), "key long, y long, n long, class long, segment long, at long")
    shared = left.sparkSession.sparkContext.broadcast(bitmap(y, bits))
    classes = frozenset(r[0] for r in y.select("class").distinct().collect())  # they grow by a factor, so there are few, however many texts
    x = left.mapInArrow(left_keys(shared, classes, threshold), "key long, x long, m long, at long").withColumnRenamed("at", "x_at")
    met = x.join(y, "key")
    shift, more = F.col("x_at") - F.col("at"), F.col("m") - F.col("n")
    rest = F.floor((1 - threshold) * (F.col("m") + F.col("n")) + SLACK) - F.col("segment")
    lengths = F.abs(more) <= 0.25 * F.greatest("m", "n")
    return met.where((F.abs(shift) <= F.col("segment")) & (F.abs(more - shift) <= rest) & lengths).select("x", "y").distinct()


def similar_pairs(left: DataFrame, right: DataFrame, a: str, b: str, threshold: float = 0.92, bits: int = 26) -> DataFrame:
    """All pairs of different rows, with their similarity, whose texts differ in length by at most a quarter and reach the threshold.

    Left texts are read twice and shuffled once. The threshold must be over 0.6, as segments would be empty otherwise. Texts that
    are null or empty in the comparison form match nothing.
    """
    if threshold <= 0.6:
        raise ValueError("the threshold must be over 0.6")
    # rows without a text make no keys, so they need no filter, which would compute the form once more
    numbered = lambda df, c, form, n: df.withColumn(form, comparable(c)).withColumn(n, F.xxhash64(form))
    x, y = numbered(left, a, "_fa", "x"), numbered(right, b, "_fb", "y")
    found = candidates(x.select("x", F.col("_fa").alias("form")), y.select("y", F.col("_fb").alias("form")), threshold, bits)

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratio = ratios(batch.column("_fa").to_pylist(), batch.column("_fb").to_pylist(), threshold)
            yield batch.append_column("similarity", pa.array(ratio)).filter(pa.array(~np.isnan(ratio)))

    pairs = x.join(found, "x").join(y.select("y", "_fb").distinct(), "y").drop("x", "y")
    near = pairs.mapInArrow(compared, T.StructType([*pairs.schema.fields, T.StructField("similarity", T.DoubleType())]))
    return near.join(y.drop("y"), "_fb").select(*left.columns, *right.columns, "similarity").distinct()


@F.pandas_udf(T.DoubleType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")
