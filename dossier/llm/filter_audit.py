"""Filter interaction audit: what each filter removes in every order of five filters, by part.

Filters: A, under 200 words; B, under half of the words different; C, more than 2 % of the code points are A-Z; D, one of
`#$%&*|`; E, the same text as a document with a smaller id. A to D are properties of a text. E is found by a fingerprint-routed
RDD: texts go to partitions by their xxhash, a partition stores chains of full texts that have one hash, each with the
smallest id seen so far, and rows whose id isn't the smallest are emitted as soon as that is known.

A task collapses the copies that it has in some MB of text before anything is sent: the rows of a text that have the smallest id of it there
go with the text, counted; all others are known to fail E and are sent without it. So a text that a third of all rows have is sent once
by each task for some MB, and its chain holds one id and counts. The rows of a chain's text that give way to a smaller id
are emitted at once. What comes out (id, part, failed filters and a count) is joined with the labels by id, and combineByKey merges
vectors of 32 combinations of failed filters by part. All orders and steps are sums over these vectors.

Defined results: a null text is an empty one, a null part the empty string. Words are runs of characters other than space, tab, LF,
VT, FF and CR. Repeated rows are counted each; rows with the smallest id of a text all pass E, rows without an id pass E and
no row fails for them. Of repeated labels any that is 1 counts. Very long texts are read whole. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: The bit of E in a combination of failed filters.
COPY = 16
UPPER, SYMBOLS = bytes(range(0x41, 0x5B)), b"#$%&*|"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
RESULT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
FAILED = "doc_id long, part string, failed int, n long"


def failed(text: str, raw: bytes) -> int:
    """Which of A to D a text fails, as bits."""
    words = raw.split()
    upper = len(raw) - len(raw.translate(None, UPPER))
    return (len(words) < 200) + 2 * (2 * len(set(words)) < len(words)) + 4 * (100 * upper > 2 * len(text)) + 8 * (len(raw.translate(None, SYMBOLS)) < len(raw))


class Chain:
    """A text with the smallest id seen so far, and how many rows of each part have that id."""

    __slots__ = ("text", "mask", "id", "parts")

    def __init__(self, text: bytes, mask: int, id_: int | None, parts: dict[str, int]) -> None:
        self.text, self.mask, self.id, self.parts = text, mask, id_, parts

    def met(self, id_: int, parts: dict[str, int]) -> Iterator[tuple[int, str, int, int]]:
        """Take rows of the same text; yield those that now fail E."""
        if id_ > self.id:
            yield from ((id_, part, self.mask | COPY, n) for part, n in parts.items())
        elif id_ < self.id:
            yield from self.told(COPY)
            self.id, self.parts = id_, dict(parts)
        else:
            for part, n in parts.items():
                self.parts[part] = self.parts.get(part, 0) + n

    def told(self, bit: int = 0) -> Iterator[tuple[int, str, int, int]]:
        return ((self.id, part, self.mask | bit, n) for part, n in self.parts.items())


def routed(block_bytes: int):
    """(hash, message) pairs of one task: texts with their smallest ids, and rows that are known to fail or pass E, under a hash of their own."""

    def known(row: tuple[int | None, str, int, int]) -> tuple[int, tuple]:
        return xxhash.xxh64_intdigest(repr(row)), row

    def run(rows: Iterable[Row]) -> Iterator[tuple[int, tuple]]:
        held: dict[bytes, Chain] = {}
        size = 0

        def sent() -> Iterator[tuple[int, tuple]]:
            for c in held.values():
                yield xxhash.xxh64_intdigest(c.text), (c.id, c.parts, c.mask, c.text)

        for id_, part, text in rows:
            raw = text.encode()
            chain = held.get(raw)
            if id_ is None:
                yield known((None, part, failed(text, raw), 1))
            elif chain is not None:
                yield from map(known, chain.met(id_, {part: 1}))
            else:
                held[raw] = Chain(raw, failed(text, raw), id_, {part: 1})
                size += len(raw) + 400
                if size > block_bytes:
                    yield from sent()
                    held, size = {}, 0
        yield from sent()

    return run


def chained(messages: Iterable[tuple[int, tuple]]) -> Iterator[tuple[int | None, str, int, int]]:
    """(id, part, failed filters, rows) of one partition: collision chains by hash, told apart by their full texts."""
    chains: dict[int, list[Chain]] = {}
    for key, message in messages:
        if isinstance(message[1], str):
            yield message
            continue
        id_, parts, mask, text = message
        own = chains.setdefault(key, [])
        for chain in own:
            if chain.text == text:
                yield from chain.met(id_, parts)
                break
        else:
            own.append(Chain(text, mask, id_, parts))
    for own in chains.values():
        for chain in own:
            yield from chain.told()


def failures(docs: DataFrame, bytes_per_partition: int = 48 << 20, block_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(doc_id, part, failed, n): rows of an id and part that fail the same filters, all documents of the table."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // bytes_per_partition))
    found = rows.rdd.mapPartitions(routed(block_bytes)).partitionBy(partitions, lambda key: key).mapPartitions(chained)
    return docs.sparkSession.createDataFrame(found, FAILED, verifySchema=False)


def vectors(counted: DataFrame):
    """(part, counts[3][32]): all, good and toxic rows of each combination of failed filters."""

    def add(held: np.ndarray, row: tuple[int, int, int, int]) -> np.ndarray:
        mask, n, good, toxic = row
        held[:, mask] += (n, good, toxic)
        return held

    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a += b
        return a

    pairs = counted.rdd.map(lambda r: (r["part"], (r["failed"], r["n"], r["n"] * r["good"], r["n"] * r["toxic"])))
    return pairs.combineByKey(lambda row: add(np.zeros((3, 32), np.int64), row), add, merge)


def orders(part: str, counts: np.ndarray) -> Iterator[tuple]:
    """The rows of a part: each step of each order of the filters."""
    masks = np.arange(32)
    fails = [(masks >> k & 1).astype(bool) for k in range(5)]
    out, removed = [], [0] * 5
    for order in permutations(range(5)):
        gone = np.zeros(32, bool)
        for step, k in enumerate(order, 1):
            here, before = fails[k] & ~gone, gone
            gone = gone | fails[k]
            n, good, toxic = counts[:, here].sum(axis=1).tolist()
            removed[k] += n
            out.append((order, step, k, int(counts[0][~gone].sum()), n, int(counts[0][fails[k] & before].sum()), int(counts[0][1 << k]), good, toxic))
    for order, step, k, *numbers in out:
        yield (part, "".join(FILTERS[i] for i in order), step, *numbers, removed[k])


def filter_audit(docs: DataFrame, labels: DataFrame, bytes_per_partition: int = 48 << 20, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """For each part, order of the filters and step: rows kept, removed here, failed but removed before, failing this filter
    only, good and toxic ones removed here, and what the filter removes in all orders together."""
    found = failures(docs, bytes_per_partition, id_col=id_col, text_col=text_col, part_col=part_col)
    rows = found.groupBy("doc_id", "part", "failed").agg(F.sum("n").alias("n"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))))
    counted = rows.join(marks, "doc_id", "left").select("part", "failed", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return docs.sparkSession.createDataFrame(vectors(counted).flatMap(lambda x: orders(*x)), RESULT, verifySchema=False)
