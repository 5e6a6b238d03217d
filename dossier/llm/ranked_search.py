"""Ranked lexical search by Block-Max WAND.

Each shard, a slice of the rows that a task reads, is an inverted index of its own: texts are not shuffled. Its documents
are numbered in the order of their ids, and the list of each term is cut into blocks of `BLOCK` postings. A block is compressed (gaps and
counts in variable bytes) and stored beside its first and last document and the greatest impact in it, so it can be judged without
being read. Numbers of all documents and terms are counted before, as impacts need them; the weight of a term, which
needs its number of documents, is applied when a query comes, so the index serves any queries.

A search sends the query terms to the index, brings what each shard has of them together by shard, and searches shard
by shard. For a query, the places where the shallow pointer of any of its lists moves to another block cut the shard's
documents into intervals. The sum of the greatest impacts under the pointers bounds every score of an interval, and
intervals below the threshold, the score that a document needs to come into the list, are passed without their blocks
being decompressed. The other ones are read in the order of documents, some at a time, each time raising the threshold.
Some shards go first; the worst score of a query's full list there is a threshold that all other shards start from,
which loses nothing.

Words are runs of ASCII letters and digits and of all other non-ASCII characters, with A-Z in lower case. Scores are
whole numbers: weight * (10^9 tf div (1000 tf + 20 m)), with m = 50 + (50 n N div L).

Queries are a stated set. They are sent in blocks of at most `block_words` words, one search of the index for each.

Defined results: null and empty texts have no terms and are in no list; they don't count in N. Repeated documents are ranked each
by itself, and so are repeated queries, null ids included. Documents without an id come last among equal scores. Queries without
terms, or whose terms no document has, get no rows. Very long texts are indexed whole. Other columns are ignored. An
empty table on either side gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from .common import materialized, remove_path, scratch_path, sliced, text_rows
from .exchange import MB, pack, placed, unpack
from .terms import encoded, tokens, words_of

#: Postings of a block.
BLOCK = 128
INDEX = "shard long, term binary, n_docs int, first array<int>, last array<int>, most array<long>, blocks array<binary>"


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    with_terms = all_terms = 0
    for part in sliced(batches):
        _, first, _, doc = tokens(part.column("text"))
        with_terms, all_terms = with_terms + len(np.unique(doc)), all_terms + len(first)
    yield pa.RecordBatch.from_arrays([pa.array([with_terms]), pa.array([all_terms])], ["docs", "terms"])


# ---------------------------------------------------------------- compressed blocks


def varints(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, number of bytes of each value): seven bits a byte, the lowest first, the top bit set where more follow."""
    left = values.astype(np.uint64)
    size = np.ones(len(left), np.int64)
    for k in range(1, 10):
        size += left >= np.uint64(1 << (7 * k))
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        at = np.flatnonzero(size > k)
        out[start[at] + k] = (left[at] >> np.uint64(7 * k) & np.uint64(127)).astype(np.uint8) | np.where(size[at] > k + 1, 128, 0).astype(np.uint8)
    return out, size


def unvarints(raw: np.ndarray) -> np.ndarray:
    ends = np.flatnonzero(raw < 128) + 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    shift = 7 * (np.arange(len(raw)) - np.repeat(starts, ends - starts))
    return np.add.reduceat((raw & 127).astype(np.int64) << shift, starts) if len(ends) else np.zeros(0, np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def lengths_m(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of n terms; Python's integers, as the product may pass 64 bits."""
    return np.array([50 + (50 * x * n_docs) // max(n_terms, 1) for x in n.tolist()], np.int64)


def blocks_of(code: np.ndarray, doc: np.ndarray, tf: np.ndarray, impact: np.ndarray, n_codes: int) -> dict[str, pa.Array]:
    """The columns of the index for postings in the order of term and document."""
    df = np.bincount(code, minlength=n_codes)
    place = np.arange(len(code)) - np.repeat(np.cumsum(df) - df, df)
    starts = np.flatnonzero(place % BLOCK == 0)
    ends = np.append(starts[1:], len(code))
    gaps = np.diff(doc, prepend=0)
    gaps[starts] = doc[starts]
    both = np.empty(2 * len(code), np.int64)
    both[::2], both[1::2] = gaps, tf
    raw, size = varints(both)
    edges = np.zeros(len(starts) + 1, np.int32)
    if len(starts):
        np.cumsum(np.add.reduceat(size, 2 * starts), out=edges[1:])
    lists = np.zeros(n_codes + 1, np.int32)
    np.cumsum(-(-df // BLOCK), out=lists[1:])
    blocks = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(raw)])
    most = np.maximum.reduceat(impact, starts) if len(starts) else impact
    inner = {"first": pa.array(doc[starts], pa.int32()), "last": pa.array(doc[ends - 1] if len(starts) else doc, pa.int32()), "most": pa.array(most, pa.int64()), "blocks": blocks}
    return {"n_docs": pa.array(df, pa.int32())} | {k: pa.ListArray.from_arrays(pa.array(lists), v) for k, v in inner.items()}


def indexing(n_docs: int, n_terms: int, shard_bytes: int):
    """Arrow work: the rows of the index of each slice, and one without a term that holds ids and lengths of its documents."""
    schema = pa.schema([("shard", pa.int64()), ("term", pa.binary()), ("n_docs", pa.int32()), ("first", pa.list_(pa.int32())), ("last", pa.list_(pa.int32())), ("most", pa.list_(pa.int64())), ("blocks", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, size=shard_bytes):
            ids = part.column("doc_id")
            known = pc.is_valid(ids).to_numpy(zero_copy_only=False)
            order = np.lexsort((pc.fill_null(ids, 0).to_numpy(), ~known))
            number = np.empty(len(order), np.int64)
            number[order] = np.arange(len(order))
            data, first, end, doc = tokens(part.column("text"))
            terms, code = encoded(data, first, end)
            pair, tf = np.unique(code.astype(np.int64) * len(order) + number[doc], return_counts=True)
            code, doc_of = pair // max(len(order), 1), pair % max(len(order), 1)
            n = np.bincount(number[doc], minlength=len(order))
            made = blocks_of(code, doc_of, tf, impacts(tf, lengths_m(n, n_docs, n_terms)[doc_of]), len(terms))
            shard = part.column("place")[0]
            yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()] * len(terms), pa.int64()), terms, *(made[k] for k in schema.names[2:])], schema=schema)
            own = pa.array([[pack(pc.fill_null(ids, 0).to_numpy()[order]), np.packbits(known[order]).tobytes(), pack(n)]], pa.list_(pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()], pa.int64()), pa.nulls(1, pa.binary()), pa.array([len(order)], pa.int32()), *(pa.nulls(1, schema.field(k).type) for k in ("first", "last", "most")), own], schema=schema)

    return run


# ---------------------------------------------------------------- search in one shard


class Postings:
    """The list of one term in a shard; blocks are decompressed when asked for, and once."""

    def __init__(self, n_docs: int, first: np.ndarray, last: np.ndarray, most: np.ndarray, blocks: list[bytes], m: np.ndarray) -> None:
        self.first, self.last, self.most, self.blocks, self.m = first, last, most, blocks, m
        self.doc, self.impact, self.read = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64), np.zeros(len(blocks), bool)

    def at(self, wanted: np.ndarray) -> np.ndarray:
        """The places of the postings of some blocks, which are decompressed if they weren't before."""
        size = np.full(len(self.blocks), BLOCK)
        size[-1] = len(self.doc) - BLOCK * (len(self.blocks) - 1)
        fresh = wanted[~self.read[wanted]]
        if len(fresh):
            values = unvarints(np.frombuffer(b"".join(self.blocks[b] for b in fresh), np.uint8))
            gaps, tf, n = values[::2], values[1::2], size[fresh]
            ends = np.cumsum(n)
            total = np.cumsum(gaps)
            own = self._places(fresh, n)
            self.doc[own] = total - np.repeat(np.concatenate([[0], total[ends[:-1] - 1]]), n)
            self.impact[own] = impacts(tf, self.m[self.doc[own]])
            self.read[fresh] = True
        return self._places(wanted, size[wanted])

    @staticmethod
    def _places(blocks: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.arange(int(n.sum())) + np.repeat(blocks * BLOCK - np.cumsum(n) + n, n)


def intervals(lists: list[tuple[int, Postings]], n_docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(first documents of the intervals in which no shallow pointer moves, greatest possible score in each)"""
    edges = np.unique(np.concatenate([[0, n_docs], *(x for _, p in lists for x in (p.first, p.last + 1))]))
    most = np.zeros(len(edges) - 1, np.int64)
    for weight, p in lists:
        block = np.minimum(np.searchsorted(p.last, edges[:-1]), len(p.last) - 1)
        under = (p.first[block] <= edges[:-1]) & (edges[:-1] <= p.last[block])
        most += np.where(under, weight * p.most[block], 0)
    return edges, most


def best(lists: list[tuple[int, Postings]], n_docs: int, k: int, least: int, at_once: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k best ones that score `least` or more; of equal ones those with the smaller number."""
    edges, most = intervals(lists, n_docs)
    score, doc, need, start = np.zeros(0, np.int64), np.zeros(0, np.int64), max(least, 1), 0
    while start < len(most):
        live = start + np.flatnonzero(most[start:] >= need)[:at_once]
        if not len(live):
            break
        start, at_once = int(live[-1]) + 1, 2 * at_once
        total = np.zeros(n_docs, np.int64)
        for weight, p in lists:
            block = np.searchsorted(p.last, edges[live])
            ok = block < len(p.last)
            block = block[ok]
            block = np.unique(block[p.first[block] <= edges[live][ok]])
            if len(block):
                own = p.at(block)
                total[p.doc[own]] += weight * p.impact[own]
        inside = np.zeros(n_docs + 1, np.int64)
        np.add.at(inside, edges[live], 1)
        np.add.at(inside, edges[live + 1], -1)
        found = np.flatnonzero((total >= need) & (np.cumsum(inside[:-1]) > 0))
        score, doc = np.concatenate([score, total[found]]), np.concatenate([doc, found])
        top = np.lexsort((doc, -score))[:k]
        score, doc = score[top], doc[top]
        if len(score) == k:  # documents that follow have larger numbers and must do better
            need = max(need, int(score[-1]) + 1)
    return doc, score


def searching(shared: Broadcast, k: int, n_docs: int, n_terms: int):
    """Arrow work: (item, doc_id, score) of the best documents of one shard for all queries of a block."""

    def run(rows: pa.Table) -> pa.Table:
        terms = rows.column("term").to_pylist()
        own = terms.index(None)
        ids, known, n = rows.column("blocks")[own].as_py()
        ids, n = unpack(ids), unpack(n)
        known = np.unpackbits(np.frombuffer(known, np.uint8), count=len(ids)).astype(bool)
        m = lengths_m(n, n_docs, n_terms)
        cols = {c: rows.column(c) for c in ("n_docs", "first", "last", "most", "blocks")}
        lists: dict[bytes, Postings] = {}
        for row, term in enumerate(terms):
            if term is not None:
                first, last, most = (np.array(cols[c][row].values.to_numpy(zero_copy_only=False), np.int64) for c in ("first", "last", "most"))
                lists[term] = Postings(cols["n_docs"][row].as_py(), first, last, most, cols["blocks"][row].as_py(), m)
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for item, (weights, least) in shared.value.items():
            if asked := [(w, lists[t]) for t, w in weights.items() if w > 0 and t in lists]:
                doc, score = best(asked, len(ids), k, least)
                out.append((np.full(len(doc), item), doc, score))
        item, doc, score = (np.concatenate(x).astype(np.int64) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"item": pa.array(item), "doc_id": pa.array(ids[doc], pa.int64(), mask=~known[doc]), "score": pa.array(score)})

    return run


# ---------------------------------------------------------------- index and search


class LexicalIndex:
    """An index in the shared folder, and what its impacts were made with: the numbers of documents and of terms."""

    def __init__(self, spark: SparkSession, path: str, n_docs: int, n_terms: int) -> None:
        self.spark, self.path, self.n_docs, self.n_terms = spark, path, n_docs, n_terms

    @classmethod
    def built(cls, docs: DataFrame, path: str, shard_bytes: int = 8 * MB, id_col: str = "doc_id", text_col: str = "text") -> LexicalIndex:
        texts, place = placed(text_rows(docs, id_col, text_col))
        n_docs, n_terms = texts.select("text").mapInArrow(counted, "docs long, terms long").agg(F.coalesce(F.sum("docs"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
        texts.select("doc_id", "text", place.alias("place")).mapInArrow(indexing(n_docs, n_terms, shard_bytes), INDEX).write.parquet(path)
        return cls(docs.sparkSession, path, n_docs, n_terms)

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df + 1)))

    def search(self, items: DataFrame, k: int = 50, item_col: str = "item_id", text_col: str = "text", block_words: int = 2_000_000, pilot: int = 16) -> DataFrame:
        """(item_id, rank, doc_id, score) of the k best documents for each row of items. One of `pilot` shards goes first."""
        spark, kind, done = self.spark, items.schema[item_col].dataType, []
        for block in queries(items, item_col, text_col, block_words):
            found = self._block([terms for _, terms in block], k, pilot)
            names = spark.createDataFrame([(n, item) for n, (item, _) in enumerate(block)], T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", kind)]))
            best_first = W.Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
            ranked = found.withColumn("rank", F.row_number().over(best_first)).where(F.col("rank") <= k)
            ranked = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
            done.append(ranked if len(block) and not done else materialized(ranked, "ranked"))
        out = done[0]
        for df in done[1:]:
            out = out.union(df)
        return out

    def _block(self, block: list[set[bytes]], k: int, pilot: int) -> DataFrame:
        """(item, doc_id, score): the best documents of each shard, of which none of the k best of all is missing."""
        spark = self.spark
        words = sorted(set().union(*block))
        asked = F.broadcast(spark.createDataFrame([(bytearray(w),) for w in words], "term binary"))
        index = spark.read.schema(INDEX).parquet(self.path)
        hits = index.join(asked, "term", "left_semi")
        df = {bytes(r[0]): r[1] for r in hits.groupBy("term").agg(F.sum(F.col("n_docs").cast("long"))).collect()}
        weights = [{t: self.weight(df[t]) for t in terms if t in df} for terms in block]
        rows, first = hits.unionByName(index.where(F.col("term").isNull())), F.pmod(F.xxhash64("shard"), F.lit(pilot)) == 0

        def searched(some: DataFrame, least: dict[int, int], name: str) -> DataFrame:
            shared = spark.sparkContext.broadcast({n: (w, least.get(n, 1)) for n, w in enumerate(weights) if w})
            return materialized(some.groupBy("shard").applyInArrow(searching(shared, k, self.n_docs, self.n_terms), "item long, doc_id long, score long"), name)

        ahead = searched(rows.where(first), {}, "ahead")
        full = ahead.withColumn("rank", F.row_number().over(W.Window.partitionBy("item").orderBy(F.desc("score")))).where(F.col("rank") == k)
        least = {r[0]: r[1] for r in full.select("item", "score").collect()}
        return ahead.union(searched(rows.where(~first), least, "best"))


def queries(items: DataFrame, item_col: str, text_col: str, block_words: int) -> Iterator[list[tuple[object, set[bytes]]]]:
    """The queries with their different terms in blocks, at least one; one block is held at a time."""
    block: list[tuple[object, set[bytes]]] = []
    size, some = 0, False
    for item, text in items.select(F.col(item_col), F.col(text_col).cast("string")).toLocalIterator():
        if terms := set(words_of((text or "").encode())):
            if block and size + len(terms) > block_words:
                yield block
                block, size, some = [], 0, True
            block.append((item, terms))
            size += len(terms)
    if block or not some:
        yield block


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", shard_bytes: int = 8 * MB, block_words: int = 2_000_000) -> DataFrame:
    """The k best documents for each row of items, by an index that lives as long as the search. The shards' lists are written to the
    shared folder, so the result doesn't read the index any more."""
    path = scratch_path(docs.sparkSession, "lexical")
    index = LexicalIndex.built(docs, path, shard_bytes, id_col, text_col)
    out = index.search(items, k, item_col, item_text, block_words)
    remove_path(docs.sparkSession, path)
    return out
