"""Chunks and hash buckets: how operators on windows of all texts meet each other's windows.

Documents are dealt to chunks of a bounded number of bytes. A chunk sends sorted arrays of 64-bit hashes, cut by hash
range, to buckets; a bucket merges the arrays of all chunks and answers each chunk with the hashes that concern it. A
hash that is frequent, however hot, is sent at most once by each chunk, so nothing depends on how often it occurs. Rows
are packed arrays: sorted hashes are stored as differences, 6 bytes each.

The chunk number is a hash of the row's place in its file, so a lost task is computed anew with the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialized

MB = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads them evenly."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def pack_sorted(x: np.ndarray) -> bytes:
    """A rising uint64 array as differences of 5, 6 or 8 bytes, as the largest one needs."""
    gaps = np.diff(x, prepend=np.uint64(0)).astype("<u8")
    most = int(gaps[1:].max()) if len(gaps) > 1 else 0
    width = next(k for k in (5, 6, 8) if most >> (8 * k) == 0)
    return bytes([width]) + x[:1].astype("<u8").tobytes() + gaps[1:].view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack_sorted(raw: bytes) -> np.ndarray:
    if len(raw) == 1:
        return np.zeros(0, np.uint64)
    short = np.frombuffer(raw, np.uint8, offset=9).reshape(-1, raw[0])
    wide = np.zeros((len(short) + 1, 8), np.uint8)
    wide[1:, : raw[0]] = short
    wide[0] = np.frombuffer(raw, np.uint8, 8, 1)
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def parts(*raw: bytes) -> bytes:
    return b"".join(len(p).to_bytes(4, "little") + p for p in raw)


def unparts(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "little")
        out.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def pack(x: np.ndarray) -> bytes:
    """Integers of any range: the least one and the rest in as few bytes as the spread needs."""
    low = int(x.min()) if len(x) else 0
    spread = int(x.max()) - low if len(x) else 0
    kind = next(k for k in (1, 2, 4, 8) if spread < 1 << (8 * k))
    return bytes([kind]) + low.to_bytes(8, "little", signed=True) + (x.astype(np.int64).view(np.uint64) - np.int64(low).view(np.uint64)).astype(f"<u{kind}").tobytes()


def unpack(raw: bytes) -> np.ndarray:
    low = np.int64(int.from_bytes(raw[1:9], "little", signed=True))
    return (np.frombuffer(raw, f"<u{raw[0]}", offset=9).astype(np.uint64) + low.view(np.uint64)).view(np.int64)


def by_bucket(rising: np.ndarray, n_buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of each part of a rising array of hashes that falls into one bucket; its cost follows the array."""
    if not len(rising):
        return []
    bucket = ((rising >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)
    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(rising)]
    return list(zip(bucket[edges[:-1]].tolist(), edges[:-1], edges[1:], strict=True))


def chunk_plan(docs: DataFrame, chunk_bytes: int, least: int = 24) -> tuple[int, int]:
    """(chunks, buckets) for the bytes of all texts."""
    return sizes(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, chunk_bytes, least)


def sizes(total: int, chunk_bytes: int, least: int = 24, per_bucket: int = 4) -> tuple[int, int]:
    """(chunks, buckets) for so many bytes, with some chunks for each bucket. Chunks have chunk_bytes up to 800 GB of text; from there on eight times that at most, as each chunk writes to many buckets."""
    size = min(max(chunk_bytes, total // 200_000), 8 * chunk_bytes)
    n_chunks = max(least, -(-total // size))
    return n_chunks, max(least, n_chunks // per_bucket)


def placed(df: DataFrame) -> tuple[DataFrame, Column]:
    """df, and a hash of each row's place in its files: the same in every reading and after a lost task, and different for equal
    rows. What doesn't come from files is written to the shared folder first."""
    try:
        place = df.metadataColumn("_metadata")
        df.select(place.getField("row_index"))
    except AnalysisException:
        df = materialized(df, "input")
        place = df.metadataColumn("_metadata")
    return df, F.xxhash64(place.getField("file_path"), place.getField("row_index"))


def chunked(docs: DataFrame, n_chunks: int, row: str | None = None) -> DataFrame:
    """(chunk, doc_id, text): rows are dealt by their places, so that equal rows, however many, don't meet in one chunk.
    With `row`, a column of that name has the place itself."""
    docs, place = placed(docs)
    return docs.select(F.pmod(place, F.lit(n_chunks)).cast("int").alias("chunk"), "doc_id", "text", *([place.alias(row)] if row else []))


def rows(columns: dict[str, tuple[list, pa.DataType]]) -> pa.Table:
    return pa.table({k: pa.array(v, t) for k, (v, t) in columns.items()})


def scatter(chunks: DataFrame, work: Callable[[int, pa.Table, pa.Table | None], list[tuple[int, bytes]]], returned: DataFrame | None = None) -> DataFrame:
    """(bucket, chunk, payload) rows that work makes of a chunk's texts and, if given, of what was returned to it."""
    schema = "bucket int, chunk int, payload binary"

    def sent(chunk: int, texts: pa.Table, answers: pa.Table | None) -> pa.Table:
        got = work(chunk, texts, answers)
        return rows({"bucket": ([b for b, _ in got], pa.int32()), "chunk": ([chunk] * len(got), pa.int32()), "payload": ([p for _, p in got], pa.binary())})

    if returned is None:
        return chunks.groupBy("chunk").applyInArrow(lambda key, table: sent(key[0].as_py(), table, None), schema)
    return chunks.groupBy("chunk").cogroup(returned.groupBy("chunk")).applyInArrow(lambda key, texts, answers: sent(key[0].as_py(), texts, answers), schema)


def gather(sent: DataFrame, work: Callable[[list[int], list[bytes]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """(chunk, payload) rows that work makes of one bucket's (chunk, payload) rows."""

    def answered(table: pa.Table) -> pa.Table:
        got = list(work(table.column("chunk").to_pylist(), table.column("payload").to_pylist())) if table.num_rows else []
        return rows({"chunk": ([c for c, _ in got], pa.int32()), "payload": ([p for _, p in got], pa.binary())})

    return sent.groupBy("bucket").applyInArrow(answered, "chunk int, payload binary")


def member(x: np.ndarray, rising: np.ndarray) -> np.ndarray:
    """Which of x are in a rising array."""
    if not len(rising):
        return np.zeros(len(x), bool)
    return rising[np.minimum(np.searchsorted(rising, x), len(rising) - 1)] == x
