"""SimHash near-duplicates: popcounts of segments as an embedding, a grid range-join, exact verification.

The fingerprint's 64 bits form 32 segments of two. The popcounts of the segments embed a fingerprint in a grid of 32
dimensions, and the Manhattan distance there never exceeds the number of differing bits. Written in unary (0, 1, 2 as
00, 01, 11), the popcounts fill 64 bits again, so that their Manhattan distance is the bit count of an exclusive or.

Two points at distance r (up to 2) or less differ in at most r of r + 3 groups of dimensions, so they share a grid cell in
some projection to three of the groups. The join on those cells keeps pairs by Manhattan distance and verifies them by
the bits. A cell of more than `cell_cap` fingerprints isn't joined with itself: its fingerprints are linked through
common neighbours at one bit, 65 rows each, which finds the same links without pairs. Only different fingerprints take
part; copies are counted at their fingerprint and come back at the end.

Defined results: null, empty and white-space texts have fingerprint zero and are linked like others. Repeated rows come
back each. A null id has the component of its fingerprint; component_id is the smallest id that isn't null. Very long
texts are hashed whole, in blocks. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialized, remove_path, scratch_path, sliced, text_rows
from .components import connected_components
from .exchange import placed

LOW = 0x5555555555555555


def fingerprint(raw: bytes | None, shingle: int, seed: int) -> int:
    """Signed 64 bits: each is 1 if it is set in over half of the shingles' hashes."""
    from xxhash import xxh64_intdigest

    words = raw.lower().split() if raw else []
    if not words:
        return 0
    size = min(shingle, len(words))
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts, stops = (ends - lens)[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist()
    n, ones = len(starts), np.zeros(64, np.int64)
    for k in range(0, n, 65_536):
        cut = [joined[a:b] for a, b in zip(starts[k : k + 65_536], stops[k : k + 65_536], strict=True)]
        hashes = np.fromiter(map(xxh64_intdigest, cut, repeat(seed)), "<u8", len(cut))
        ones += bit_sums(hashes)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def bit_sums(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit; summed in bytes, 255 hashes at a time."""
    bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
    whole = len(bits) // 255 * 255
    out = bits[whole:].sum(0, dtype=np.int64)
    if whole:
        out += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
    return out


def fingerprints(texts: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """The rows with fp LONG, of the whole text, instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raws = batch.column("text").cast(pa.binary())
            made = pa.array([fingerprint(t.as_py(), shingle, seed) for t in raws], pa.int64())
            others = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), made], [*others, "fp"])

    return texts.mapInArrow(run, texts.drop("text").schema.add("fp", "long"))


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def embedded(fp: Column) -> Column:
    """The popcounts of the two-bit segments, in unary."""
    low, above = F.lit(LOW), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(above).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(above).bitwiseAND(low), 1))


def group_masks(groups: int) -> list[int]:
    """Bits of each group of whole segments; neighbours in different groups."""
    return [sum(3 << (2 * s) for s in range(g, 32, groups)) for g in range(groups)]


def linked(fps: DataFrame, path: str, radius: int = 2, cell_cap: int = 64) -> DataFrame:
    """(a, b) links that connect all different fingerprints with `radius` or fewer differing bits, directly or in steps. What
    fingerprints share cells is written to the path and read from there."""
    if not 0 <= radius <= 2:
        raise ValueError("radius must be 0, 1 or 2")
    masks = group_masks(radius + 3)
    cells = [F.struct(F.lit(c).cast("byte").alias("c"), F.col("u").bitwiseAND(F.lit(signed(reduce(int.__or__, own)))).alias("at")) for c, own in enumerate(combinations(masks, 3))]
    at_cells = fps.select("fp", embedded(F.col("fp")).alias("u")).select("fp", "u", F.explode(F.array(*cells)).alias("cell")).select("cell.c", "cell.at", "fp", "u")
    counted = at_cells.groupBy("c", "at").agg(F.count("*").alias("n")).where("n > 1")
    at_cells.join(counted, ["c", "at"]).write.parquet(path)
    met = fps.sparkSession.read.parquet(path)
    small = met.where(F.col("n") <= cell_cap)
    x, y = small.alias("x"), small.alias("y")
    near = (
        (F.col("x.c") == F.col("y.c"))
        & (F.col("x.at") == F.col("y.at"))
        & (F.col("x.fp") < F.col("y.fp"))
        & (F.bit_count(F.col("x.u").bitwiseXOR(F.col("y.u"))) <= radius)
        & (F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= radius)
    )
    pairs = x.join(y, near).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    crowd = met.where(F.col("n") > cell_cap).select("fp").distinct()
    return pairs.union(midpoints(crowd, radius))


def midpoints(fps: DataFrame, radius: int) -> DataFrame:
    """Links of fingerprints through what both are at most radius / 2 bits (rounded up for one of them) away from."""
    flips = [F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64))]
    if radius == 0:
        return fps.select(F.col("fp").alias("a"), F.col("fp").alias("b")).limit(0)
    if radius == 1:
        near = fps.select("fp", F.explode(F.array(*flips[1:])).alias("b"))
        return near.join(fps.select(F.col("fp").alias("b")), "b").select(F.col("fp").alias("a"), "b")
    around = fps.select("fp", F.explode(F.array(*flips)).alias("mid"))
    hubs = around.groupBy("mid").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    return around.join(hubs, "mid").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def grouped(texts: DataFrame, radius: int, shingle: int, seed: int, cell_cap: int) -> tuple[DataFrame, DataFrame]:
    """The rows with their fingerprints instead of texts; and (fp, least, root): for each fingerprint the smallest id, and the
    smallest fingerprint reachable."""
    made = materialized(fingerprints(texts, shingle, seed), "fingerprints")
    fps = made.groupBy("fp").agg(F.min("doc_id").alias("least"))
    spark, cells = texts.sparkSession, scratch_path(texts.sparkSession, "cells")
    links = connected_components(linked(fps.select("fp"), cells, radius, cell_cap))
    remove_path(spark, cells)
    return made, fps.join(links.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42, cell_cap: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every document."""
    made, placed_fps = grouped(text_rows(docs, id_col, text_col), radius, shingle, seed, cell_cap)
    smallest = placed_fps.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed_fps.join(smallest, "root").select("fp", "component_id")
    text = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return made.join(named, "fp").select("doc_id", "fp", text.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, radius: int = 2, shingle: int = 3, seed: int = 42, cell_cap: int = 64) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns: that with the smallest doc_id (null is larger than every
    id), of repeated rows any one. Rows are told apart by their places in the input."""
    name = next(n for n in ("row", *(f"row{k}" for k in range(len(docs.columns)))) if n not in docs.columns)
    docs, place = placed(docs)
    keyed = docs.select("*", place.alias(name))
    texts = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col(name).alias("row"))
    made, fps = grouped(texts, radius, shingle, seed, cell_cap)
    # copies collapse before anything is joined, so that a fingerprint of many rows is one row
    first = made.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row")).alias("first"))
    kept = first.join(fps.select("fp", "root"), "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias(name))
    return keyed.join(kept, name, "left_semi").select(*docs.columns)
