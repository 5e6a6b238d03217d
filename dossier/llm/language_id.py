"""Language identification by nearest centroids.

A text is a normalised TF-IDF vector of hashed character n-grams (one to three letters, word edges included). Each
language has several centroids, found by spherical k-means over a sample of its documents, and a text gets the language
of the centroid with the greatest cosine. Each centroid also has a radius: a text farther from it than nearly all of its
own sample is marked as rejected (the nearest language is given all the same, as a result needs one).

Document frequencies are counted over all documents of the learning fold. The sample for the centroids is bounded:
`per_language` documents of each language and `sample` in all, or one of each language if there are more, chosen by the hash of the
id at a rate that follows from the language's count. Every value of lang is learned, each in a task of its own. Centroids are sent to
all tasks in blocks of `block` of them; with several blocks there is one pass over the texts for each, and the best of them counts.

Defined results: null texts and texts without a letter are `und` with score 0. Texts of a null language are not learned
from. With no known language every text is `und`. Repeated rows are judged each. Very long texts are read whole, in
blocks. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import materialized, sliced
from .exchange import mixed, placed

#: Whether a code point below 0x3000 is a letter; the scripts above count as letters.
LETTER = np.array([chr(i).isalpha() for i in range(0x3000)] + [True])


@dataclass(frozen=True)
class Centroids:
    dims: int = 4096
    per_language: int = 1_200
    sample: int = 20_000
    clusters: int = 4
    rounds: int = 12
    reject: float = 0.001
    block: int = 2_048


def gram_counts(texts: list[str], dims: int, block: int = 1_000_000) -> np.ndarray:
    """Counts of hashed n-grams, one row for each text; a long text in blocks of characters."""
    out = np.zeros((len(texts), dims), np.float32)
    held: list[tuple[int, str]] = []
    size = 0
    for k, text in enumerate(texts):
        for at in range(0, len(text), block):
            part = text[at : at + block]
            if held and size + len(part) > block:
                add_counts(out, held)
                held, size = [], 0
            held.append((k, part))
            size += len(part)
    if held:
        add_counts(out, held)
    return out


def add_counts(out: np.ndarray, held: list[tuple[int, str]]) -> None:
    dims = out.shape[1]
    joined = "".join(f" {part.lower()} " for _, part in held)
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    codes = np.where(LETTER[np.minimum(codes, 0x3000)], codes, 32).astype(np.uint64)
    lens = np.array([len(part.lower()) + 2 for _, part in held])
    row = np.repeat(np.arange(len(held)), lens)
    letter = codes != 32
    # the middle of three stays a letter, so no gram spans two words
    ones = letter
    twos = letter[:-1] | letter[1:]
    threes = letter[1:-1] & (letter[:-2] | letter[2:])
    with np.errstate(over="ignore"):
        pair = codes[:-1] * np.uint64(0x110000) + codes[1:]
        triple = pair[:-1] * np.uint64(0x110000) + codes[2:]
    counts = np.zeros(len(held) * dims)
    for grams, keep, rows, salt in ((codes, ones, row, 1), (pair, twos, row[:-1], 2), (triple, threes, row[:-2], 3)):
        with np.errstate(over="ignore"):
            at = mixed(grams[keep] + np.uint64(salt << 60)) % np.uint64(dims)
        counts += np.bincount(rows[keep] * dims + at.astype(np.int64), minlength=len(counts))
    np.add.at(out, [k for k, _ in held], counts.reshape(len(held), dims).astype(np.float32))


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = counts * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


def k_means(x: np.ndarray, clusters: int, rounds: int) -> np.ndarray:
    """Spherical k-means from rows far from each other; empty clusters go."""
    centres = x[[0]]
    while len(centres) < min(clusters, len(x)):
        nearest = (x @ centres.T).max(axis=1)
        if nearest.min() > 1 - 1e-6:
            break
        centres = np.vstack([centres, x[[nearest.argmin()]]])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(axis=1)
        sums = np.stack([x[own == k].sum(axis=0) for k in range(len(centres))])
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = (sums / np.where(norm > 0, norm, 1))[norm[:, 0] > 0]
    return centres


def document_frequencies(docs: DataFrame, dims: int) -> tuple[np.ndarray, int]:
    """(documents with each gram, documents), counted over all rows: summed by the tasks and then by gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dims, np.int64), 0
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            for k in range(0, len(texts), 256):
                total += (gram_counts([t or "" for t in texts[k : k + 256]], dims) > 0).sum(axis=0)
            n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, dims)), pa.array(np.concatenate([[n], total]))], ["gram", "n"])

    counted = dict(docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n")).collect())
    return np.array([counted.get(k, 0) for k in range(dims)], np.float64), counted.get(-1, 0)


#: Languages whose counts are sent to all tasks; more are joined as a table.
SENT = 100_000


def learning_sample(docs: DataFrame, how: Centroids) -> DataFrame:
    """(lang, text) of a bounded number of rows of each language: a hash rate of a little more first, so no window holds a whole
    language."""
    counts = docs.groupBy("lang").count()
    n_languages = counts.count()
    per = max(1, min(how.per_language, how.sample // max(n_languages, 1)))
    rate = F.least(F.lit(1 << 30), F.floor(F.lit((3 * per + 16) << 30) / (2 * F.col("count"))))
    near = docs.join(F.broadcast(counts) if n_languages <= SENT else counts, "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate)
    order = W.Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    return near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= per).select("lang", "text")


def weights(df: np.ndarray, n: int) -> np.ndarray:
    """The root of the usual weight, for plain counts: in a text of two languages the longer part decides."""
    return np.sqrt(np.log((1 + n) / (1 + df)) + 0.1).astype(np.float32)


def fit(docs: DataFrame, how: Centroids) -> tuple[np.ndarray, DataFrame]:
    """(weights, (lang, centre, radius) of the centroids of each language) from (doc_id, text, lang) rows. Each language is clustered
    by one task, from at most `per_language` rows, and the table is written to the shared folder."""
    import zlib

    idf = weights(*document_frequencies(docs, how.dims))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            packed = [zlib.compress(gram_counts([t], how.dims)[0].astype("<u4").tobytes(), 1) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(packed, pa.binary())], ["lang", "counts"])

    def clustered(rows: pa.Table) -> pa.Table:
        packed = sorted(rows.column("counts").to_pylist())
        x = vectors(np.stack([np.frombuffer(zlib.decompress(p), "<u4") for p in packed]).astype(np.float32), idf)
        x = x[x.any(axis=1)]  # a text without a letter tells nothing
        own = k_means(x, how.clusters, how.rounds) if len(x) else x
        near = x @ own.T
        mine = [near[near.argmax(axis=1) == k, k] for k in range(len(own))]
        radius = [float(np.quantile(m, how.reject)) if len(m) else 0.0 for m in mine]
        return pa.table({"lang": pa.array(rows.column("lang").to_pylist()[:1] * len(own), pa.string()), "centre": pa.array([c.astype("<f4").tobytes() for c in own], pa.binary()), "radius": pa.array(radius, pa.float64())})

    held = learning_sample(docs, how).mapInArrow(run, "lang string, counts binary")
    return idf, materialized(held.groupBy("lang").applyInArrow(clustered, "lang string, centre binary, radius double"), "centroids")


def blocks(centroids: DataFrame, most: int) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
    """(languages, centres, radii) of some centroids at a time, at least once."""
    held, some = [], False
    for row in centroids.orderBy("lang", "centre").toLocalIterator():
        if len(held) == most:
            yield unpacked(held)
            held, some = [], True
        held.append(row)
    if held or not some:
        yield unpacked(held)


def unpacked(rows: list) -> tuple[list[str], np.ndarray, np.ndarray]:
    return [r.lang for r in rows], np.stack([np.frombuffer(r.centre, "<f4") for r in rows]) if rows else np.zeros((0, 0), np.float32), np.array([r.radius for r in rows])


def nearest(shared: Broadcast, dims: int):
    """Arrow work: the best centroid of a block for each text, beside all columns but the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, (langs, centres, radius) = shared.value
        for batch in sliced(batches):
            texts, lang, score, away = batch.column("text").to_pylist(), ["und"] * batch.num_rows, np.zeros(batch.num_rows), [True] * batch.num_rows
            for k in range(0, len(texts) if langs else 0, 256):
                own = [t or "" for t in texts[k : k + 256]]
                counts = gram_counts(own, dims)
                near = vectors(counts, idf) @ centres.T
                for j in np.flatnonzero(counts.any(axis=1)):
                    if any(c.isalpha() for c in own[j]):
                        best = int(near[j].argmax())
                        lang[k + j], score[k + j], away[k + j] = langs[best], min(max(float(near[j, best]), 0.0), 1.0), bool(near[j, best] < radius[best])
            others = [c for c in batch.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), pa.array(lang), pa.array(score), pa.array(away)], [*others, "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, allowed: Column | None = None, how: Centroids | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every document, learned from the rows for which `allowed` holds."""
    how = how or Centroids()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    idf, centroids = fit(rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.lit(True) if allowed is None else allowed)), how)
    context, texts, result = docs.sparkSession.sparkContext, rows.select("doc_id", "text"), "doc_id long, lang_pred string, score double, rejected boolean"
    if centroids.count() <= how.block:
        return texts.mapInArrow(nearest(context.broadcast((idf, next(blocks(centroids, how.block)))), how.dims), result)
    texts, place = placed(texts)
    texts, done = texts.select("doc_id", place.alias("place"), "text"), []
    for block in blocks(centroids, how.block):
        shared = context.broadcast((idf, block))
        done.append(materialized(texts.mapInArrow(nearest(shared, how.dims), result.replace(", ", ", place long, ", 1)), "nearest"))
        shared.destroy()
    every = done[0]
    for df in done[1:]:
        every = every.union(df)
    # a row is told by its id and place; of equal scores the first language in order counts, as in one block
    best = F.min_by(F.struct("lang_pred", "score", "rejected"), F.struct(-F.col("score"), F.col("lang_pred") == "und", "lang_pred"))
    return every.groupBy("doc_id", "place").agg(best.alias("x")).select("doc_id", "x.*")
