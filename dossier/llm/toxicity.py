"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are hashes of single words, of their first `STEM` bytes, of neighbouring words and of words with one between them, present or not. Each
coordinate has its own learning rate, and the L1 term leaves most weights at exactly zero, so what is sent to the tasks is
the list of the others, of at most 2^bits entries.

Fitting takes at most `train_rows` labelled documents, those with the smallest hash of their id: online learning is
sequential, and the sample is bounded by this documented parameter whatever the corpus has. Scoring reads every whole text once.

Defined results: null and empty texts have no features and get the score of the bias alone. Labels that are null or
neither 0 nor 1 are left out, labels without a document too; a document with several labels counts once with each. With no labels
every score is 0. Repeated rows are scored each. Very long texts are read whole. Other columns are ignored. An empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialized, nearest_ids, sliced, text_rows
from .terms import FOLD
from .exchange import mixed


STEM = 5


@dataclass(frozen=True)
class Ftrl:
    bits: int = 20
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 6.0
    l2: float = 0.0
    epochs: int = 5
    train_rows: int = 16_000


def grams(raws: list[bytes | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of all words, stems, neighbours and skip-grams of some texts, repeats included."""
    from xxhash import xxh3_64_intdigest

    words, counts = [], []
    for raw in raws:
        own = raw.translate(FOLD).split() if raw else []
        words += own
        counts.append(len(own))
    h = np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))
    doc = np.repeat(np.arange(len(raws)), counts)
    stems = np.fromiter((xxh3_64_intdigest(w[:STEM], 1) for w in words), np.uint64, len(words))
    shift = np.uint64(64 - bits)
    docs, out = [doc, doc], [mixed(h) >> shift, mixed(stems) >> shift]
    with np.errstate(over="ignore"):
        for gap, salt in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
            same = doc[:-gap] == doc[gap:]
            docs.append(doc[:-gap][same])
            out.append(mixed(h[:-gap][same] * np.uint64(salt) + h[gap:][same]) >> shift)
    return np.concatenate(docs), np.concatenate(out).astype(np.int64)


def fit(samples: list[tuple[np.ndarray, int]], how: Ftrl) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) that aren't zero."""
    size = 1 << how.bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    bias = np.array([size])
    l1 = np.full(size + 1, how.l1)
    l1[size] = 0.0

    def weights(at: np.ndarray) -> np.ndarray:
        own = z[at]
        return np.where(np.abs(own) > l1[at], -(own - np.sign(own) * l1[at]) / ((how.beta + np.sqrt(n[at])) / how.alpha + how.l2), 0.0)

    order = np.random.default_rng(7)
    for _ in range(how.epochs):
        for k in order.permutation(len(samples)):
            features, label = samples[k]
            at = np.concatenate([features, bias])
            w = weights(at)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
            new = n[at] + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(n[at])) / how.alpha * w
            n[at] = new
    every = weights(np.arange(size + 1))
    kept = np.flatnonzero(every[:size])
    return kept, every[kept], float(every[size])


def training_sample(docs: DataFrame, labels: DataFrame, label: str, allowed: Column, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, text) of at most `most` different labelled ids of the allowed fold, those with the smallest hash of the id.

    The bound is applied to the labels' ids, so that only texts that are used meet them, by a join with a small side.
    """
    chosen = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("label").isin(0, 1) & allowed)
    return text_rows(docs, id_col, text_col).join(F.broadcast(nearest_ids(chosen, most)), "doc_id")


def packed_features(sample: DataFrame, bits: int) -> list[tuple[np.ndarray, int]]:
    """The training features, hashed by the tasks, one row for each id and label, however often they occur; what comes to the driver
    is bounded by the sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            raws = batch.column("text").cast(pa.binary()).to_pylist()
            packed = [np.unique(grams([raw], bits)[1]).astype("<u4").tobytes() for raw in raws]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array(packed, pa.binary())], ["doc_id", "label", "features"])

    hashed = sample.select("doc_id", "label", "text").mapInArrow(run, "doc_id long, label int, features binary").groupBy("doc_id", "label").agg(F.min("features").alias("features"))
    # one partition after the other, so that the driver doesn't hold them in both of its processes
    held = sorted(((r.doc_id, r.label, np.frombuffer(r.features, "<u4")) for r in materialized(hashed, "features").toLocalIterator()), key=lambda r: r[:2])
    return [(features, label) for _, label, features in held]


def toxicity(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, label: str = "toxic", threshold: float = 0.3, how: Ftrl | None = None) -> DataFrame:
    """(doc_id, score, predicted) of every document, by a model of the labels for which `allowed` holds."""
    how = how or Ftrl()
    samples = packed_features(training_sample(docs, labels, label, F.lit(True) if allowed is None else allowed, how.train_rows), how.bits)
    model = docs.sparkSession.sparkContext.broadcast(fit(samples, how) if samples else None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros(1 << how.bits)
        if model.value:
            dense[model.value[0]] = model.value[1]
        for batch in sliced(batches):
            raws, score = batch.column("text").cast(pa.binary()).to_pylist(), np.zeros(batch.num_rows)
            for k in range(0, len(raws), 512):
                own = raws[k : k + 512]
                doc, feature = grams(own, how.bits)
                used = dense[feature] != 0
                pair = np.unique(doc[used] << how.bits | feature[used])  # present or not
                total = np.bincount(pair >> how.bits, dense[pair & ((1 << how.bits) - 1)], minlength=len(own))
                if model.value:
                    score[k : k + 512] = 1.0 / (1.0 + np.exp(-np.clip(total + model.value[2], -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return text_rows(docs).mapInArrow(run, "doc_id long, score double, predicted int")
