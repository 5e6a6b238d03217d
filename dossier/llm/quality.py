"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are documents labelled good. The corpus itself, whatever its labels, is the unlabelled web text; labels of
bad documents are not read.
With the class prior p, the risk of a scorer g is p R_P(g) + max(0, R_U(-g) - p R_P(-g)): the part for negatives is
estimated from unlabelled text less the positives in it, and is kept from falling below zero, where a flexible model
would start to fit noise. Where it is below zero, a step goes the other way, as the estimator's authors propose.

The prior is estimated from positives and unlabelled text alone, by the best bin: a classifier of the two orders texts, each
by a model that wasn't fitted to it; where only positives are, unlabelled text has the prior's share of the positives'
density, so the prior is the least ratio of the shares of both above some score, with a bound for chance that keeps small
shares from being chosen.

The threshold is set so that the prior's share of the unlabelled sample passes, but at most `positives_lost` of the trusted
positives fail.

The scorer is additive: a text has numeric properties (lengths, shares of symbols, capitals, digits and marks,
repetition of words, word triples and lines, compression), and each is a one-hot bin between quantiles of the sample.

Fitting takes at most `positives` and `unlabelled` documents, those with the smallest hash of their id; both bounds are
parameters. Scoring reads every whole text once, with a model of some hundred numbers.

Defined results: null and empty texts have the properties of a text without words and are scored, too. Labels that are
null or neither 0 nor 1 are left out. Without positives every score is 0.5. Repeated rows are scored each. Very long texts
are read whole. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import nearest_ids, sliced, text_rows
from .quality_rules import SYMBOLS, duplicate_lines, repeated_words

UPPER, DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
MARKS = b"!\"'()+,-./:;=?@[\\]^_`{}~"
PROPERTIES = ("words", "bytes_per_word", "symbols", "capitals", "digits", "marks", "different_words", "commonest_word", "repeated_triples", "repeated_lines", "words_per_line", "compression")


@dataclass(frozen=True)
class NonNegative:
    positives: int = 8_000
    unlabelled: int = 32_000
    bins: int = 12
    steps: int = 1500
    rate: float = 0.05
    l2: float = 1e-4
    positives_lost: float = 0.001


def properties(raw: bytes | None, compress) -> list[float]:
    words = raw.split() if raw else []
    n = len(words)
    if not n:
        return [0.0] * len(PROPERTIES)
    size = len(raw)

    def share(chars: bytes) -> float:
        return (size - len(raw.translate(None, chars))) / size

    counts = Counter(words)
    lines = raw.count(b"\n") + 1
    return [
        np.log1p(n), size / n, share(SYMBOLS), share(UPPER), share(DIGITS), share(MARKS), len(counts) / n, max(counts.values()) / n,
        repeated_words(words) / n, duplicate_lines(raw) / lines, np.log1p(n / lines), np.log(size / len(compress(raw))),
    ]


def with_properties(texts: DataFrame) -> DataFrame:
    """(doc_id, x) of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=1).compress
        for batch in sliced(batches):
            x = [properties(t.as_py(), compress) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "x"])

    return texts.mapInArrow(run, "doc_id long, x array<double>")


class Additive:
    """One-hot bins of each property between quantiles of a sample, and a weight for each bin."""

    def __init__(self, sample: np.ndarray, bins: int) -> None:
        cuts = np.quantile(sample, np.linspace(0, 1, bins + 1)[1:-1], axis=0)
        extremes = np.quantile(sample, [0.01, 0.99], axis=0)
        self.edges = [np.unique(np.concatenate([c, e])) for c, e in zip(cuts.T, extremes.T, strict=True)]
        self.first = np.cumsum([0] + [len(e) + 1 for e in self.edges])
        self.weights = np.zeros(self.first[-1] + 1)

    def active(self, x: np.ndarray) -> np.ndarray:
        """The bins of each row, and the bias."""
        own = [self.first[k] + np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)]
        return np.stack([*own, np.full(len(x), len(self.weights) - 1)], axis=1)

    def margin(self, active: np.ndarray) -> np.ndarray:
        return self.weights[active].sum(axis=1)

    def gradient(self, active: np.ndarray, each: np.ndarray) -> np.ndarray:
        return np.bincount(active.ravel(), np.repeat(each, active.shape[1]), minlength=len(self.weights))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def adam(model: Additive, steps: int, rate: float, l2: float, gradient) -> None:
    m, v = np.zeros_like(model.weights), np.zeros_like(model.weights)
    for t in range(1, steps + 1):
        g = gradient() + l2 * model.weights
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        model.weights -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)


def prior_of(positive: np.ndarray, unlabelled: np.ndarray, how: NonNegative, chance: float = 0.1) -> float:
    """Share of positives in unlabelled text: the least ratio of shares above a score, by scores of models that haven't seen
    the row. Estimates outside 0.05 to 0.95 count as those, as the risk needs both classes."""
    p, u = np.zeros(len(positive)), np.zeros(len(unlabelled))
    model = Additive(np.concatenate([positive, unlabelled]), how.bins)
    of_p, of_u = model.active(positive), model.active(unlabelled)
    for half in (0, 1):
        model.weights[:] = 0
        fp, fu = of_p[1 - half :: 2], of_u[1 - half :: 2]
        if len(fp) and len(fu):
            adam(model, 200, how.rate, 1e-2, lambda: model.gradient(fp, (sigmoid(model.margin(fp)) - 1) / len(fp)) + model.gradient(fu, sigmoid(model.margin(fu)) / len(fu)))
        p[half::2], u[half::2] = model.margin(of_p[half::2]), model.margin(of_u[half::2])
    cuts = np.quantile(p, np.linspace(0, 0.99, 100))
    above_p, above_u = (1 - np.searchsorted(np.sort(x), cuts) / len(x) for x in (p, u))
    bound = np.sqrt(np.log(4 / chance) / 2) * (1 / np.sqrt(len(p)) + 1 / np.sqrt(len(u)))
    best = np.argmin((above_u + bound) / above_p)
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.95))


def risk_gradient(model: Additive, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Slope of the non-negative risk with the logistic loss; where the part for negatives is below zero, of that part away from it."""
    gp, gu = model.margin(p), model.margin(u)
    negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
    d_negative = model.gradient(u, sigmoid(gu) / len(u)) - prior * model.gradient(p, sigmoid(gp) / len(p))
    if negative < 0:
        return -d_negative
    return prior * model.gradient(p, (sigmoid(gp) - 1) / len(p)) + d_negative


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, how: NonNegative) -> Additive:
    """Minimise the non-negative risk."""
    model = Additive(np.concatenate([positive, unlabelled]), how.bins)
    p, u = model.active(positive), model.active(unlabelled)
    adam(model, how.steps, how.rate, how.l2, lambda: risk_gradient(model, p, u, prior))
    # as many unlabelled texts as the prior says pass the threshold of one half, unless trusted positives would fail it
    shift = min(np.quantile(model.margin(u), 1 - prior), np.quantile(model.margin(p), how.positives_lost))
    model.weights[-1] -= max(shift, 0.0)
    return model


def sampled(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Properties of the chosen documents, at the driver: one row for each id, however often it occurs, and ids are bounded by a limit."""
    held = with_properties(docs.join(F.broadcast(ids), "doc_id").select("doc_id", "text")).groupBy("doc_id").agg(F.min("x").alias("x")).collect()
    held.sort(key=lambda r: (r.doc_id, r.x))
    return np.array([r.x for r in held]).reshape(-1, len(PROPERTIES))


def quality(docs: DataFrame, labels: DataFrame, allowed: Column | None = None, label: str = "quality", threshold: float = 0.5, how: NonNegative | None = None) -> DataFrame:
    """(doc_id, score, predicted) of every document, by a model of the labels for which `allowed` holds."""
    how, docs = how or NonNegative(), text_rows(docs)
    allowed = F.lit(True) if allowed is None else allowed
    trusted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where((F.col("label") == 1) & allowed)
    positive = sampled(docs, nearest_ids(trusted.select("doc_id"), how.positives))
    unlabelled = sampled(docs, nearest_ids(docs.select("doc_id").where(allowed), how.unlabelled))
    model = fit(positive, unlabelled, prior_of(positive, unlabelled, how), how) if len(positive) and len(unlabelled) else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress, model = zstandard.ZstdCompressor(level=1).compress, shared.value
        for batch in sliced(batches):
            score = np.full(batch.num_rows, 0.5)
            if model and batch.num_rows:
                x = np.array([properties(t.as_py(), compress) for t in batch.column("text").cast(pa.binary())])
                score = sigmoid(model.margin(model.active(x)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    return docs.mapInArrow(run, "doc_id long, score double, predicted int")
