"""Rule-based quality filter whose verdict comes from zstandard compression bands.

A text is judged twice. The whole document has a compression ratio (bytes over compressed bytes), and so has each
fixed-size chunk of it. Repetitive text compresses too well, random text hardly at all, and what is usual depends on
the length, since a short input pays for the frame and a long one profits from its own history. Each band therefore
states the least and the greatest ratio for texts of its length. Whole documents are held against the band of their
length, chunks against the band of the chunk size. Where bytes remain behind the last whole chunk, one more chunk ends at
the text's end and shares bytes with the one before, so that every byte is judged; a document is kept if its own ratio is inside and at most
`max_bad_chunks` of its chunks (as a share) are outside.

Defined results: a null text has no words, no lines and no ratio (null) and fails the base rules; so does an empty
text. A very long text is compressed whole; chunks are views into it. Repeated rows are judged each by itself. Other
columns of the input are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import kept_rows, sliced, text_rows

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long, reason string"
)
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """limits: (texts of fewer bytes than this, least ratio, greatest ratio), rising; None is without end."""

    level: int = 3
    chunk_bytes: int = 4096
    max_bad_chunks: float = 0.5
    limits: tuple[tuple[int | None, float, float], ...] = field(
        default=((300, 0.40, 2.30), (1000, 1.05, 2.20), (3000, 1.20, 2.35), (10_000, 1.35, 2.50), (40_000, 1.45, 2.70), (None, 1.50, 3.00))
    )

    def of(self, n_bytes: int) -> tuple[float, float]:
        return next((lo, hi) for end, lo, hi in self.limits if end is None or n_bytes < end)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a 3-word window that is found twice or more in the text, the first one included."""
    n = len(words)
    if n < 4:
        return 0
    codes: dict[bytes, int] = {}
    c = np.fromiter((codes.setdefault(w, len(codes)) for w in words), np.int64, n)
    m = len(codes)
    if m < 2_000_000:
        key = (c[:-2] * m + c[1:-1]) * m + c[2:]
    else:
        pair = np.unique(c[:-1] * m + c[1:], return_inverse=True)[1].astype(np.int64)
        key = pair[:-1] * m + c[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    hit = np.zeros(n - 2, bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(n, bool)
    cover[:-2] |= hit
    cover[1:-1] |= hit
    cover[2:] |= hit
    return int(cover.sum())


def duplicate_lines(raw: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in raw:
        return 0
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def judged(bands: Bands):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=bands.level).compress
        names = [c.strip().split()[0] for c in SCHEMA.split(",")]
        types = [pa.int64()] * 6 + [pa.bool_(), pa.bool_(), pa.float64(), pa.int64(), pa.int64(), pa.string()]
        for batch in sliced(batches):
            ids, out = batch.column("doc_id"), []
            for text in batch.column("text").cast(pa.binary()):
                out.append(_row(text.as_py(), bands, compress))
            if out:
                cols = [ids, *(list(c) for c in zip(*out, strict=True))]
                yield pa.RecordBatch.from_arrays([c if i == 0 else pa.array(c, t) for i, (c, t) in enumerate(zip(cols, types, strict=True))], names)

    return run


def _row(raw: bytes | None, bands: Bands, compress) -> tuple:
    if raw is None:
        return 0, 0, 0, 0, 0, True, False, None, 0, 0, "too_few_words"
    words = raw.split()
    n = len(words)
    chars = len(str(b"".join(words), "utf-8"))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    repeat = repeated_words(words)
    failed = n < 50 or 100 * repeat > 50 * n
    ratio = len(raw) / len(compress(raw)) if raw else None
    view, size = memoryview(raw), bands.chunk_bytes
    starts = [*range(0, len(raw) - size, size), len(raw) - size] if len(raw) > size else ()
    low, high = bands.of(size)
    bad = 0
    for s in starts:
        bad += not low <= size / len(compress(view[s : s + size])) <= high
    reason = "too_few_words" if n < 50 else "repeated_words" if failed else None
    if reason is None:
        low, high = bands.of(len(raw))
        if ratio > high:
            reason = "repetitive"
        elif ratio < low:
            reason = "incompressible"
        elif starts and bad > bands.max_bad_chunks * len(starts):
            reason = "bad_chunks"
    return n, chars, symbols, duplicate_lines(raw), repeat, failed, reason is None, ratio, len(starts), bad, reason


def quality_rules(docs: DataFrame, bands: Bands | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the base counts, both verdicts, the ratio and the first reason for rejection.

    One pass over the texts without a shuffle; each task holds one Arrow batch.
    """
    return text_rows(docs, id_col, text_col).mapInArrow(judged(bands or Bands()), SCHEMA)


def filtered(docs: DataFrame, bands: Bands | None = None) -> DataFrame:
    """The documents that pass, with all their columns."""
    rules = bands or Bands()

    def judge(parts: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
        import zstandard

        compress = zstandard.ZstdCompressor(level=rules.level).compress
        for part in parts:
            yield part, pa.array([_row(t.as_py(), rules, compress)[6] for t in part.column(text).cast(pa.binary())], pa.bool_())

    return kept_rows(docs, "text", judge)
