"""Terms of texts: runs of ASCII letters and digits and of all other non-ASCII characters, with A-Z in lower case."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes that separate terms become spaces, A-Z become a-z.
FOLD = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
FOLDED = np.frombuffer(FOLD, np.uint8)
IS_TERM = FOLDED != 32


def words_of(raw: bytes) -> list[bytes]:
    return raw.translate(FOLD).split()


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, first and end byte of each term, the text that it is in) of an Arrow array of texts."""
    raw = pc.fill_null(texts.cast(pa.binary()), b"")
    edges = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]]
    edges = (edges - edges[0]).astype(np.int64)
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = IS_TERM[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    # a term never goes on in the next text
    begins[edges] = inside[edges]
    cut = edges[edges > 0] - 1
    ends[cut] = inside[cut]
    first, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return FOLDED[data], first, end, np.searchsorted(edges, first, side="right") - 1


def encoded(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(the different terms, the number of each term in turn)"""
    offsets = np.zeros(len(first) + 1, np.int64)
    np.cumsum(end - first, out=offsets[1:])
    marks = np.zeros(len(data) + 1, np.int8)
    marks[first] += 1
    marks[end] -= 1
    packed = np.ascontiguousarray(data[np.cumsum(marks[:-1], dtype=np.int8) > 0])
    got = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
    return got.dictionary.cast(pa.binary()), got.indices.to_numpy()
