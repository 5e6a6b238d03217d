import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dossier.llm.online_packing import OpenWindows, merged, pack_online, powers, size
from dossier.llm.packing import WordIds

from .fixtures import docs, texts

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


def piece(doc, n):
    return doc, 0, np.arange(n, dtype="<u4"), n


def whole(windows):
    """Each document's ids, put together from its pieces."""
    found = defaultdict(list)
    for doc, start, ids, _ in (p for w in windows for p in w):
        found[doc].append((start, ids.tolist()))
    out = {}
    for doc, own in found.items():
        own.sort()
        assert all(a[0] + len(a[1]) == b[0] for a, b in zip(own, own[1:]))
        out[doc] = [x for _, ids in own for x in ids]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 90), max_size=60), st.integers(1, 5))
def test_windows(lengths, most):
    state = OpenWindows(32, most)
    for doc, n in enumerate(lengths):
        state.put(piece(doc, n))
        assert len(state.held) == len(state.gaps) <= most
        assert sorted(32 - size(w) for w in state.held.values()) == [g for g, _ in state.gaps]
    assert all(size(w) == 32 for w in state.done)
    full, rest = merged(list(state.held.values()), 32)
    assert all(size(w) == 32 for w in full) and size(rest) < 32
    tail = powers(rest)
    assert [size(w) for w in tail] == [1 << k for k in range(5, -1, -1) if size(rest) >> k & 1]
    everything = state.done + full + tail
    assert all(len(p[2]) for w in everything for p in w)
    assert whole(everything) == {doc: list(range(n)) for doc, n in enumerate(lengths)}


def test_best_fit_and_the_fullest_leaves():
    state = OpenWindows(10, 2)
    for doc, n in enumerate((6, 5, 4)):  # the third fills the first, although the second has room, too
        state.put(piece(doc, n))
    assert [[p[0] for p in w] for w in state.done] == [[0, 2]]
    state.put(piece(3, 7))  # a free place: nothing is cut
    assert len(state.done) == 1
    state.put(piece(4, 8))  # none fits: the fullest, with 7, gets the first 3, the rest fills the one with 5
    assert [[(p[0], p[1], len(p[2])) for p in w] for w in state.done[1:]] == [[(3, 0, 7), (4, 0, 3)], [(1, 0, 5), (4, 3, 5)]]


@pytest.mark.parametrize(("capacity", "windows", "fan"), [(2048, 32, 64), (64, 3, 2), (100, 1, 3)])
def test_round_trip(spark, capacity, windows, fan):
    rows = texts()
    got = pack_online(docs(spark, rows), PATH, capacity=capacity, end_id=1, windows=windows, fan=fan).collect()
    tokenizer = WordIds(PATH).whole
    want = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t in rows)
    by_doc, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for doc, own in by_doc.items():
        same = [ids for (i, ids), n in want.items() if i == doc for _ in range(n)]
        assert sum(r.length for r in own) == sum(map(len, same))
        for r in own:  # repeated rows have the same pieces or other ones, but each piece is one of the text
            assert r.length > 0 and any(len(ids) == r.doc_tokens and zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4")) == r.ids_crc32 for ids in same)
        places = Counter(p for r in own for p in range(r.start, r.start + r.length))
        assert places == Counter(p for ids in same for p in range(len(ids)))
    lengths = []
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        lengths.append(at)
    short = [n for n in lengths if n != capacity]
    assert all(n <= capacity for n in lengths) and all(n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)


def test_empty_table(spark):
    assert pack_online(docs(spark, []), PATH).count() == 0
