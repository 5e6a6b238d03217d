import zlib
from collections import defaultdict

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from dossier.llm.packing import WordIds, fullest, minimum_slack, pack, slots

from .fixtures import docs, texts

PATH = str(public_tokenizers.path("word_bpe_49k.json"))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 20), st.integers(1, 4), max_size=6), st.integers(0, 40))
def test_fullest(counts, room):
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * k for s in sums for k in range(n + 1)}
    best = max(s for s in sums if s <= room)
    got = fullest(counts, room)
    assert sum(got) == best and all(got.count(k) <= counts[k] for k in got)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 32), st.integers(1, 50), min_size=1))
def test_plan_uses_every_piece_once(histogram):
    plan = minimum_slack(histogram, 32)
    used = defaultdict(int)
    for lengths, times in plan:
        assert sum(lengths) <= 32 and times > 0
        for k in lengths:
            used[k] += times
    assert used == histogram
    ranks = defaultdict(list)
    for length, first, end, *_ in slots(plan):
        ranks[length] += range(first, end)
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in histogram.items()}


@pytest.fixture(scope="module")
def words():
    return WordIds(PATH)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("abzABZ éßÑΣσİ1²½ .,!'*-\n\t ́你<|>") , max_size=40), max_size=5))
def test_ids_are_those_of_the_tokenizer(words, bodies):
    for text, ids in zip(bodies, words.encode_many(bodies), strict=True):
        assert ids.tolist() == words.whole.encode(text, add_special_tokens=False).ids


def test_special_strings_and_small_tables(words):
    bodies = ["x<|endoftext|>y <|startoftext|>", "don't we'll 'tis O'Neil's rock'n'roll", "A  B", "Σας ΣΑΣ", " ", "a" * 500 + " b"] * 3 + [t for _, t in texts() if t]
    small = WordIds(PATH, max_words=50, slice_chars=200)
    for text, a, b in zip(bodies, words.encode_many(bodies), small.encode_many(bodies), strict=True):
        want = words.whole.encode(text, add_special_tokens=False).ids
        assert a.tolist() == want and b.tolist() == want


@pytest.mark.parametrize("capacity", [2048, 100])
def test_pack(spark, words, capacity):
    rows = texts()
    got = pack(docs(spark, rows), PATH, capacity=capacity, rows_per_salt=5).collect()
    ids = [(i, [*words.whole.encode(t or "", add_special_tokens=False).ids, 0]) for i, t in rows]
    want = []
    for i, own in ids:
        for piece, start in enumerate(range(0, len(own), capacity)):
            part = own[start : start + capacity]
            want.append((i, piece, start, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(len(own) for _, own in ids)
    assert len(bins) <= -(-total // capacity) + 1


def test_pack_empty(spark):
    assert pack(docs(spark, []), PATH).count() == 0
