import random
import re

import pyarrow as pa
import pytest

from dossier.llm.decontamination import Searched, Shard, ShardSuffixes, clean, decontaminate

from .fixtures import docs, texts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def items(rows):
    words = (rows[10][1] or "").split()
    passage = rows[24][1].split()
    return [(1, " ".join(words[:14])), (1, "repeated id"), (2, " ".join(passage[35:50]).upper()), (3, "One Two, three"), (4, None), (5, "..."), (6, "nothing of this is anywhere in the texts at all it seems"), (7, "again"), (None, " ".join(passage[50:62]))]


def brute(rows, bench, window=10):
    grams = {}
    for i, t in bench:
        w = WORD.findall((t or "").translate(LOW))
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[k : k + n]), set()).add(None if i is None else str(i))
    out = []
    for i, t in rows:
        w = WORD.findall((t or "").translate(LOW))
        hit, found = set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if own := grams.get(tuple(w[k : k + n])):
                    hit |= set(range(k, k + n))
                    found |= own
        out.append((i, len(w), len(hit), sorted(found - {None})))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_words", [2_000_000, 20])
def test_decontaminate(spark, block_words):
    rows = texts()
    bench = spark.createDataFrame(items(rows), "item_id long, text string")
    got = decontaminate(docs(spark, rows), bench, block_words=block_words)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got.collect()), key=repr) == brute(rows, items(rows))


def test_matches_are_longest_and_verbatim(spark):
    rows = texts()
    bench = items(rows)
    got = decontaminate(docs(spark, rows), spark.createDataFrame(bench, "item_id long, text string")).collect()
    held = {i: WORD.findall((t or "").translate(LOW)) for i, t in rows}
    told = 0
    for r in got:
        for m in r.matches:
            own = [WORD.findall((t or "").translate(LOW)) for i, t in bench if (None if i is None else str(i)) == m.item_id]
            part = held[r.doc_id][m.doc_start : m.doc_start + m.n_words]
            assert any(w[m.item_start : m.item_start + m.n_words] == part for w in own)
            told += 1
    assert told > 5


def test_suffix_array():
    """All places, in the order of the words that follow; a search gives every place that agrees."""
    rng = random.Random(8)
    docs = [" ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))).encode() for _ in range(9)]
    array = ShardSuffixes(pa.array([d.decode() for d in docs]), 4)
    following = [array.codes[p : p + 4].tolist() for p in array.order.tolist()]
    assert following == sorted(following) and sorted(array.order.tolist()) == list(range(len(array.codes)))
    searched = Searched([("x", b"a b c a"), ("y", b"c c"), ("z", b"d a")], 4)
    first, last = array.range_of(array.codes_of(searched), searched)
    words = [d.decode().split() for d in docs]
    want = [sum(w[k : k + len(q)] == q for w in words for k in range(len(w))) for q in (["a", "b", "c", "a"], ["c", "c"], ["d", "a"])]
    assert (last - first).tolist() == want and want[1] > 0


@pytest.mark.parametrize("block_words", [2_000_000, 20])
def test_clean_and_empty(spark, block_words):
    rows = texts()
    bench = spark.createDataFrame(items(rows), "item_id long, text string")
    kept = sorted((r.doc_id for r in clean(docs(spark, rows), bench, block_words=block_words).collect()), key=repr)
    assert kept == sorted((i for i, _, n, _ in brute(rows, items(rows)) if not n), key=repr)
    none = spark.createDataFrame([], "item_id long, text string")
    assert clean(docs(spark, rows), none).count() == len(rows)
    assert decontaminate(docs(spark, []), bench).count() == 0


def maximal_cover(words, item, window):
    """Which words of a text an item hits, and whether a match is one, as long as it can be on both sides."""
    need = min(window, len(item))
    hit = {p for k in range(len(words) - need + 1) for j in range(len(item) - need + 1) if words[k : k + need] == item[j : j + need] for p in range(k, k + need)}

    def maximal(a, b, n):
        inside = words[a : a + n] == item[b : b + n] and n >= need
        left = not a or not b or words[a - 1] != item[b - 1]
        right = a + n == len(words) or b + n == len(item) or words[a + n] != item[b + n]
        return inside and left and right

    return hit, maximal


@pytest.mark.parametrize("seed", range(8))
def test_matches_of_repetitive_texts(spark, seed):
    """One or two words repeated in texts and items: hits by brute force, and maximal matches that cover just these."""
    rng = random.Random(seed)
    some = lambda n: [rng.choice("aaab" if seed % 2 else "ab") for _ in range(n)]
    texts_ = [some(rng.randrange(0, 60)) for _ in range(6)] + [["a"] * 70, []]
    items_ = [some(rng.randrange(1, 30)) for _ in range(3)] + [["a"] * 25, ["a", "b"] * 9, ["b"]]
    frame = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts_)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items_)], "item_id long, text string")
    for r in decontaminate(frame, bench, window=6).collect():
        words, every = texts_[r.doc_id], set()
        for i, item in enumerate(items_):
            hit, maximal = maximal_cover(words, item, 6)
            mine = [m for m in r.matches if m.item_id == str(i)]
            assert {p for m in mine for p in range(m.doc_start, m.doc_start + m.n_words)} == hit
            assert all(maximal(m.doc_start, m.item_start, m.n_words) for m in mine) and len(mine) <= len(words)
            every |= hit
        assert r.n_hit == len(every)


def test_one_word_of_eight_megabytes():
    """Work and memory follow text and item, not their product."""
    import resource
    import time

    began, before = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    searched = Searched([("x", b"a " * 1000), ("y", b"a " * 400 + b"b")], 10)
    shard = Shard(pa.array(["a " * (4 << 20), "a b"]), searched, 10)
    assert time.time() - began < 60 and (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024 < 600
    assert shard.spans == [[{"start": 0, "end": 4 << 20}], []]
    longest = [m for m in shard.matches[0] if m["item_id"] == "x"]
    assert {m["n_words"] for m in longest[:-1]} == {1000} and len(longest) < 4300 and sum(1 for m in shard.matches[0] if m["item_id"] == "y") > 10_000
