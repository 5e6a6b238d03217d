import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.llm import substring_dedup as substring_module
from dossier.llm.components import connected_components
from dossier.llm.esa import maximal_repeats
from dossier.llm.exchange import pack, pack_sorted, unpack, unpack_sorted
from dossier.llm.simhash import fingerprint, near_duplicates, one_of_each
from dossier.llm.substring_dedup import KEPT, FingerprintIndex, Keys, in_run, mark_known, merged, pack_run, run_parts, substring_dedup, substring_dedup_rows, unpack_run
from dossier.llm.suffix_dedup import Anchored, reaches, repeat_groups, suffix_dedup

from .fixtures import docs, prose, texts


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# ---------------------------------------------------------------- codecs


@given(st.lists(st.integers(0, 2**64 - 1)))
def test_sorted_codec(values):
    x = np.sort(np.array(values, np.uint64))
    assert (unpack_sorted(pack_sorted(x)) == x).all()


@given(st.lists(st.integers(-(2**63), 2**63 - 1)))
def test_codec(values):
    x = np.array(values, np.int64)
    assert (unpack(pack(x)) == x).all()


# ---------------------------------------------------------------- word windows


def brute_words(rows, window):
    owner = {}
    key = lambda i: 1 << 70 if i is None else i
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            owner[g] = min(owner.get(g, 1 << 71), key(i))
    out = []
    for i, t in rows:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if owner[tuple(w[k : k + window])] < key(i):
                gone[k : k + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window,batches,chunk_bytes", [(13, 4, 4 << 20), (13, 1, 2000), (13, 7, 2000), (6, 3, 3000)])
def test_substring_dedup(spark, window, batches, chunk_bytes):
    rows = texts()
    got = substring_dedup(docs(spark, rows), window=window, batches=batches, chunk_bytes=chunk_bytes).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert as_rows(got) == brute_words(rows, window)


def test_two_windows_with_one_first_hash():
    """The second hash tells them apart, in a batch, in a run and in what is sent."""
    a, b = np.array([5, 9, 5, 5], np.uint64), np.array([1, 2, 7, 1], np.uint64)
    keys = Keys(a, b)
    assert keys.first.tolist() == [5, 5, 9] and keys.second.tolist() == [1, 7, 2]
    assert keys.late(np.array([3, 3, 3, 8]), np.array([False, False, True])).tolist() == [False, True, False, True]
    run = unpack_run(pack_run(np.array([5, 5, 9], np.uint64), np.array([1, 7, 3], np.uint64)))
    assert in_run(keys.first, keys.second, *run).tolist() == [True, True, False]


def test_parts_of_a_run(monkeypatch):
    """However many rows a bucket of a run has, its windows are known."""
    rng = np.random.default_rng(2)
    own, theirs = (Keys(rng.integers(0, 900, 500, dtype=np.uint64), rng.integers(0, 2, 500, dtype=np.uint64)) for _ in range(2))
    pairs = set(zip(theirs.first.tolist(), theirs.second.tolist(), strict=True))
    for part in (1, 7, 1 << 16):
        monkeypatch.setattr(substring_module, "PART", part)
        known = np.zeros(len(own.first), bool)
        for raw in run_parts(theirs.first, theirs.second):
            mark_known(own, raw, known)
        assert known.tolist() == [p in pairs for p in zip(own.first.tolist(), own.second.tolist(), strict=True)]


def test_substring_dedup_empty(spark):
    assert substring_dedup(docs(spark, []), 13).count() == 0
    assert substring_dedup_rows(docs(spark, []), 13).count() == 0


def test_rows_keep_their_columns_and_unchanged_texts(spark):
    rows = texts()
    got = substring_dedup_rows(docs(spark, rows))
    assert got.columns == docs(spark, rows).columns
    kept = {(r.doc_id, r.text) for r in got.collect()}
    brute = {r[0]: r for r in brute_words(rows, 13)}
    for i, t in rows:
        whole = len((t or "").split())
        if brute[i][2] == 0:
            assert (i, t) in kept
        elif brute[i][2] == whole:
            assert not any(k[0] == i for k in kept)
    assert all(r.chunk == "x" and r.bucket == 7 and r.payload == "y" for r in got.collect())


def test_index_by_batches(spark, tmp_path):
    """Batches in the order of ids give what the whole corpus gives; compaction changes nothing."""
    rows = [r for r in texts() if r[0] is not None]
    rows = sorted({r[0]: r for r in rows}.values())
    index = FingerprintIndex(spark, str(tmp_path / "index"), window=13, n_buckets=8)
    got = []
    for k in range(0, len(rows), 7):
        index = FingerprintIndex(spark, str(tmp_path / "index"), window=13, n_buckets=8)
        got += as_rows(index.add(docs(spark, rows[k : k + 7]), chunk_bytes=4000).select("doc_id", "n_words", "n_removed", "kept_sha256"))
    assert sorted(got, key=repr) == brute_words(rows, 13)
    assert 2 <= len(index.runs()) <= 3 and index.runs()[0].first == 0
    last = index.runs()[-1].last
    with pytest.raises(ValueError, match="in the index"):
        index.add(docs(spark, rows[:3]), batch=last)
    index.compact()
    assert [(r.first, r.last) for r in index.runs()] == [(0, last)]
    again = index.add(docs(spark, [(10_000 + i, t) for i, t in rows]), batch=last + 1).collect()
    assert all(r.n_removed == r.n_words or r.n_words < 13 for r in again)


def test_buckets_split_when_the_index_grows(spark, tmp_path):
    """A second batch of more than fifty times the first, and history beyond its bound: more buckets, the same rows; in a folder with a
    quotation mark in its name."""
    rows = sorted({r[0]: r for r in texts() if r[0] is not None}.values())
    first = [r for r in rows if r[0] < 2]
    folder = str(tmp_path / "it's an index")
    got = as_rows(FingerprintIndex(spark, folder, n_buckets=2).add(docs(spark, first), chunk_bytes=4000).select("doc_id", "n_words", "n_removed", "kept_sha256"))
    index = FingerprintIndex(spark, folder)
    assert index.n_buckets() == 2
    got += as_rows(index.add(docs(spark, [r for r in rows if r[0] >= 2]), chunk_bytes=1000).select("doc_id", "n_words", "n_removed", "kept_sha256"))
    assert sorted(got, key=repr) == brute_words(rows, 13) and index.n_buckets() >= 32
    small = FingerprintIndex(spark, folder, bucket_bytes=1000)
    again = small.add(docs(spark, [(10_000, rows[5][1])]), chunk_bytes=1 << 20).collect()
    assert again[0].n_removed == again[0].n_words and small.n_buckets() >= 64 and len(small.runs()) == 2


def test_the_two_hashes_of_a_window_are_independent():
    """Words whose first halves collide differ in the second hash: it is made from other bits."""
    import pyarrow as pa

    from dossier.llm.substring_dedup import Windows

    words = [f"w{k}" for k in range(4000)]
    w = Windows(pa.table({"doc_id": [1], "text": [" ".join(words)]}), 1)
    from xxhash import xxh3_128_digest

    halves = np.frombuffer(b"".join(xxh3_128_digest(x.encode()) for x in words), ">u8").reshape(-1, 2).astype(np.uint64)
    assert (w.first == w._sums(halves[:, 0], 2)).all() and (w.second == w._sums(halves[:, 1], 3) >> np.uint64(40)).all()
    high, low = (w.first >> np.uint64(63)).astype(int), (w.second >> np.uint64(23)).astype(int)
    assert abs(np.corrcoef(high, low)[0, 1]) < 0.06


def test_runs_are_read_where_they_are(spark, tmp_path):
    """History is not shuffled: a bucket of all runs is read by one task."""
    index = FingerprintIndex(spark, str(tmp_path / "index"), n_buckets=4)
    for k in range(2):
        index.add(docs(spark, [(k, prose(random.Random(k), 60))]))
    with index._tables(index.runs()) as tables:
        plan = index._rows(tables).groupBy("bucket").applyInArrow(merged, KEPT)
        assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_columns_of_any_name(spark):
    names = ["_", "c0", "chunk", "rest", "changed", "bucket", "_row_", "doc_id", "text"]
    text = prose(random.Random(3), 40)
    df = spark.createDataFrame([(*"abcdefg", i, text) for i in (1, 2)], ", ".join(f"`{n}` string" for n in names[:7]) + ", doc_id long, text string")
    got = substring_dedup_rows(df).collect()
    assert [tuple(r) for r in got] == [(*"abcdefg", 1, text)]


# ---------------------------------------------------------------- byte strings


def brute_bytes(rows, least):
    count = Counter()
    raws = [(i, (t or "").encode()) for i, t in rows]
    for _, b in raws:
        count.update(b[k : k + least] for k in range(len(b) - least + 1))
    out = []
    for i, b in raws:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - least + 1):
            if count[b[k : k + least]] > 1:
                gone[k : k + least] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((i, len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("least,hot,chunk_bytes", [(400, 2000, 4 << 20), (400, 2000, 6000), (400, 1, 6000), (100, 3, 9000), (64, 2000, 5000)])
def test_suffix_dedup(spark, least, hot, chunk_bytes):
    rows = texts()
    got = suffix_dedup(docs(spark, rows), least=least, hot=hot, chunk_bytes=chunk_bytes).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert as_rows(got) == brute_bytes(rows, least)


def test_suffix_dedup_empty(spark):
    assert suffix_dedup(docs(spark, [])).count() == 0
    assert repeat_groups(docs(spark, [])).count() == 0


@pytest.mark.parametrize("hot", [2000, 1])
def test_repeat_groups(spark, hot):
    """A group's places all hold the same string, no other place holds it, and together the groups cover what is removed."""
    rows = sorted({r[0]: r for r in texts() if r[0] is not None and r[0] != 41}.values())
    raws = {i: (t or "").encode() for i, t in rows}
    groups = {}
    for r in repeat_groups(docs(spark, rows), least=300, hot=hot, chunk_bytes=6000).collect():
        groups.setdefault((r.repeat_id, r.length), set()).add((r.doc_id, r.start))
    cover = {i: np.zeros(len(b), bool) for i, b in raws.items()}
    for (_, n), places in groups.items():
        held = {raws[i][a : a + n] for i, a in places}
        assert len(held) == 1 and n >= 300
        body, every = held.pop(), set()
        for i, b in raws.items():
            at = b.find(body)
            while at >= 0:
                every.add((i, at))
                at = b.find(body, at + 1)
        assert places == every and len(every) > 1
        for i, a in places:
            cover[i][a : a + n] = True
    want = {r[0]: r[2] for r in brute_bytes(rows, 300)}
    assert {i: int(c.sum()) for i, c in cover.items()} == want and sum(want.values()) > 5000


def test_copies_in_many_chunks_are_one_context(spark):
    """A text that all chunks have is no reason to leave the interval tree: its groups are as long as in few chunks."""
    rng = random.Random(12)
    text = prose(rng, 200)
    rows = [(i, text) for i in range(60)]
    few, many = (
        {(r.repeat_id, r.length, r.doc_id, r.start) for r in repeat_groups(docs(spark, rows), least=300, hot=hot, chunk_bytes=2000).collect()} for hot in (2000, 3)
    )
    assert few == many and max(r[1] for r in many) > 300 and len({r[2] for r in many}) == 60


@pytest.mark.parametrize("hot,chunk_bytes", [(2000, 4 << 20), (2000, 9000), (1, 9000)])
def test_groups_are_the_maximal_repeats(spark, hot, chunk_bytes):
    """Whole copies of 10 KB, passages with other surroundings, a passage twice in a text, and a short one within a long one."""
    rng = random.Random(21)
    whole, passage, inner = prose(rng, 1800), prose(rng, 150), prose(rng, 70)
    long = f"{prose(rng, 200)} {inner} {prose(rng, 200)}"
    bodies = ["{w}", "{w}", "{x}{w}", "{x}{p}{y}", "{p}{x}", "{x}{p}{y}{p}", "{x}{l}", "{l}{y}", "{x}{i}{y}"]
    rows, marks = [], iter("ABCDEFGHIJKLMNOPQRSTUVXYZ!?+-,.;:/()=$%&")
    for k, body in enumerate(bodies):  # bytes that no other place has keep surroundings from agreeing by chance
        own = {c: next(marks) + prose(rng, 50) + next(marks) for c in "xy"}
        rows.append((k, body.format(w=whole, p=passage, i=inner, l=long, **own)))
    assert len(whole.encode()) > 10_000
    want = {(n, tuple(sorted((rows[t][0], s) for t, s in at))) for n, at in maximal_repeats([t.encode() for _, t in rows], 300)}
    got = {}
    for r in repeat_groups(docs(spark, rows), least=300, hot=hot, chunk_bytes=chunk_bytes).collect():
        got.setdefault((r.repeat_id, r.length), []).append((r.doc_id, r.start))
    found = {(n, tuple(sorted(at))) for (_, n), at in got.items()}
    # where every context is split into windows, a repeat is told without the windows that have more occurrences
    assert found == want if hot > 1 else {x for x in want if x[1][0][0] < 6} <= found


def test_places_in_blocks():
    """However a buffer is cut into blocks, its windows have the same anchors."""
    import pyarrow as pa

    rng = random.Random(4)
    table = pa.table({"doc_id": [1, 2, 3], "text": [prose(rng, 900), prose(rng, 20), prose(rng, 500)]})
    whole, cut = Anchored(table, 100, segment=1500), Anchored(table, 100, segment=1500, block=4000)
    for name in ("lo", "hi", "at", "key"):
        assert (getattr(whole, name) == getattr(cut, name)).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=24), min_size=1, max_size=4))
def test_maximal_repeats(raw):
    """Against all substrings: those that occur twice and can't be extended, with every place."""
    bodies = [t.encode() for t in raw]
    places = {}
    for t, b in enumerate(bodies):
        for i in range(len(b)):
            for j in range(i + 2, len(b) + 1):
                places.setdefault(b[i:j], []).append((t, i))
    want = set()
    for s, at in places.items():
        if len(at) > 1:
            left = {bodies[t][i - 1 : i] or (t, i) for t, i in at}
            right = {bodies[t][i + len(s) : i + len(s) + 1] or (t, i) for t, i in at}
            if (len(left) > 1) and (len(right) > 1):
                want.add((len(s), tuple(sorted(at))))
    assert {(n, tuple(p)) for n, p in maximal_repeats(bodies, 2)} == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.text("ab", max_size=6), st.text("ab", max_size=6)), min_size=2, max_size=8, unique=True))
def test_cover_is_that_of_all_pairs(pairs):
    from os.path import commonprefix

    rights, lefts = [r.encode() for r, _ in pairs], [x.encode() for _, x in pairs]
    want = {}
    for i in range(len(pairs)):
        for j in range(len(pairs)):
            right, left = len(commonprefix([rights[i], rights[j]])), len(commonprefix([lefts[i], lefts[j]]))
            if i != j and left + right >= 5:
                a, b = want.get(i, (0, 0))
                want[i] = (max(a, left), max(b, right))
    assert reaches(list(zip(rights, lefts, strict=True)), [False] * len(pairs), 5) == want


# ---------------------------------------------------------------- fingerprints


def brute_print(text, size=3):
    import xxhash

    w = (text or "").encode().lower().split()
    own = [b" ".join(w[k : k + size]) for k in range(len(w) - size + 1)] if len(w) >= size else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_groups(rows, radius):
    """The number of each row's group."""
    fp = [brute_print(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fp[i] ^ fp[j]).bit_count() <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(k) for k in range(len(rows))]


def brute_components(rows, radius):
    group = brute_groups(rows, radius)
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        least[g] = i if least.get(g) is None else least[g] if i is None else min(least[g], i)
    return sorted(((i, f"{brute_print(t):016x}", least[g]) for (i, t), g in zip(rows, group, strict=True)), key=repr)


def test_one_of_each(spark):
    """Of repeated rows and of rows without an id one stays, too."""
    rows = [*texts(), (None, "no id " * 30), (None, "alone and without an id"), (None, "alone and without an id")]
    df = docs(spark, rows).withColumn("row", F.lit("mine"))
    got = one_of_each(df)
    assert got.columns == df.columns
    best = {}
    for (i, t), g in zip(rows, brute_groups(rows, 2), strict=True):
        key = (i is None, i or 0)
        best[g] = min(best.get(g, (key, i, t)), (key, i, t), key=lambda x: x[0])
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(((i, t) for _, i, t in best.values()), key=repr)


@pytest.mark.parametrize("cap", [64, 1])
def test_near_duplicates(spark, cap):
    rng, rows = random.Random(5), texts()
    base = rows[12][1].split()
    for i in range(60, 90):  # a chain of small changes
        base[rng.randrange(len(base))] = f"c{i}"
        rows.append((i, " ".join(base)))
    got = near_duplicates(docs(spark, rows), cell_cap=cap).select("doc_id", "fingerprint", "component_id")
    assert as_rows(got) == brute_components(rows, 2)


def test_near_duplicates_empty(spark):
    assert near_duplicates(docs(spark, [])).count() == 0


def test_blocks_of_a_long_text():
    rng = random.Random(2)
    text = " ".join(f"w{rng.randrange(500)}" for _ in range(70_000))
    assert fingerprint(text.encode(), 3, 42) % (1 << 64) == brute_print(text)


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (102, 100), (7, 7)] + [(200, k) for k in range(201, 240)]
    got = dict(connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in (100, 101, 102)} == {100} and {got[k] for k in range(200, 240)} == {200}
