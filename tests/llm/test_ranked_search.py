import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from dossier.llm.ranked_search import LexicalIndex, Postings, best, blocks_of, encoded, impacts, lengths_m, ranked_search, tokens, unvarints, varints

from .fixtures import docs, texts

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def brute(rows, items, k):
    own = [(i, Counter(t)) for i, text in rows if (t := terms(text))]
    n_docs, n_terms = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(x for _, c in own for x in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in own:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[x] + 1))) * ((1000000000 * c[x]) // (1000 * c[x] + 20 * m)) for x in set(terms(text)) if c[x])
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def items(rows):
    word = (rows[30][1] or "").split()
    return [(1, " ".join(word[:20])), (2, "One two, THREE again"), (3, None), (4, "..."), (5, "nowhere-at-all"), (None, " ".join(word[5:9])), (1, rows[24][1]), (6, "w1a w2b w3c W4D w5é id no 7")]


@pytest.mark.parametrize(("k", "shard_bytes", "block_words"), [(50, 16 << 20, 2_000_000), (3, 3000, 2_000_000), (2, 3000, 20)])
def test_against_all_documents(spark, k, shard_bytes, block_words):
    rows = texts()
    bench = spark.createDataFrame(items(rows), "item_id long, text string")
    got = ranked_search(docs(spark, rows), bench, k=k, shard_bytes=shard_bytes, block_words=block_words)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, items(rows), k)


def test_empty_tables(spark):
    rows = texts()
    bench = spark.createDataFrame(items(rows), "item_id long, text string")
    assert ranked_search(docs(spark, []), bench).count() == 0
    assert ranked_search(docs(spark, [(1, None), (2, " . ")]), bench).count() == 0
    assert ranked_search(docs(spark, rows), bench.limit(0)).count() == 0


def test_index_serves_several_searches(spark, tmp_path):
    rows = texts()
    index = LexicalIndex.built(docs(spark, rows), str(tmp_path / "index"), shard_bytes=20_000)
    for wanted in ([("a", "one two")], [("b", "again w7a w9c")]):
        got = index.search(spark.createDataFrame(wanted, "name string, words string"), k=4, item_col="name", text_col="words")
        assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, wanted, 4)


def test_terms_like_the_pattern():
    some = ["", None, "Abc d_e", "é9Zé", "x", "end", "start-", "-", "\x00a\x7fb", "ÀB c"]
    array = pa.array(["before", *some, "after"], pa.string()).slice(1, len(some))
    data, first, end, doc = tokens(array)
    found = defaultdict(list)
    for a, b, d in zip(first, end, doc, strict=True):
        found[d].append(bytes(data[a:b]).decode())
    assert [found[k] for k in range(len(some))] == [terms(t) for t in some]
    names, code = encoded(data, first, end)
    assert [names[int(c)].as_py().decode() for c in code] == [x for t in some for x in terms(t)]


def test_varints_round_trip():
    values = np.array([0, 1, 127, 128, 300, 16383, 16384, 2**21, 2**35 - 1, 2**40, 5])
    raw, size = varints(values)
    assert (unvarints(raw) == values).all()
    assert size.tolist() == [max(1, -(-int(v).bit_length() // 7)) for v in values]


def test_blocks_below_the_threshold_stay_compressed():
    """Of a common word with many blocks only those near the few documents that matter are read, and the result is that of all scores."""
    rng = np.random.default_rng(5)
    n = 40_000
    m = lengths_m(rng.integers(20, 400, n), n, 200 * n)
    made = []
    for df, weight in ((20_000, 700), (9_000, 1_500), (60, 6_500), (25, 7_300)):
        doc = np.sort(rng.choice(n // 8 if df < 100 else n, df, replace=False))
        tf = rng.integers(1, 9, df)
        own = blocks_of(np.zeros(df, np.int64), doc, tf, impacts(tf, m[doc]), 1)
        columns = [np.array(own[c][0].values.to_numpy(zero_copy_only=False), np.int64) for c in ("first", "last", "most")]
        made.append((weight, Postings(df, *columns, own["blocks"][0].as_py(), m), doc, impacts(tf, m[doc])))
    total = np.zeros(n, np.int64)
    for weight, _, doc, impact in made:
        total[doc] += weight * impact
    want = np.lexsort((np.arange(n), -total))[:10]
    doc, score = best([(w, p) for w, p, _, _ in made], n, 10, 1)
    assert doc.tolist() == want.tolist() and score.tolist() == total[want].tolist()
    assert made[0][1].read.mean() < 0.5
    doc, score = best([(w, p) for w, p, _, _ in made], n, 10, int(total[want[4]]))
    assert doc.tolist() == want[total[want] >= total[want[4]]].tolist()
