import re
from collections import defaultdict
from itertools import permutations

import pytest

from dossier.llm import filter_audit as fa
from dossier.llm.filter_audit import Chain, chained, failures, filter_audit, routed

from .fixtures import SCHEMA, texts

LABELS = "doc_id long, quality int, toxic int, part string"


def brute(rows, labels):
    """rows: (id, text, part)"""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    marks = defaultdict(lambda: [False, False])
    for i, q, t in labels:
        if i is not None:
            marks[i][0] |= q == 1
            marks[i][1] |= t == 1
    parts = defaultdict(list)
    for i, t, part in rows:
        text = t or ""
        words = re.findall("[^\x20\x09-\x0d]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": i is not None and least[text] < i}
        parts[part or ""].append((fails, *(marks[i] if i is not None else (False, False))))
    out = []
    for part, own in parts.items():
        mine, shapley = [], defaultdict(int)
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                removed = [x for x in left if x[0][f]]
                left = [x for x in left if not x[0][f]]
                failing = [x for x in own if x[0][f]]
                shapley[f] += len(removed)
                mine.append((part, "".join(order), step, len(left), len(removed), len(failing) - len(removed), sum(1 for x in failing if sum(x[0].values()) == 1), sum(x[1] for x in removed), sum(x[2] for x in removed)))
        out += [(*x, shapley[x[1][x[2] - 1]]) for x in mine]
    return sorted(out)


def table(spark, rows):
    return spark.createDataFrame([("x", i, t, "en", p, None if t is None else len(t), 7, "y") for i, t, p in rows], SCHEMA).repartition(5)


def cases():
    rows = [(i, t, [None, "a", "b", ""][k % 4]) for k, (i, t) in enumerate(texts())]
    long = " ".join(f"w{k}" for k in range(250))
    rows += [(60, long.upper(), "a"), (61, long + " #1", "a"), (62, long, "b"), (62, long, "b"), (62, long, "a"), (59, long, "b"), (63, "Ä" * 10 + "B", "c"), (64, "a\x1cb\xa0c", "c"), (None, long, "b"), (-5, "", "c"), (65, "tie\nTIE", "c")]
    return rows


def labels(rows):
    ids = [i for i, _, _ in rows]
    return [(i, k % 3 == 0, (k % 5 == 0) if k % 7 else None) for k, i in enumerate(ids)] + [(40, 1, 1), (40, 0, 0), (None, 1, 1), (12345, 1, 1)]


@pytest.mark.parametrize("size", [48 << 20, 3000])
def test_against_brute_force(spark, size):
    rows = cases()
    marks = [(i, None if q is None else int(q), None if t is None else int(t)) for i, q, t in labels(rows)]
    got = filter_audit(table(spark, rows), spark.createDataFrame([(*x, "p") for x in marks], LABELS), bytes_per_partition=size)
    assert got.columns == ["part", "filter_order", "step", *fa.COUNTS]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, marks)


def test_empty_tables(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit(table(spark, []), none).count() == 0
    assert filter_audit(table(spark, [(1, None, None)]), none).count() == 600


def test_texts_with_one_hash_are_told_apart():
    got = sorted(chained([(7, (3, {"a": 1}, 1, b"one")), (7, (2, {"a": 2}, 0, b"two")), (7, (1, {"b": 1}, 1, b"one")), (7, (2, {"a": 1}, 0, b"two")), (7, (9, {"a": 4}, 0, b"two")), (8, (5, "a", 16, 1))]))
    assert got == [(1, "b", 1, 1), (2, "a", 0, 3), (3, "a", 17, 1), (5, "a", 16, 1), (9, "a", 16, 4)]


def test_copies_are_sent_once_for_each_block(spark):
    """A text that most rows have: a task sends it once, and the rows of repeated ids as counts."""
    rows = [(k % 50, "p", "the same text") for k in range(5000)] + [(k, "p", f"text {k}") for k in range(20)]
    sent = list(routed(1 << 20)(rows))
    assert sum(1 for _, m in sent if not isinstance(m[1], str) and m[3] == b"the same text") == 1
    assert sum(m[3] for _, m in sent if isinstance(m[1], str)) + sum(sum(m[1].values()) for _, m in sent if not isinstance(m[1], str)) == len(rows)
    blocks = list(routed(600)(rows))
    assert sum(m[3] for _, m in blocks if isinstance(m[1], str)) + sum(sum(m[1].values()) for _, m in blocks if not isinstance(m[1], str)) == len(rows)


def test_failures_are_of_all_rows(spark):
    rows = cases()
    got = failures(table(spark, rows), bytes_per_partition=4000, block_bytes=2000).groupBy().sum("n").first()[0]
    assert got == len(rows)


def test_chain():
    chain = Chain(b"x", 3, 10, {"a": 1})
    assert list(chain.met(12, {"b": 2})) == [(12, "b", 19, 2)]
    assert list(chain.met(10, {"b": 2})) == [] and list(chain.met(4, {"c": 1})) == [(10, "a", 19, 1), (10, "b", 19, 2)]
    assert list(chain.told()) == [(4, "c", 3, 1)]
