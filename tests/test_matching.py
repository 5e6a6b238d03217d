"""Closed forms of partial-credit matching against the general solver, on random sets."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from dossier.operators.hierarchy import capability_dimension, supported_views, view_dimension
from dossier.operators.matching import best_matching, capability_matches, scored, strict_matches, support_counts, view_matches, weighted_matches

CAPS = [(f"v{v}.s{s}.c{c}", f"v{v}.s{s}", f"v{v}") for v in range(2) for s in range(2) for c in range(3)]
PARENT = {c: (s, v) for c, s, v in CAPS}
VIEWS = {s: v for _, s, v in CAPS} | {v: v for _, _, v in CAPS}


def cap_weight(a, b):
    if a == b:
        return 1.0
    if a not in PARENT or b not in PARENT:
        return 0.0
    return 0.5 if PARENT[a][0] == PARENT[b][0] else 0.25 if PARENT[a][1] == PARENT[b][1] else 0.0


def view_weight(a, b):
    return 1.0 if a == b else 0.5 if a != b and (VIEWS.get(a) == b or VIEWS.get(b) == a) else 0.0


def brute(pred, gold, weight):
    small, large = sorted((list(pred), list(gold)), key=len)
    best = 0.0
    for order in itertools.permutations(large, len(small)):
        best = max(best, sum(weight(a, b) for a, b in zip(small, order, strict=True)))
    return best


def test_solver_against_permutations():
    rng = random.Random(1)
    for _ in range(200):
        n, m = rng.randrange(0, 4), rng.randrange(1, 5)
        w = [[rng.choice([0, 0.25, 0.5, 1]) for _ in range(m)] for _ in range(n)]
        rows, cols = range(n), range(m)
        best = max((sum(w[i][j] for i, j in zip(p, q, strict=True)) for k in range(min(n, m) + 1) for p in itertools.combinations(rows, k) for q in itertools.permutations(cols, k)), default=0)
        assert best_matching(w) == pytest.approx(best)


def cases(ids, seed, n=150):
    rng = random.Random(seed)
    return [(k, rng.sample(ids, rng.randrange(0, 5)), rng.sample(ids, rng.randrange(0, 5))) for k in range(n)]


def frames(spark, rows, column):
    items = [(k, side, x) for k, p, g in rows for side, own in (("pred", p), ("gold", g)) for x in own]
    return spark.createDataFrame(items, f"sample_id long, side string, {column} string"), spark.createDataFrame([(k,) for k, *_ in rows], "sample_id long")


def test_capabilities(spark):
    rows = cases([c for c, *_ in CAPS] + ["unknown-1", "unknown-2"], 2)
    items, samples = frames(spark, rows, "capability_id")
    dim = spark.createDataFrame(CAPS, "capability_id string, subview_id string, view_id string")
    got = {r.sample_id: r for r in scored(samples, capability_matches(items, dim)).collect()}
    strict = {r.sample_id: r.matched for r in scored(samples, strict_matches(items, "capability_id")).collect()}
    for k, p, g in rows:
        m = brute(p, g, cap_weight)
        assert got[k].matched == pytest.approx(m) and strict[k] == len(set(p) & set(g))
        want = (1, 1, 1) if not p and not g else (0, 0, 0) if not p or not g else (m / len(p), m / len(g), 2 * m / (len(p) + len(g)))
        assert (got[k].precision, got[k].recall, got[k].f1) == pytest.approx(want)


def test_views(spark):
    rows = cases([*VIEWS, "unknown"], 3)
    items, samples = frames(spark, rows, "id")
    dim = spark.createDataFrame(list(VIEWS.items()), "id string, view_id string")
    got = {r.sample_id: r.matched for r in scored(samples, view_matches(items, dim)).collect()}
    assert all(got[k] == pytest.approx(brute(p, g, view_weight)) for k, p, g in rows)


def test_general_weights(spark):
    rows = [r for r in cases([c for c, *_ in CAPS], 4, 30) if r[1] and r[2]]
    pairs = spark.createDataFrame([(k, a, b, cap_weight(a, b)) for k, p, g in rows for a in p for b in g], "sample_id long, pred_id string, gold_id string, weight double")
    got = dict(weighted_matches(pairs).collect())
    assert all(got[k] == pytest.approx(brute(p, g, cap_weight)) for k, p, g in rows)


def test_dimension_and_support(spark):
    tree = spark.createDataFrame(
        [("r", [("v1", [("v1.s1", [("c1",), ("c2",)]), ("v1.s2", None)]), ("v2", [("v2.s1", [("c1",)])])])],
        "record_id string, views array<struct<view_id: string, subviews: array<struct<subview_id: string, capabilities: array<struct<capability_id: string>>>>>>",
    )
    dim = capability_dimension(tree)
    assert {(r.capability_id, r.subview_id) for r in dim.collect()} == {("c1", "v2.s1"), ("c2", "v1.s1"), (None, "v1.s2")}
    views = view_dimension(dim.select("view_id", "subview_id"))
    used = spark.createDataFrame([(1, "v1.s1"), (2, "v1"), (3, "zz")], "sample_id long, id string")
    got = {(r.sample_id, r.id) for r in supported_views(used, views).collect()}
    assert got == {(1, "v1.s1"), (1, "v1"), (2, "v1"), (2, "v1.s1"), (2, "v1.s2"), (3, "zz")}
    predicted = spark.createDataFrame([(1, "v1"), (1, "v2"), (2, "v1.s2"), (4, "x")], "sample_id long, id string")
    counts = {r.sample_id: (r.n_pred, r.n_supported) for r in support_counts(predicted, supported_views(used, views), "id").collect()}
    assert counts == {1: (2, 1), 2: (1, 1), 3: (0, 0), 4: (1, 0)}
    assert dim.where(F.col("view_id").isNull()).count() == 0


def test_one_pass_for_scores(spark):
    """All scores of all samples read the lines once and deal them once."""
    import os

    from dossier.plans import catalog

    data = "/root/testdata/sf0.001"
    if os.path.isdir(data):
        for name in ("summary_by_paper", "support_rates", "review_queue", "flagship_capability_summary"):
            plan = catalog.queries()[name](spark, data)._jdf.queryExecution().executedPlan().toString()
            assert plan.count("/lineitem.parquet") == 1 and plan.count("Exchange hashpartitioning") <= 3, name
