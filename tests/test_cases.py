"""Cases computed by hand."""

import pytest
from pyspark.sql import functions as F

from dossier.functions import arrays, geometry, jsonx, numbers, text
from dossier.operators import figures, ids, matching, resultlog, summaries

CAPS = [("a.x.1", "a.x", "a"), ("a.x.2", "a.x", "a"), ("a.y.1", "a.y", "a"), ("b.z.1", "b.z", "b")]
VIEWS = [("a", "a"), ("b", "b"), ("a.x", "a"), ("a.y", "a"), ("b.z", "b")]


def score(spark, kind, pred, gold):
    column = "capability_id" if kind == "capability" else "id"
    items = spark.createDataFrame([(1, s, x) for s, own in (("pred", pred), ("gold", gold)) for x in own], f"sample_id long, side string, {column} string")
    if kind == "capability":
        got = matching.capability_matches(items, spark.createDataFrame(CAPS, "capability_id string, subview_id string, view_id string"))
    else:
        got = matching.view_matches(items, spark.createDataFrame(VIEWS, "id string, view_id string"))
    return matching.scored(spark.range(1, 2).withColumnRenamed("id", "sample_id"), got).first()


@pytest.mark.parametrize(
    "kind,pred,gold,m,p,r,f",
    [
        ("view", [], [], 0, 1, 1, 1),
        ("view", [], ["a"], 0, 0, 0, 0),
        ("view", ["a"], [], 0, 0, 0, 0),
        ("view", ["a"], ["a.x"], 0.5, 0.5, 0.5, 0.5),
        ("view", ["a.x"], ["a.y"], 0, 0, 0, 0),
        ("view", ["a", "a.x"], ["a.x", "a.y"], 1.5, 0.75, 0.75, 0.75),
        ("view", ["a"], ["a.x", "a.y"], 0.5, 0.5, 0.25, 1 / 3),
        ("capability", ["a.x.1"], ["a.x.2"], 0.5, 0.5, 0.5, 0.5),
        ("capability", ["a.x.1"], ["a.y.1"], 0.25, 0.25, 0.25, 0.25),
        ("capability", ["a.x.1"], ["b.z.1"], 0, 0, 0, 0),
        ("capability", ["a.x.1", "a.x.2"], ["a.x.1", "a.y.1"], 1.25, 0.625, 0.625, 0.625),
        ("capability", ["zz"], ["zz"], 1, 1, 1, 1),
    ],
)
def test_matching(spark, kind, pred, gold, m, p, r, f):
    got = score(spark, kind, pred, gold)
    assert (got.matched, got.precision, got.recall, got.f1) == pytest.approx((m, p, r, f))


def test_composites_and_reviews(spark):
    columns = "goal_score double, structure_score double, view_f1_relaxed double, view_f1_strict double, capability_f1_relaxed double, capability_f1_strict double, invalid_view_id_count long, invalid_capability_id_count long"
    rows = [(0.75, 0.2, 0.1, 0.1, 0.1, 0.1, 0, 0), (None, 0.5, 0.5, 0.0, 0.1, 0.1, 0, 0), (0.2, 0.7, 0.9, 0.9, 0.1, 0.1, 1, 1)]
    got = [r[0] for r in spark.createDataFrame(rows, columns).select(summaries.review_reasons()).collect()]
    assert got == [["goal_good_but_structure_low"], ["strict_low_relaxed_high"], ["structure_good_but_goal_low", "many_invalid_ids"]]
    one = spark.range(1).select(numbers.structure_score(F.lit(0.5), F.lit(0.625)), numbers.next_move_score(F.lit(0.5), F.lit(0.625), F.lit(None).cast("double")), numbers.next_move_score(F.lit(0.5), F.lit(0.625), F.lit(0.75))).first()
    assert one[0] == 0.5625 and one[1] is None and one[2] == pytest.approx(0.6)


def test_result_log(spark):
    rows = [(0, '{"sample_id": "A", "status": "error"}'), (1, ""), (2, "not json"), (3, "[1]"), (4, '{"sample_id":5}'), (5, '{"sample_id": "A", "status": "ok"}')]
    lines = spark.createDataFrame(rows, "line_no long, value string")
    assert tuple(resultlog.log_counters(lines).first()) == (2, 1, 1, 3)
    assert [r.s for r in resultlog.last_results(lines).select(F.try_variant_get("row", "$.status", "string").alias("s")).collect()] == ["ok"]


@pytest.mark.parametrize("values,want", [([3], 0.0), ([3, 5], 1.0), ([], None)])
def test_deviation(spark, values, want):
    assert spark.createDataFrame([(v,) for v in values], "v int").agg(F.stddev_pop("v")).first()[0] == want


@pytest.mark.parametrize("statuses,want", [(["ok", "error"], "multi_run_partial_ok"), (["ok", "cached"], "multi_run_all_ok"), (["error", "error"], "multi_run_all_error"), (["ok"], "ok")])
def test_statuses(spark, statuses, want):
    df = spark.createDataFrame([("s", s) for s in statuses], "sample_id string, status string")
    assert df.groupBy("sample_id").agg(summaries.run_status().alias("s")).first().s == want
    assert df.where("false").agg(summaries.run_status().alias("s")).first().s == "not_run"


def test_lists_and_slugs(spark):
    df = spark.createDataFrame([([" a", "a", "A", ""],)], "x array<string>")
    assert tuple(df.select(arrays.distinct_stripped("x"), arrays.distinct_ignoring_case("x")).first()) == (["a", "A"], ["a"])
    slugs = spark.createDataFrame([("User’s  View (A)",), ("",)], "x string").select(text.slug("x", F.lit("view-1")))
    assert [r[0] for r in slugs.collect()] == ["users-view-a", "view-1"]
    rows = spark.createDataFrame([("s", b, k) for k, b in enumerate(["x", "x", "x-2", "x"])], "scope string, base string, pos long")
    assert [r.id for r in ids.unique_ids(rows).orderBy("pos").collect()] == ["x", "x-2", "x-2-2", "x-3"]
    checks = spark.createDataFrame([("a.b-c",), ("A",), ("a..b",), (" a ",)], "x string").select(ids.is_identifier("x"))
    assert [r[0] for r in checks.collect()] == [True, False, False, False]


@pytest.mark.parametrize("scores,want", [([1.0, 0.9], True), ([0.4, 0.1], True), ([0.9], False), ([0.9, 0.5], False)])
def test_review_gap(spark, scores, want):
    df = spark.createDataFrame([("d", k, f"f{k}", s, "interface") for k, s in enumerate(scores)], "doc string, pos long, fig_id string, interface double, primary_role string")
    assert figures.manifests(df).first().needs_manual_review is want


def test_rank_and_pixels(spark):
    df = spark.createDataFrame([("d", k, s) for k, s in enumerate([0.0, 0.0, 1.0])], "doc string, pos long, interface double")
    assert [r.interface_rank for r in figures.ranked(df).orderBy("pos").collect()] == [2, 3, 1]
    box = spark.range(1).select(geometry.pixel_box(geometry.rect(F.lit(16), F.lit(0), F.lit(229), F.lit(1000)), F.lit(1927).cast("long"), F.lit(1232).cast("long"))).first()[0]
    assert (box.left, box.right, box.bottom) == (31, 441, 1232)


@pytest.mark.parametrize("numbers_,long,verdict,issues", [([1, 2, 4, 4], False, "yes", "1 missing; 1 repeated"), ([1, 2], True, "maybe", ""), ([], False, "yes", "figure extraction failed"), ([1, 2], False, "no", "")])
def test_rollup(spark, numbers_, long, verdict, issues):
    rows = [("d", f"fig_{n}", f"Fig. {n}: " + ("x" * 1300 if long and n == 1 else "a clean caption")) for n in numbers_]
    got = figures.review(spark.createDataFrame([("d",)], "doc string"), spark.createDataFrame(rows, "doc string, fig_id string, caption string")).first()
    assert (got.needs_review, got.issues, got.num_figures) == (verdict, issues, str(len(numbers_)))


def test_rollup_without_numbers(spark):
    got = figures.review(spark.createDataFrame([("d",)], "doc string"), spark.createDataFrame([("d", "figure", "Fig. 1: a clean caption")], "doc string, fig_id string, caption string")).first()
    assert (got.needs_review, got.issues) == ("yes", "no figures; does not start at figure 1")


def test_first_object():
    assert jsonx.balanced('x {"a":"}"} y') == '{"a":"}"}' and jsonx.balanced('{"a":1') is None
