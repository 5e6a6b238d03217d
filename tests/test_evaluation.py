"""The evaluator on small records, with scores computed by hand."""

import json

import pytest

from dossier.operators.evaluation import evaluate, judge_run_rows
from dossier.operators.resultlog import last_results
from dossier.operators.summaries import summary

RECORD = """metadata struct<sample_id: string, benchmark_case_id: string, paper_name: string, case_index: int, prefix_length: int, prefix_episode_indices: array<int>, target_episode_index: int>,
model_input struct<system_context: struct<views: array<struct<view_id: string, subviews: array<struct<subview_id: string, capabilities: array<struct<capability_id: string>>>>>>>,
  workflow_context: struct<workflows: array<struct<workflow_id: string, stages: array<struct<stage_id: string, used_views: array<string>, used_capabilities: array<string>>>>>>>,
gold struct<gold_next_goal: string, gold_next_views: array<string>, gold_next_capabilities: array<string>>"""
VIEWS = [
    {"view_id": "a", "subviews": [{"subview_id": "a.x", "capabilities": [{"capability_id": "a.x.1"}, {"capability_id": "a.x.2"}]}, {"subview_id": "a.y", "capabilities": [{"capability_id": "a.y.1"}]}]},
    {"view_id": "b", "subviews": [{"subview_id": "b.z", "capabilities": [{"capability_id": "b.z.1"}]}]},
    {"view_id": "c", "subviews": None},
]
WORKFLOWS = [{"workflow_id": "w", "stages": [{"stage_id": "s1", "used_views": ["a.x"], "used_capabilities": ["a.x.1"]}, {"stage_id": "s2", "used_views": ["b"], "used_capabilities": None}]}]



def run(spark, cases, **kw):
    """cases: {sample: (result row or None, gold views, gold capabilities)}"""
    rows = [
        {
            "metadata": {"sample_id": s, "benchmark_case_id": "case", "paper_name": f"p{k % 2}", "case_index": 1, "prefix_length": 2, "prefix_episode_indices": [1, 2], "target_episode_index": 3},
            "model_input": {"system_context": {"views": VIEWS}, "workflow_context": {"workflows": WORKFLOWS}},
            "gold": {"gold_next_goal": "g", "gold_next_views": v, "gold_next_capabilities": c},
        }
        for k, (s, (_, v, c)) in enumerate(cases.items())
    ]
    lines = [(k, json.dumps({"sample_id": s, **r})) for k, (s, (r, _, _)) in enumerate(cases.items()) if r is not None]
    results = last_results(spark.createDataFrame(lines or [(0, "")], "line_no long, value string"))
    manifest = spark.createDataFrame([(s, "title", "mode", "episode") for s in cases], "sample_id string, case_title string, segmentation_mode string, target_episode_title string")
    return evaluate(spark.createDataFrame(rows, RECORD), results, manifest, **kw)


def ok(views, caps, **more):
    return {"status": "ok", "prediction": {"predicted_next_goal": "g", "predicted_views": views, "predicted_capabilities": caps, **more}}


def test_scores_by_hand(spark):
    cases = {
        "both_empty": (ok([], []), [], []),
        "none_predicted": (ok([], []), ["a"], ["a.x.1"]),
        "none_gold": (ok(["a"], ["a.x.1"]), [], []),
        "view_of_part": (ok(["a"], []), ["a.x"], []),
        "siblings": (ok(["a.x"], []), ["a.y"], []),
        "two_parts": (ok(["a", "a.x"], []), ["a.x", "a.y"], []),
        "one_for_two": (ok(["a"], []), ["a.x", "a.y"], []),
        "same_subview": (ok([], ["a.x.1"]), [], ["a.x.2"]),
        "same_view": (ok([], ["a.x.1"]), [], ["a.y.1"]),
        "far": (ok([], ["a.x.1"]), [], ["b.z.1"]),
        "mixed": (ok([], ["a.x.1", "a.x.2"]), [], ["a.x.1", "a.y.1"]),
        "unknown": (ok([], ["zz"]), [], ["zz"]),
    }
    got = {r.sample_id: r for r in run(spark, cases).collect()}
    view = {"both_empty": (1, 1, 1), "none_predicted": (0, 0, 0), "none_gold": (0, 0, 0), "view_of_part": (0.5, 0.5, 0.5), "siblings": (0, 0, 0), "two_parts": (0.75, 0.75, 0.75), "one_for_two": (0.5, 0.25, 1 / 3)}
    capability = {"both_empty": (1, 1, 1), "none_predicted": (0, 0, 0), "none_gold": (0, 0, 0), "same_subview": (0.5, 0.5, 0.5), "same_view": (0.25, 0.25, 0.25), "far": (0, 0, 0), "mixed": (0.625, 0.625, 0.625), "unknown": (1, 1, 1)}
    for kind, want in (("view", view), ("capability", capability)):
        for s, prf in want.items():
            assert tuple(got[s][f"{kind}_{m}_relaxed"] for m in ("precision", "recall", "f1")) == pytest.approx(prf), (kind, s)
    assert got["view_of_part"].view_f1_strict == 0 and got["mixed"].capability_f1_strict == 0.5
    assert got["both_empty"].joint_exact_match and not got["none_gold"].view_exact_match
    assert got["unknown"].invalid_capability_ids == ["zz"] and got["unknown"].invalid_capability_id_count == 1
    assert got["mixed"].structure_score == pytest.approx(0.5 + 0.3125) and got["mixed"].next_move_score is None
    assert got["view_of_part"].review_reasons == ["strict_low_relaxed_high"] and got["view_of_part"].needs_review


def test_statuses_and_forms(spark):
    good = {"predicted_next_goal": "g"}
    cases = {
        "missing": (None, ["a"], []),
        "failed": ({"status": "error", "error": "x"}, ["a"], []),
        "no_status": ({"prediction": good}, ["a"], []),
        "no_json": ({"status": "ok", "prediction": "sorry"}, ["a"], []),
        "as_text": ({"status": "ok", "prediction": json.dumps(good)}, ["a"], []),
        "no_goal": ({"status": "ok", "prediction": {"predicted_views": ["a", "q", 3, " a "]}}, ["a"], []),
        "bad_id": (ok([" a "], []), ["a"], []),
        "capital": (ok(["A"], []), ["a"], []),
        "null_list": (ok(None, []), ["a"], []),
        "too_sure": (ok(["a"], [], confidence=1.5), ["a"], []),
        "sure": (ok(["a"], [], confidence=1, rationale=None, predicted_workflow_stage=None), ["a"], []),
        "bad_stage": (ok(["a"], [], predicted_workflow_stage={"workflow_id": "w"}), ["a"], []),
        "bad_evidence": (ok(["a"], [], retrieved_evidence=[{"paper_name": "p"}]), ["a"], []),
        "evidence": (ok(["a"], [], retrieved_evidence=[{"paper_name": "p", "source_type": "t", "reason": "r", "source_id": None}]), ["a"], []),
        "error_with_prediction": ({"status": "error", "prediction": {"predicted_views": ["q"]}}, ["a"], []),
    }
    got = {r.sample_id: r for r in run(spark, cases).collect()}
    want = dict.fromkeys(cases, "schema_invalid") | {"missing": "missing_result", "failed": "result_status_error", "no_status": "result_status_missing", "no_json": "prediction_missing_or_non_json"}
    want |= dict.fromkeys(("as_text", "sure", "evidence"), "ok") | {"error_with_prediction": "result_status_error"}
    assert {s: r.evaluation_status for s, r in got.items()} == want
    assert {s for s, r in got.items() if r.schema_valid} == {"as_text", "sure", "evidence"}
    assert got["missing"].status == "missing_result" and got["failed"].status == "error" and not got["failed"].completion
    assert got["no_goal"].completion and got["no_goal"].json_valid and got["no_goal"].invalid_view_ids == ["q"] and got["no_goal"].raw_predicted_view_count == 2
    assert got["no_goal"].predicted_view_count == 0 and got["no_goal"].view_f1_relaxed == 0
    assert got["error_with_prediction"].json_valid and got["error_with_prediction"].invalid_view_id_count == 1


def test_workflows_and_parents(spark):
    stage = lambda w, s: {"predicted_workflow_stage": {"workflow_id": w, "stage_id": s}}
    cases = {
        "all": (ok(["a.x", "a", "b.z", "c", "a.y"], ["a.x.1", "b.z.1", "a.y.1"], **stage("w", "s2")), [], []),
        "other": (ok(["b"], ["a.x.1", "b.z.1"], **stage("w", "s9")), [], []),
        "nothing": (ok([], []), [], []),
    }
    got = {r.sample_id: r for r in run(spark, cases).collect()}
    # a.x is used; a has a used part; b.z lies in b, which is used; c and a.y aren't
    assert (got["all"].workflow_view_supported_count, got["all"].predicted_view_count, got["all"].workflow_capability_supported_count) == (3, 5, 1)
    assert got["all"].internal_consistency_rate == 1 and got["all"].workflow_stage_valid is True and got["all"].predicted_workflow_stage.stage_id == "s2"
    assert got["other"].internal_consistency_rate == 0.5 and got["other"].workflow_stage_valid is False
    assert got["nothing"].workflow_stage_valid is None and got["nothing"].workflow_view_support_rate is None


def test_judges(spark):
    cases = {"good": (ok(["a"], ["a.x.1"]), ["a"], ["a.x.1"]), "twice": (ok(["a"], []), ["b"], []), "failed": (ok([], []), ["b"], []), "unasked": (ok([], []), [], []), "bad": ({"status": "error"}, ["a"], [])}
    runs = [("good", 1, "ok", 4, "fine", None), ("twice", 1, "ok", 3, "so", None), ("twice", 2, "error", None, None, "late"), ("failed", 1, "error", None, None, "x"), ("failed", 2, "error", None, None, "y")]
    table = spark.createDataFrame(runs, "sample_id string, repeat_index int, status string, judge_score int, rationale string, error string")
    scores = run(spark, cases, judge_runs=table, judge_model="m")
    got = {r.sample_id: r for r in scores.collect()}
    assert {s: r.goal_judge_status for s, r in got.items()} == {"good": "ok", "twice": "multi_run_partial_ok", "failed": "multi_run_all_error", "unasked": "not_run", "bad": "skipped_invalid_prediction"}
    assert (got["good"].goal_score, got["good"].judge_score, got["good"].goal_score_std, got["good"].next_move_score) == (1.0, 4.0, 0.0, pytest.approx(1.0))
    assert (got["twice"].goal_score, got["twice"].goal_judge_ok_count, got["twice"].goal_judge_error_count, got["twice"].goal_judge_rationale) == (0.75, 1, 1, "so")
    assert got["twice"].review_reasons == ["goal_good_but_structure_low"] if got["twice"].structure_score < 0.25 else True
    assert (got["bad"].goal_score, got["bad"].judge_score_runs, got["bad"].goal_judge_run_count) == (0.0, [0.0], 1)
    assert got["failed"].goal_score is None and got["failed"].goal_judge_error == "x"
    rows = sorted((r.sample_id, r.repeat_index, r.goal_judge_status, r.goal_score) for r in judge_run_rows(scores).where("sample_id <> 'failed'").collect() if r.goal_score is not None)
    assert rows == [("bad", 1, "skipped_invalid_prediction", 0.0), ("good", 1, "ok", 1.0), ("twice", 1, "ok", 0.75)]
    assert judge_run_rows(scores).count() == 7
    whole = summary(scores).first()
    assert (whole.sample_count, whole.completed_count, whole.goal_score_available_count, whole.goal_judge_multi_run_count, whole.goal_judge_sample_ok_count) == (5, 4, 3, 2, 2)

    skipped = {r.sample_id: r for r in run(spark, cases, judge_runs=table, judge_model="m", skip_judge=True).collect()}
    assert {r.goal_judge_status for r in skipped.values()} == {"skipped_by_flag"} and all(r.goal_score is None and r.goal_judge_model is None for r in skipped.values())
    unset = {r.sample_id: r for r in run(spark, cases).collect()}
    assert unset["good"].goal_judge_status == "judge_not_configured" and unset["bad"].goal_judge_status == "skipped_invalid_prediction" and unset["bad"].goal_score == 0
    assert unset["good"].goal_judge_error_count == 1 and judge_run_rows(run(spark, cases)).count() == 5


def test_a_record_without_a_manifest_row(spark):
    df = run(spark, {"s": (None, [], [])})
    assert df.count() == 1
    none = spark.createDataFrame([], "sample_id string, case_title string, segmentation_mode string, target_episode_title string")
    results = last_results(spark.createDataFrame([(0, "")], "line_no long, value string"))
    record_ = spark.createDataFrame([{"metadata": {"sample_id": "s"}, "model_input": {"system_context": {"views": []}}, "gold": {}}], RECORD)
    with pytest.raises(Exception, match="no manifest row for s"):
        evaluate(record_, results, none).collect()
