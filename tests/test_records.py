"""Benchmark records and what is told of them."""

import json

import pytest
from pyspark.sql import functions as F

from dossier.operators import records

REF = "array<struct<view_id: string, subview_id: string>>"
STEP = f"struct<step_id: string, step_index: int, used_views: {REF}, used_capabilities: array<struct<capability_id: string>>, observations: array<struct<description: string>>, produced_insights: array<struct<description: string>>, outcome_summary: string>"
EPISODE = "struct<benchmark_episode_index: int, benchmark_episode_title: string, local_goal: string, used_views: array<string>, used_capabilities: array<string>, source_step_ids: array<string>, source_step_refs: array<string>, composite_path: string>"


def tables(spark, prefix=(2, 1)):
    sample = ("s1", "c1", "p", "1", list(prefix), "3", "T", "", "goal", ["v", "v", " "], None)
    samples = spark.createDataFrame([sample], "sample_id string, benchmark_case_id string, paper_name string, case_index string, prefix array<int>, target string, target_title string, target_image string, gold_next_goal string, gold_next_views array<string>, gold_next_capabilities array<string>")
    episodes = [(1, "One", "g1", ["a", "a"], None, ["x"], ["1.1", "1.9", "2.0"], "/i/1.png"), (2, "old", "g", None, None, None, None, None), (2, "Two", "g2", ["b"], ["k"], None, None, "")]
    cases = spark.createDataFrame([("c1", episodes)], f"benchmark_case_id string, episodes array<{EPISODE}>")
    step = lambda i, n, out: (i, n, [("v", "v.s"), ("w", None), (None, "")], [("k",), (None,), ("k",)], [("seen",), ("",)], None, out)
    usage = spark.createDataFrame(
        [("p", 1, ("dp", "", None, "iq"), [("q1", "Q?", ""), ("q2", None, "Open"), (None, "x", None)], [("h1", "H", None, ["q1", "q1"])], [([step("s1", 1, "first"), step("s2", 1, "")],), ([step("s3", None, None)],)])],
        f"paper_name string, case_index int, scenario struct<domain_problem: string, analysis_goal: string, dataset_context: string, initial_question: string>, questions array<struct<question_id: string, question_text: string, status: string>>, hypotheses array<struct<hypothesis_id: string, hypothesis_text: string, status: string, related_question_ids: array<string>>>, usage_episodes array<struct<steps: array<{STEP}>>>",
    )
    systems = spark.createDataFrame([("p", ("sys",))], "paper_name string, system_context struct<system_name: string>")
    stage = "struct<stage_id: string, stage_index: int, stage_title: string, stage_goal: string, used_views: array<string>, used_capabilities: array<string>>"
    flows = spark.createDataFrame([("p", ([("w1", "W", [("a", 1, "A", None, ["v"], []), ("b", 2, "B", "g", [], ["k"])]), ("w2", "X", [("c", 1, "C", None, None, None)])],))], f"paper_name string, workflow_context struct<workflows: array<struct<workflow_id: string, workflow_title: string, stages: array<{stage}>>>>")
    return samples, cases, systems, flows, usage


def test_records(spark):
    r = records.built_records(*tables(spark), "Predict.", "v1", "next_move").first()
    assert (r.metadata.prefix_length, r.metadata.case_index, r.metadata.target_episode_index) == (2, 1, 3)
    given = r.model_input
    assert (given.schema_version, given.task_instruction, given.system_context.system_name, given.response_requirements.use_only_ids_from_context) == ("v1", "Predict.", "sys", True)
    case = given.case_context
    assert tuple(case.scenario) == ("dp", None, None, "iq") and [tuple(q) for q in case.questions] == [("q1", "Q?", None)] and case.hypotheses[0].related_question_ids == ["q1"]
    two, one = case.prefix_episodes
    assert (two.episode_title, two.steps, two.image_path, one.used_views) == ("Two", [], None, ["a"])
    # of equal references the last step counts; a step without an index is 0; a reference to none is left out
    assert [s.step_id for s in one.steps] == ["s2", "s3"] and one.steps[0].used_views == ["v.s", "w"] and one.steps[0].used_capabilities == ["k"]
    assert one.steps[0].observations == ["seen"] and one.steps[0].produced_insights == [] and one.steps[0].outcome_summary is None
    assert [tuple(i) for i in given.visual_context.prefix_episode_images] == [(1, "One", "/i/1.png")]
    assert (r.gold.gold_next_views, r.gold.gold_next_capabilities, r.gold.target_episode_image_path) == (["v"], [], None)


def test_missing_parts_are_errors(spark):
    with pytest.raises(Exception, match="no episode 7 for s1"):
        records.built_records(*tables(spark, (1, 7)), "x", "v1", "next_move").collect()
    samples, cases, systems, flows, usage = tables(spark)
    for broken, message in (((samples, cases.limit(0), systems, flows, usage), "no case c1"), ((samples, cases, systems, flows, usage.limit(0)), "no usage case")):
        with pytest.raises(Exception, match=message):
            records.built_records(*broken, "x", "v1", "next_move").collect()


def test_what_is_told(spark):
    held = records.built_records(*tables(spark), "Predict.", "v1", "next_move")
    told = json.loads(held.select(F.to_json(records.prompt_input("model_input"))).first()[0])
    assert told["visual_context"]["prefix_episode_images"] == [{"benchmark_episode_index": 1, "episode_title": "One", "image_ref": "attached_image_1"}]
    predictions = spark.createDataFrame([("s1", "guess"), ("s2", "none")], "sample_id string, prediction string")
    p = records.judge_payloads(held, predictions).first().payload
    assert [(s.workflow_id, s.workflow_title, s.stage_id) for s in p.workflow_stages] == [("w1", "W", "a"), ("w1", "W", "b"), ("w2", "X", "c")]
    assert [e.episode_title for e in p.prefix_episodes] == ["Two", "One"] and p.case_summary.initial_question == "iq" and p.gold_next_episode.gold_next_goal == "goal" and p.prediction == "guess"
    both = F.struct(F.lit("é").alias("a"), F.lit(None).cast("string").alias("b"))
    plain, more = spark.range(1).select(records.retrieval_prompt(F.lit("Do."), both, both), records.retrieval_prompt(F.lit("Do."), both, both, both)).first()
    parts = more.split("\n\n")
    assert parts[0] == "Do." and [x.split(":\n", 1)[0] for x in parts[1:]] == ["Output JSON contract", "Benchmark input", "Retrieval context"] and "Retrieval" not in plain
    assert all(json.loads(x.split(":\n", 1)[1]) == {"a": "é", "b": None} for x in parts[1:])
