import json

import pytest
from pyspark.sql import functions as F

from dossier.operators import context, rules
from dossier.operators.rules import Fields, Flag, Identifier, Items, Maybe, Number, Text, Whole

RULE = Fields(
    {
        "id": Identifier, "n": Whole(1, 9), "score": Number(0.0, 1.0, required=False), "on": Flag(required=False), "mode": Text(one_of=("a", "b"), required=False), "note": Maybe,
        "parts": Items(Fields({"id": Identifier, "tags": Items(Text(), least=1, different=True, required=False)}, exactly_one=("ref", "text")), least=1),
    }
)
GOOD = {"id": "a-1", "n": 3, "score": 0.5, "on": True, "mode": "b", "note": None, "more": [1], "parts": [{"id": "p", "tags": ["x", "y"], "ref": "r", "text": None}, {"id": "q", "text": "t"}]}


def found(spark, *lines):
    df = spark.createDataFrame(list(enumerate(lines)), "i int, value string")
    return {r.i: [(p.path, p.rule) for p in r.problems] for r in rules.checked(df, RULE).collect()}


def changed(**new):
    return json.dumps({k: v for k, v in (GOOD | new).items() if v != "gone"})


@pytest.mark.parametrize(
    ("line", "want"),
    [
        (json.dumps(GOOD), []),
        (changed(n=1.0, score=1), []),
        (changed(id="A b", n=0, score=1.5, mode="c"), [("$.id", "pattern"), ("$.n", "range"), ("$.score", "range"), ("$.mode", "value")]),
        (changed(id=5, n="3", on="yes", note=[], score=True), [("$.id", "type"), ("$.n", "type"), ("$.score", "type"), ("$.on", "type"), ("$.note", "type")]),
        (changed(id=None, n="gone", parts="gone", score=None), [("$.id", "missing"), ("$.n", "missing"), ("$.parts", "missing")]),
        (changed(n=2.5, parts=[]), [("$.n", "type"), ("$.parts", "too_few")]),
        (changed(parts={"id": "p"}), [("$.parts", "type")]),
        (changed(parts=[{"id": "p", "tags": ["x", "x"], "ref": "r", "text": "t"}, 7, {"tags": []}]), [("$.parts[0].tags", "repeated"), ("$.parts[0]", "one_of"), ("$.parts[1]", "type"), ("$.parts[2].id", "missing"), ("$.parts[2].tags", "too_few"), ("$.parts[2]", "one_of")]),
        ("[1]", [("$", "type")]),
        ("{broken", [("$", "not_json")]),
        ("null", [("$", "missing")]),
        (changed(parts=[{"id": "p", "tags": ["x", 1], "ref": 3}]), [("$.parts[0].tags[1]", "type")]),
    ],
)
def test_problems(spark, line, want):
    assert found(spark, line)[0] == want


def test_blank_lines_go_and_all_lines_are_told(spark):
    assert found(spark, "", json.dumps(GOOD), "  ", "[]") == {1: [], 3: [("$", "type")]}


def test_valid_rows(spark):
    df = spark.createDataFrame([(json.dumps(GOOD),)], "value string")
    assert rules.valid_rows(df, RULE, "id string, n int").collect() == [("a-1", 3)]
    both = df.union(spark.createDataFrame([(changed(n=0),)], "value string"))
    for read in (lambda x: x.count(), lambda x: x.select("id").collect()):
        with pytest.raises(Exception, match=r"bad line: \$\.n range"):
            read(rules.valid_rows(both, RULE, "id string, n int"))


def test_predictions(spark):
    lines = [{"predicted_next_goal": "g", "predicted_views": ["a.b"], "confidence": 1.0}, {"predicted_views": ["a b"], "confidence": 1.1, "predicted_workflow_stage": {"workflow_id": "w"}, "retrieved_evidence": [{"paper_name": "p", "source_type": "s", "reason": "r"}, {}]}]
    df = spark.createDataFrame([(json.dumps(x),) for x in lines], "value string")
    got = [[(p.path, p.rule) for p in r.problems] for r in rules.checked(df, rules.PREDICTION).collect()]
    want = [("$.predicted_next_goal", "missing"), ("$.predicted_views[0]", "pattern"), ("$.predicted_workflow_stage.stage_id", "missing"), ("$.confidence", "range")]
    assert got[0] == [] and got[1][:4] == want and [p for p, _ in got[1][4:]] == ["$.retrieved_evidence[1].paper_name", "$.retrieved_evidence[1].source_type", "$.retrieved_evidence[1].reason"]


def test_coordinations(spark):
    kind = "c array<struct<coordination_id: string, coordination_type: string, evidence: struct<reasoning: string>, source: struct<view_id: string, subview_id: string>, targets: array<struct<view_id: string, subview_id: string>>>>"
    rows = [("c1", "", ("why",), ("v", "v.s"), [("v", None), ("v", ""), ("", None), ("w", "w.s"), ("v", None)]), ("", "t", None, None, None), ("c2", "t", None, None, None)]
    got = spark.createDataFrame([(rows,), (None,)], kind).select(context.coordinations("c").alias("c")).collect()
    assert [tuple(x) for x in got[0].c] == [("c1", None, "why", "v.s", ["v", "w.s"]), ("c2", "t", None, None, [])] and got[1].c == []


def test_stages_keep_what_they_use(spark):
    stages = spark.createDataFrame([("w", "s", "", ["a", " a", ""], [("k",), (None,), ("k",)], [("c",), ("",)]), ("w", "", "t", None, None, None)], "workflow_id string, stage_id string, stage_title string, used_views array<string>, used_capabilities array<struct<capability_id: string>>, used_coordinations array<struct<coordination_id: string>>")
    kept, _ = context.workflow_context(stages, stages.select(F.col("stage_id").alias("source_stage_id"), F.col("stage_id").alias("target_stage_id")))
    assert kept.collect() == [("w", "s", "s", ["a"], ["k"], ["c"])]
