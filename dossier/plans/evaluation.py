"""The evaluator from records, a result log, a manifest and judge runs to score rows.

A record is an order with its lines: the hierarchy it may choose from and what its workflow uses come from them. Its result in
the log depends on the order's priority and status: none, an error, no JSON, no goal, a text that holds JSON, or an object.
Every eleventh supplier is predicted under an id that no hierarchy has. Each line is a run of the judge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import computed
from ..operators.evaluation import evaluate
from ..operators.resultlog import last_results
from .registry import query, table
from .scoring import BUNDLE, DIM, SUPPORT, rounded, sets


def case_of(missing: object, error: object, no_json: object, no_goal: object, else_: object) -> Column:
    """One of five values, by what kind of result a record has."""
    p, s = F.col("prefix_length"), F.col("segmentation_mode")
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = F.when((p == "5-LOW") & (s == "F"), value(missing)).when((p == "4-NOT SPECIFIED") & (s == "F"), value(error))
    return out.when((p == "3-MEDIUM") & (s == "P"), value(no_json)).when((p == "3-MEDIUM") & (s == "F"), value(no_goal)).otherwise(value(else_))


def records(spark: SparkSession, d: str) -> DataFrame:
    """(metadata, model_input, gold) of each order with a line. Its id is a text from the first shuffle on, so that what is joined
    later meets it where it is."""
    ids = lambda c: F.transform(c, lambda x: x["id"])
    own = sets(spark, d, ("all_capability", "gold_view", "gold_capability", "used_view", "used_capability"), text=True)
    of = lambda key, value: F.filter("all_capability", lambda c: c[key] == value)
    caps = lambda s: F.transform(of("subview_id", s), lambda c: F.struct(c["id"].alias("capability_id")))
    subs = lambda v: F.transform(F.array_distinct(F.transform(of("view_id", v), lambda c: c["subview_id"])), lambda s: F.struct(s.alias("subview_id"), caps(s).alias("capabilities")))
    views = F.transform(F.array_distinct(F.transform("all_capability", lambda c: c["view_id"])), lambda v: F.struct(v.alias("view_id"), subs(v).alias("subviews")))
    stage = F.struct(F.lit("s").alias("stage_id"), ids("used_view").alias("used_views"), F.col("used_capability").alias("used_capabilities"))
    key = F.col("sample_id")
    meta = F.struct(
        key.alias("sample_id"), key.alias("benchmark_case_id"), "paper_name", F.lit(1).alias("case_index"), F.length("prefix_length").alias("prefix_length"),
        F.array(F.lit(1)).alias("prefix_episode_indices"), F.lit(2).alias("target_episode_index"),
    )
    given = F.struct(F.struct(views.alias("views")).alias("system_context"), F.struct(F.array(F.struct(F.lit("w").alias("workflow_id"), F.array(stage).alias("stages"))).alias("workflows")).alias("workflow_context"))
    gold = F.struct(ids("gold_view").alias("gold_next_views"), ids("gold_capability").alias("gold_next_capabilities"))
    return computed(own, {"model_input": given}).select(meta.alias("metadata"), "model_input", gold.alias("gold"))


def log_of(spark: SparkSession, d: str) -> DataFrame:
    """The result log of those records, as text, each line made once."""
    own = sets(spark, d, ("pred_view", "pred_capability"))
    named = F.transform("pred_capability", lambda c: F.when(F.substring(c["id"], 3, 20).cast("long") % 11 == 0, F.concat(F.lit("x:"), F.substring(c["id"], 3, 20))).otherwise(c["id"]))
    lists = [F.transform("pred_view", lambda v: v["id"]).alias("predicted_views"), named.alias("predicted_capabilities")]
    whole = F.to_json(F.struct(F.lit("a goal").alias("predicted_next_goal"), *lists))
    quoted = F.regexp_extract(F.to_json(F.array(whole)), r"(?s)^\[(.*)\]$", 1)
    prediction = case_of("null", "null", '"none"', F.to_json(F.struct(*lists)), F.when(F.col("prefix_length") == "2-HIGH", quoted).otherwise(whole))
    status = case_of("-", "error", "ok", "ok", "ok")
    line = F.concat(F.lit('{"sample_id": "'), F.col("sample_id").cast("string"), F.lit('", "status": "'), status, F.lit('", "prediction": '), prediction, F.lit("}"))
    return computed(own.where(status != "-"), {"line_no": F.col("sample_id"), "value": line}).select("line_no", "value")


CASE = """CASE WHEN o_orderpriority = '5-LOW' AND o_orderstatus = 'F' THEN 'missing_result' WHEN o_orderpriority = '4-NOT SPECIFIED' AND o_orderstatus = 'F' THEN 'result_status_error'
  WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'P' THEN 'prediction_missing_or_non_json' WHEN o_orderpriority = '3-MEDIUM' AND o_orderstatus = 'F' THEN 'schema_invalid' ELSE 'ok' END"""
VALID = DIM.replace("\ndim AS", f"\nst AS (SELECT o_orderkey AS sample_id, {CASE} AS evaluation_status FROM orders),\ndim AS", 1)
VALID = VALID.replace("l_linestatus = 'O' AS pred", "l_linestatus = 'O' AND l_orderkey IN (SELECT sample_id FROM st WHERE evaluation_status = 'ok') AS pred")
VALID = VALID.replace("max(pred::int) AS p, max(gold::int) AS g FROM line WHERE pred OR gold", "max((pred AND l_suppkey % 11 <> 0)::int) AS p, max(gold::int) AS g FROM line WHERE pred OR gold")
#: predicted ids that no hierarchy has count as predicted, and match nothing
UNKNOWN = "ux AS (SELECT l_orderkey AS sample_id, count(DISTINCT l_suppkey) AS u FROM lineitem WHERE l_linestatus = 'O' AND l_suppkey % 11 = 0 GROUP BY 1)"
COUNTED = f"""{VALID}, {UNKNOWN},
cn AS (SELECT sample_id, np + CASE WHEN evaluation_status = 'ok' THEN coalesce(u, 0) ELSE 0 END AS np, ng, e, m
  FROM (SELECT sample_id, coalesce(np, 0) AS np, coalesce(ng, 0) AS ng, coalesce(e, 0) AS e, coalesce(m, 0) AS m FROM sample LEFT JOIN cm USING (sample_id)) JOIN st USING (sample_id) LEFT JOIN ux USING (sample_id))"""
TABLES = BUNDLE.replace(DIM, COUNTED).replace("LEFT JOIN cm x USING", "LEFT JOIN cn x USING")


@query(
    f"""WITH {TABLES}, {SUPPORT},
judge AS (SELECT l_orderkey AS sample_id, count(*) AS n, count_if(l_returnflag <> 'R') AS good, avg(CASE WHEN l_returnflag <> 'R' THEN (l_quantity::BIGINT % 5) / 4.0::DOUBLE END) AS goal FROM lineitem GROUP BY 1),
r AS (SELECT b.*, st.evaluation_status, CASE WHEN st.evaluation_status IN ('ok', 'schema_invalid') THEN coalesce(u, 0) ELSE 0 END AS invalid, s.workflow_view_supported_count, s.workflow_capability_supported_count,
  s.internal_consistency_supported_count, CASE WHEN st.evaluation_status <> 'ok' THEN 0.0::DOUBLE ELSE goal END AS goal_score, n, good
  FROM bundle b JOIN st USING (sample_id) JOIN support s USING (sample_id) JOIN judge USING (sample_id) LEFT JOIN ux USING (sample_id))
SELECT sample_id::VARCHAR AS sample_id, evaluation_status, evaluation_status = 'ok' AS schema_valid, round(view_f1_relaxed, 6) AS view_f1_relaxed, round(capability_precision_strict, 6) AS capability_precision_strict, round(capability_f1_relaxed, 6) AS capability_f1_relaxed, round(structure_score, 6) AS structure_score,
  invalid::BIGINT AS invalid_capability_id_count, workflow_view_supported_count, workflow_capability_supported_count, internal_consistency_supported_count, round(goal_score, 6) AS goal_score,
  CASE WHEN evaluation_status <> 'ok' THEN 'skipped_invalid_prediction' WHEN n = 1 THEN CASE WHEN good = 1 THEN 'ok' ELSE 'error' END WHEN good = n THEN 'multi_run_all_ok' WHEN good = 0 THEN 'multi_run_all_error' ELSE 'multi_run_partial_ok' END AS goal_judge_status,
  round(0.4::DOUBLE * view_f1_relaxed + 0.4::DOUBLE * capability_f1_relaxed + 0.2::DOUBLE * goal_score, 6) AS next_move_score,
  array_to_string(list_filter([CASE WHEN goal_score >= 0.5 AND structure_score < 0.25 THEN 'goal_good_but_structure_low' END, CASE WHEN goal_score < 0.25 AND structure_score >= 0.7 THEN 'structure_good_but_goal_low' END,
    CASE WHEN invalid >= 2 THEN 'many_invalid_ids' END, CASE WHEN view_f1_relaxed - view_f1_strict >= 0.5 OR capability_f1_relaxed - capability_f1_strict >= 0.5 THEN 'strict_low_relaxed_high' END], lambda x: x IS NOT NULL), ';') AS review_reasons
FROM r"""
)
def evaluated_samples(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    manifest = orders.select(F.col("o_orderkey").cast("string").alias("sample_id"), F.lit("case").alias("case_title"), F.col("o_orderstatus").alias("segmentation_mode"), F.lit("target").alias("target_episode_title"))
    li = table(spark, d, "lineitem")
    status = F.when(F.col("l_returnflag") == "R", "error").otherwise("ok")
    runs = li.select(F.col("l_orderkey").cast("string").alias("sample_id"), F.col("l_linenumber").alias("repeat_index"), status.alias("status"), F.when(status == "ok", F.col("l_quantity").cast("long") % 5).alias("judge_score"))
    scores = evaluate(records(spark, d), last_results(log_of(spark, d)), manifest, runs, "judge")
    return rounded(
        scores.select(
            "sample_id", "evaluation_status", "schema_valid", "view_f1_relaxed", "capability_precision_strict", "capability_f1_relaxed", "structure_score", "invalid_capability_id_count", "workflow_view_supported_count",
            "workflow_capability_supported_count", "internal_consistency_supported_count", "goal_score", "goal_judge_status", "next_move_score", F.array_join("review_reasons", ";").alias("review_reasons"),
        )
    )
