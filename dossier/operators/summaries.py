"""Summaries of score rows: all rows together and by group, in one pass each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.numbers import ratio, share

#: The metrics whose means over samples a summary has.
MEANS = (
    *(f"{kind}_{metric}_{how}" for kind in ("view", "capability") for how in ("strict", "relaxed") for metric in ("precision", "recall", "f1")),
    "structure_score", "workflow_view_support_rate", "workflow_capability_support_rate", "internal_consistency_rate", "goal_score", "next_move_score",
)
COUNTS = ("completion", "json_valid", "schema_valid", "goal_score_available", "goal_judge_sample_ok")
SUMS = (
    "goal_judge_ok_count", "goal_judge_error_count", "goal_judge_run_count", "invalid_view_id_count", "invalid_capability_id_count", "raw_predicted_view_count",
    "raw_predicted_capability_count", "predicted_view_count", "predicted_capability_count", "workflow_view_supported_count", "workflow_capability_supported_count",
    "internal_consistency_supported_count", "internal_consistency_total_count",
)


def summary_parts(scores: DataFrame) -> list[Column]:
    """The aggregates that `finished` makes a summary of. Columns that the score rows lack are taken as null."""
    have = set(scores.columns)
    own = lambda c: F.col(c) if c in have else F.lit(None).cast("double")
    true = lambda c: F.count_if(own(c).cast("boolean"))
    total = lambda c: F.coalesce(F.sum(own(c).cast("long")), F.lit(0)).cast("long")
    parts: list[Column] = [F.count("*").alias("sample_count")]
    parts += [true(c).alias(f"_n_{c}") for c in COUNTS]
    parts += [total(c).alias(f"_s_{c}") for c in SUMS]
    parts += [F.count_if(own("goal_judge_status").isin("judge_not_configured", "multi_run_not_configured")).alias("goal_judge_not_configured_count")]
    parts += [F.count_if(F.startswith(own("goal_judge_status").cast("string"), F.lit("multi_run_"))).alias("goal_judge_multi_run_count"), true("needs_review").alias("review_queue_count")]
    parts += [true(f"{k}_exact_match").alias(f"_n_{k}_exact_match") for k in ("view", "capability", "joint")]
    return parts + [F.avg(own(m)).alias(m) for m in MEANS]


def finished(grouped: DataFrame, keys: list[str]) -> DataFrame:
    n = "sample_count"
    out = [*(F.col(k) for k in keys), F.col(n)]
    for c in COUNTS:
        name = "completed" if c == "completion" else c
        out += [F.col(f"_n_{c}").alias(f"{name}_count"), share(f"_n_{c}", n).alias(f"{c}_rate")]
    for c in ("ok", "error"):
        out += [F.col(f"_s_goal_judge_{c}_count").alias(f"goal_judge_{c}_count"), ratio(f"_s_goal_judge_{c}_count", "_s_goal_judge_run_count").alias(f"goal_judge_{c}_rate")]
    out += [F.col("_s_goal_judge_run_count").alias("goal_judge_run_count"), F.col("goal_judge_not_configured_count"), F.col("goal_judge_multi_run_count")]
    out += [share(f"_n_{k}_exact_match", n).alias(f"{k}_exact_match_rate") for k in ("view", "capability", "joint")]
    for k in ("view", "capability"):
        out += [F.col(f"_s_invalid_{k}_id_count").alias(f"invalid_{k}_id_count"), ratio(f"_s_invalid_{k}_id_count", f"_s_raw_predicted_{k}_count").alias(f"invalid_{k}_id_rate")]
    out += [ratio(f"_s_workflow_{k}_supported_count", f"_s_predicted_{k}_count").alias(f"workflow_{k}_support_rate_micro") for k in ("view", "capability")]
    out += [ratio("_s_internal_consistency_supported_count", "_s_internal_consistency_total_count").alias("internal_consistency_rate_micro"), F.col("review_queue_count")]
    return grouped.select(*out, *(F.col(m) for m in MEANS))


def as_group(group: str) -> Column:
    return F.coalesce(F.col(group).cast("string"), F.lit("None"))


def summary(scores: DataFrame, group: str | None = None) -> DataFrame:
    """Counts, rates and means of score rows; grouped rows have the group as text (null is 'None') and sort by it.

    Rates over samples are 0 without samples; rates over runs, ids or parts are null without any.
    """
    parts = summary_parts(scores)
    if not group:
        return finished(scores.agg(*parts), [])
    return finished(scores.groupBy(as_group(group).alias(group)).agg(*parts), [group]).orderBy(group)


def all_summaries(scores: DataFrame, groups: tuple[str, ...]) -> DataFrame:
    """(group_by, group_value, ...): the summaries of all rows together (both null) and by each group, in one pass over the scores.
    An empty table has no rows here, as grouping sets have none."""
    keys = [f"_g_{g}" for g in groups]
    named = scores.select("*", *(as_group(g).alias(k) for g, k in zip(groups, keys, strict=True)))
    grouped = named.groupingSets([[], *([k] for k in keys)], *keys).agg(*summary_parts(scores), *(F.grouping(k).alias(f"_off{k}") for k in keys))
    which, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for g, k in zip(groups, keys, strict=True):
        which, value = F.when(F.col(f"_off{k}") == 0, g).otherwise(which), F.when(F.col(f"_off{k}") == 0, F.col(k)).otherwise(value)
    return finished(grouped.withColumn("group_by", which).withColumn("group_value", value), ["group_by", "group_value"])


def repeat_summary(runs: DataFrame) -> DataFrame:
    """Judge repeats of each sample: spread of the scores, counts by status, the first run's rationale and one status for all.

    runs: (sample_id, repeat_index, status, judge_score, rationale). A sample that was never run has no row here.
    """
    ok = F.coalesce(F.col("status").isin("ok", "cached"), F.lit(False))
    goal = F.col("judge_score").cast("double") / 4.0
    grouped = runs.groupBy("sample_id").agg(
        F.count("*").alias("run_count"),
        F.count_if(ok).alias("ok_count"),
        F.count_if(~ok).alias("error_count"),
        F.avg(goal).alias("goal_score_mean"),
        F.stddev_pop(goal).alias("goal_score_std"),
        F.min(goal).alias("goal_score_min"),
        F.max(goal).alias("goal_score_max"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("judge_score").isNotNull(), F.struct("repeat_index", goal.alias("s"))))), lambda x: x["s"]).alias("goal_scores"),
        F.min_by("rationale", "repeat_index").alias("rationale"),
        run_status().alias("status"),
    )
    return grouped


def run_status() -> Column:
    """One status for all runs of a sample; answers from the cache count as ok."""
    status = F.coalesce("status", F.lit("not_run"))
    n, least, most, ok = F.count("*"), F.min(status), F.max(status), F.count_if(status.isin("ok", "cached"))
    return (
        F.when(n == 0, "not_run")
        .when(n == 1, least)
        .when(ok == n, "multi_run_all_ok")
        .when(ok > 0, "multi_run_partial_ok")
        .when((least == most) & (least == "judge_not_configured"), "multi_run_not_configured")
        .when((least == most) & (least == "skipped_invalid_prediction"), "multi_run_skipped_invalid_prediction")
        .otherwise("multi_run_all_error")
    )


def repeated(samples: DataFrame, times: int) -> DataFrame:
    """Each sample with repeat_index 1..times, once at least."""
    return samples.withColumn("repeat_index", F.explode(F.sequence(F.lit(1), F.lit(max(1, times)))))


def review_reasons() -> Column:
    """Why a score row should be looked at, in a fixed order."""
    gap = lambda k: F.col(f"{k}_f1_relaxed") - F.col(f"{k}_f1_strict") >= 0.5
    rules = (
        ("goal_good_but_structure_low", (F.col("goal_score") >= 0.5) & (F.col("structure_score") < 0.25)),
        ("structure_good_but_goal_low", (F.col("goal_score") < 0.25) & (F.col("structure_score") >= 0.7)),
        ("many_invalid_ids", F.col("invalid_view_id_count") + F.col("invalid_capability_id_count") >= 2),
        ("strict_low_relaxed_high", gap("view") | gap("capability")),
    )
    return F.filter(F.array(*(F.when(rule, name) for name, rule in rules)), lambda r: r.isNotNull())


def last_wins(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """The last row of each key."""
    n = F.row_number().over(W.Window.partitionBy(key).orderBy(*(F.desc(o) for o in order)))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")


def first_wins(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The first row of each key."""
    n = F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", n).where("_n = 1").drop("_n")
