"""The evaluator: benchmark records, a result log, a manifest and judge runs become one score row for each record.

A record holds its own hierarchy, workflows and gold lists, so everything about one sample is computed in its row, with list
expressions: nothing but the joins by sample is shuffled. Lists are those of one record and its prediction, a few dozen
entries. Best matchings have the closed form of `matching`: what is equal, then what is left in the same part of the
hierarchy, from the bottom up.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import distinct_stripped, or_empty, strings_of
from ..functions.frames import computed, matched_rows
from ..functions.jsonx import payload, string_field
from ..functions.numbers import f1, next_move_score, precision_of, ratio, recall_of, structure_score
from ..functions.text import let
from .ids import IDENTIFIER
from .resultlog import evaluation_status
from .summaries import repeat_summary, review_reasons

KINDS = ("view", "capability")
CAPABILITY = "struct<id: string, subview_id: string, view_id: string>"
VIEW = "struct<id: string, view_id: string>"


# ---------------------------------------------------------------- matching of lists


def common(p: Column, g: Column, key: str) -> Column:
    """Pairs that two lists of structs can form within equal keys."""
    count = lambda items, k: F.size(F.filter(items, lambda x: x[key] == k)).cast("long")
    keys = F.array_distinct(F.transform(p, lambda x: x[key]))
    return F.aggregate(keys, F.lit(0).cast("long"), lambda n, k: n + F.least(count(p, k), count(g, k)))


def crossed(p: Column, g: Column) -> Column:
    """Pairs of a view in one list and one of its subviews in the other."""
    views = lambda items: F.filter(items, lambda x: x["id"] == x["view_id"])
    parts = lambda items: F.filter(items, lambda x: x["id"] != x["view_id"])
    return common(views(p), parts(g), "view_id") + common(views(g), parts(p), "view_id")


def with_matches(df: DataFrame) -> DataFrame:
    """df with <kind>_n_pred, _n_gold, _exact and _matched, from lists without repeats in pred_<kind> and gold_<kind> (structs VIEW
    and CAPABILITY; an id outside the hierarchy is its own view and subview)."""
    rest = {f"_{a}_{k}": F.array_except(f"{b}_{k}", f"{c}_{k}") for k in KINDS for a, b, c in (("p", "pred", "gold"), ("g", "gold", "pred"))}
    df, out = computed(df, rest), {}
    for k in KINDS:
        p, g = F.col(f"_p_{k}"), F.col(f"_g_{k}")
        n = F.size(f"pred_{k}").cast("long")
        exact = n - F.size(p)
        more = 0.5 * crossed(p, g) if k == "view" else 0.25 * common(p, g, "subview_id") + 0.25 * common(p, g, "view_id")
        out |= {f"{k}_n_pred": n, f"{k}_n_gold": F.size(f"gold_{k}").cast("long"), f"{k}_exact": exact.cast("double"), f"{k}_matched": exact + more}
    return computed(df, out).drop(*rest)


def with_structure(df: DataFrame) -> DataFrame:
    """df (with matches) with strict and relaxed scores, exact matches and the structure score."""
    for k in KINDS:
        for how, matched in (("strict", f"{k}_exact"), ("relaxed", f"{k}_matched")):
            p, r = precision_of(matched, f"{k}_n_pred", f"{k}_n_gold"), recall_of(matched, f"{k}_n_pred", f"{k}_n_gold")
            df = df.withColumns({f"{k}_precision_{how}": p, f"{k}_recall_{how}": r})
            df = df.withColumn(f"{k}_f1_{how}", f1(f"{k}_precision_{how}", f"{k}_recall_{how}"))
        df = df.withColumn(f"{k}_exact_match", (F.col(f"{k}_exact") == F.col(f"{k}_n_pred")) & (F.col(f"{k}_exact") == F.col(f"{k}_n_gold")))
    df = df.withColumn("joint_exact_match", F.col("view_exact_match") & F.col("capability_exact_match"))
    return df.withColumn("structure_score", structure_score("view_f1_relaxed", "capability_f1_relaxed"))


def with_support(df: DataFrame) -> DataFrame:
    """df (with matches) with what of the prediction the workflows use (lists used_view of structs VIEW and used_capability of ids),
    and which capabilities have a predicted parent."""
    view = lambda v: F.exists("used_view", lambda u: (u["id"] == v["id"]) | (u["id"] == v["view_id"]) | ((v["id"] == v["view_id"]) & (u["view_id"] == v["id"])))
    parent = lambda c: F.exists("pred_view", lambda v: (v["id"] == c["subview_id"]) | (v["id"] == c["view_id"]))
    count = lambda items, rule: F.size(F.filter(items, rule)).cast("long")
    counts = {
        "predicted_view_count": F.col("view_n_pred"),
        "predicted_capability_count": F.col("capability_n_pred"),
        "workflow_view_supported_count": count("pred_view", view),
        "workflow_capability_supported_count": count("pred_capability", lambda c: F.array_contains("used_capability", c["id"])),
        "internal_consistency_supported_count": count("pred_capability", parent),
        "internal_consistency_total_count": F.col("capability_n_pred"),
    }
    return computed(df, counts).withColumns(
        {
            "workflow_view_support_rate": ratio("workflow_view_supported_count", "predicted_view_count"),
            "workflow_capability_support_rate": ratio("workflow_capability_supported_count", "predicted_capability_count"),
            "internal_consistency_rate": ratio("internal_consistency_supported_count", "predicted_capability_count"),
        }
    )


def with_reviews(df: DataFrame) -> DataFrame:
    """df with the next-move score, why a row should be reviewed, and whether."""
    df = df.withColumn("next_move_score", next_move_score("view_f1_relaxed", "capability_f1_relaxed", "goal_score")).withColumn("review_reasons", review_reasons())
    return df.withColumn("needs_review", F.size("review_reasons") > 0)


# ---------------------------------------------------------------- lists of a record


def parts_of(views: Column) -> tuple[Column, Column, Column]:
    """(ids of views, subviews as VIEW, capabilities as CAPABILITY) of nested views."""
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    under = lambda v: F.transform(v["subviews"], lambda s: F.struct(s["subview_id"].alias("id"), v["view_id"].alias("view_id")))
    of_sub = lambda v, s: F.transform(s["capabilities"], lambda c: F.struct(c["capability_id"].alias("id"), s["subview_id"].alias("subview_id"), v["view_id"].alias("view_id")))
    own = none(F.transform(views, lambda v: v["view_id"]), "array<string>")
    subs = none(F.flatten(F.transform(views, lambda v: none(under(v), f"array<{VIEW}>"))), f"array<{VIEW}>")
    caps = F.flatten(F.transform(views, lambda v: none(F.flatten(F.transform(v["subviews"], lambda s: none(of_sub(v, s), f"array<{CAPABILITY}>"))), f"array<{CAPABILITY}>")))
    return own, subs, none(caps, f"array<{CAPABILITY}>")


def last_of(items: str, wanted: Column) -> Column:
    """The last entry of a list with this id."""
    return F.try_element_at(F.filter(items, lambda x: x["id"] == wanted), F.lit(-1))


def placed_views(ids: Column | str) -> Column:
    """Ids as VIEW: a subview with its view, everything else with itself."""
    return F.transform(ids, lambda i: F.struct(i.alias("id"), F.coalesce(last_of("_subviews", i)["view_id"], i).alias("view_id")))


def placed_capabilities(ids: Column | str) -> Column:
    found = lambda i, c, level: F.coalesce(c[level], F.concat(F.lit("?"), i)).alias(level)
    return F.transform(ids, lambda i: let(last_of("_capabilities", i), lambda c: F.struct(i.alias("id"), found(i, c, "subview_id"), found(i, c, "view_id"))))


# ---------------------------------------------------------------- predictions


def valid_prediction(p: Column | str) -> Column:
    """Whether a prediction (a variant) has the required form: a goal that is a text, lists of identifiers, a stage with both ids, a
    confidence from 0 to 1, and evidence items that name paper, kind and reason. Missing lists are empty; a null list isn't one.
    Its parts are read once."""
    p = F.col(p) if isinstance(p, str) else p
    kind = F.schema_of_variant
    absent = lambda v: v.isNull() | F.is_variant_null(v)
    text = lambda v: F.coalesce(kind(v) == "STRING", F.lit(False))
    name = lambda v: F.when(text(v), F.coalesce(F.try_variant_get(v, "$", "string").rlike(IDENTIFIER), F.lit(False))).otherwise(False)
    parts = lambda v, *names: F.try_variant_get(v, "$", f"struct<{', '.join(f'{n}: variant' for n in names)}>")

    def each(v: Column, rule) -> Column:
        return v.isNull() | F.coalesce(F.forall(F.try_variant_get(v, "$", "array<variant>"), rule), F.lit(False))

    def evidence(v: Column) -> Column:
        own = lambda e: text(e["paper_name"]) & text(e["source_type"]) & text(e["reason"]) & (absent(e["source_id"]) | text(e["source_id"]))
        return let(parts(v, "paper_name", "source_type", "source_id", "reason"), own)

    def rules(x: Column) -> Column:
        stage, sure = x["predicted_workflow_stage"], x["confidence"]
        number = F.try_variant_get(sure, "$", "double")
        staged = let(parts(stage, "workflow_id", "stage_id"), lambda s: name(s["workflow_id"]) & name(s["stage_id"]))
        own = (
            text(x["predicted_next_goal"]),
            each(x["predicted_views"], name),
            each(x["predicted_capabilities"], name),
            absent(stage) | staged,
            absent(x["rationale"]) | text(x["rationale"]),
            absent(sure) | F.coalesce((number >= 0) & (number <= 1), F.lit(False)),
            each(x["retrieved_evidence"], evidence),
        )
        return reduce(Column.__and__, own)

    fields = ("predicted_next_goal", "predicted_views", "predicted_capabilities", "predicted_workflow_stage", "rationale", "confidence", "retrieved_evidence")
    return F.coalesce(let(parts(p, *fields), rules), F.lit(False))


# ---------------------------------------------------------------- judges


JUDGED = {"error": "string", "rationale": "string", "same_stage_as_gold": "boolean", "reasonable_alternative": "boolean", "confidence": "double"}


def judged(runs: DataFrame) -> DataFrame:
    """One row for each sample of what its judge runs (sample_id, repeat_index, status, judge_score and, if there, the columns
    JUDGED) say together; scores by the rules of `repeat_summary`, everything else is the first run's."""
    own = runs.withColumns({c: F.lit(None).cast(t) for c, t in JUDGED.items() if c not in runs.columns})
    run = F.struct("repeat_index", "status", F.col("judge_score").cast("double").alias("judge_score"), *JUDGED)
    first = own.groupBy("sample_id").agg(F.array_sort(F.collect_list(run)).alias("runs"))
    return repeat_summary(own).drop("rationale").join(first, "sample_id")


def judge_columns(valid: Column, judge: bool, skip: bool) -> dict[str, Column]:
    """What a score row says of its judge: why there is no run, or what the runs say together."""
    why = F.when(~valid, "skipped_invalid_prediction") if not skip else F.when(F.lit(True), "skipped_by_flag")
    if not skip and not judge:
        why = why.otherwise("judge_not_configured")
    ran = F.lit(judge and not skip) & valid & F.col("j.run_count").isNotNull()
    zero = F.lit(not skip) & ~valid
    score = lambda c: F.when(zero, 0.0).when(ran, c)
    none = F.array().cast("array<double>")
    first = lambda c: F.when(ran, F.get("j.runs", F.lit(0))[c])
    spread = lambda c: F.when(ran, F.col(f"j.goal_score_{c}"))
    out = {
        "goal_judge_status": F.when(ran, F.col("j.status")).otherwise(F.coalesce(why, F.lit("not_run"))),
        "goal_judge_run_count": F.when(ran, F.col("j.run_count")).otherwise(1).cast("long"),
        "goal_judge_ok_count": F.when(ran, F.col("j.ok_count")).otherwise(0).cast("long"),
        "goal_judge_error_count": F.when(ran, F.col("j.error_count")).otherwise(1).cast("long"),
        "goal_score": score(F.col("j.goal_score_mean")),
        "goal_score_std": spread("std"),
        "goal_score_min": score(F.col("j.goal_score_min")),
        "goal_score_max": score(F.col("j.goal_score_max")),
        "goal_score_runs": F.when(zero, F.array(F.lit(0.0))).when(ran, F.col("j.goal_scores")).otherwise(none),
    }
    for c in ("std", "min", "max"):
        out[f"judge_score_{c}"] = 4 * out[f"goal_score_{c}"]
    out |= {"judge_score": 4 * out["goal_score"], "judge_score_runs": F.transform(out["goal_score_runs"], lambda s: 4 * s)}
    return out | {f"goal_judge_{c}": first(c) for c in JUDGED} | {"goal_judge_runs": F.when(ran, F.col("j.runs"))}


# ---------------------------------------------------------------- score rows


def evaluate(records: DataFrame, results: DataFrame, manifest: DataFrame, judge_runs: DataFrame | None = None, judge_model: str | None = None, skip_judge: bool = False) -> DataFrame:
    """A score row for each record (metadata, model_input, gold).

    results: (sample_id, row VARIANT), the last good row of each sample; a sample without one is a missing result. manifest:
    sample_id, case_title, segmentation_mode, target_episode_title; a record without a row there is an error when rows are
    read. judge_runs: what a judge said of valid predictions; None if no judge is configured. With skip_judge nothing is
    said of judges and an invalid prediction has no score either, else it scores 0.
    """
    own = records.select(F.col("metadata.sample_id").alias("sample_id"), "metadata", "model_input", "gold")
    own = matched_rows(own, manifest.select("sample_id", "case_title", "segmentation_mode", "target_episode_title"), "sample_id", "no manifest row for ")
    own = own.join(results.select("sample_id", "row", F.lit(True).alias("_found")), "sample_id", "left")

    views, subs, caps = parts_of(F.col("model_input.system_context.views"))
    stages = F.flatten(F.transform("model_input.workflow_context.workflows", lambda w: F.transform(w["stages"], lambda s: F.struct(w["workflow_id"].alias("workflow_id"), s["stage_id"].alias("stage_id"), s["used_views"].alias("views"), s["used_capabilities"].alias("capabilities")))))
    df = computed(own, {"_views": views, "_subviews": subs, "_capabilities": caps, "_stages": stages, "raw_result_status": string_field("row", "status"), "_prediction": payload(F.try_variant_get("row", "$.prediction", "variant"))})
    found = F.coalesce("_found", F.lit(False))
    valid = found & F.coalesce(F.col("raw_result_status") == "ok", F.lit(False)) & F.col("_prediction").isNotNull() & valid_prediction("_prediction")
    raw = {k: strings_of(F.try_variant_get("_prediction", f"$.predicted_{n}", "variant")) for k, n in (("view", "views"), ("capability", "capabilities"))}
    df = computed(df, {"schema_valid": valid, **{f"_raw_{k}": c for k, c in raw.items()}})
    place = {"view": placed_views, "capability": placed_capabilities}
    used = lambda what: F.array_distinct(F.flatten(F.transform("_stages", lambda s: or_empty(s[what]))))
    none = F.array().cast("array<string>")
    lists = {f"pred_{k}": place[k](F.when(F.col("schema_valid"), F.col(f"_raw_{k}")).otherwise(none)) for k in KINDS}
    lists |= {f"gold_{k}": place[k](distinct_stripped(F.col(f"gold.gold_next_{n}"))) for k, n in (("view", "views"), ("capability", "capabilities"))}
    df = computed(df, {**lists, "used_view": placed_views(F.coalesce(used("views"), none)), "used_capability": F.coalesce(used("capabilities"), none)})
    known = {"view": F.array_union("_views", F.transform("_subviews", lambda s: s["id"])), "capability": F.transform("_capabilities", lambda c: c["id"])}
    df = df.withColumns({f"invalid_{k}_ids": F.array_except(f"_raw_{k}", known[k]) for k in KINDS})

    stage = {c: F.when(F.col("schema_valid"), F.try_variant_get("_prediction", f"$.predicted_workflow_stage.{c}", "string")) for c in ("workflow_id", "stage_id")}
    pair = F.struct(*(c.alias(n) for n, c in stage.items()))
    in_order = F.exists("_stages", lambda s: (s["workflow_id"] == stage["workflow_id"]) & (s["stage_id"] == stage["stage_id"]))
    df = df.withColumns(
        {
            "predicted_workflow_stage": F.when(stage["stage_id"].isNotNull(), pair),
            "workflow_stage_valid": F.when(stage["stage_id"].isNotNull(), F.coalesce(in_order, F.lit(False))),
            "evaluation_status": evaluation_status(found, F.col("raw_result_status"), F.col("_prediction"), F.col("schema_valid")),
            "status": F.coalesce(F.nullif("raw_result_status", F.lit("")), F.lit("missing_result")),
            "completion": found & F.coalesce(F.col("raw_result_status") == "ok", F.lit(False)),
            "json_valid": F.col("_prediction").isNotNull(),
            "prediction": F.to_json("_prediction"),
            **{f"invalid_{k}_id_count": F.size(f"invalid_{k}_ids").cast("long") for k in KINDS},
            **{f"raw_predicted_{k}_count": F.size(f"_raw_{k}").cast("long") for k in KINDS},
        }
    )
    df = with_support(with_structure(with_matches(df)))
    if judge_runs is None:
        empty = "run_count long, ok_count long, error_count long, goal_score_mean double, goal_score_std double, goal_score_min double, goal_score_max double, goal_scores array<double>, status string"
        run = ", ".join(f"{c}: {t}" for c, t in {"repeat_index": "int", "status": "string", "judge_score": "double", **JUDGED}.items())
        df = df.withColumn("j", F.lit(None).cast(f"struct<{', '.join(c.replace(' ', ': ', 1) for c in empty.split(', '))}, runs: array<struct<{run}>>>"))
    else:
        held = judged(judge_runs)
        df = df.join(held.select("sample_id", F.struct(*(c for c in held.columns if c != "sample_id")).alias("j")), "sample_id", "left")
    df = df.withColumns(judge_columns(F.col("schema_valid"), judge_runs is not None, skip_judge)).withColumn("goal_judge_model", F.lit(None if skip_judge else judge_model).cast("string"))
    df = df.withColumns({"goal_score_available": F.col("goal_score").isNotNull(), "goal_judge_sample_ok": F.col("goal_judge_ok_count") > 0})
    df = with_reviews(df)
    about = [F.col(f"metadata.{c}").alias(c) for c in ("benchmark_case_id", "paper_name", "case_index", "prefix_length", "prefix_episode_indices", "target_episode_index")]
    inner = {"j", "row", "_found", "metadata", *(f"{a}_{k}" for k in KINDS for a in ("pred", "gold", "used")), *(f"{k}_{c}" for k in KINDS for c in ("n_pred", "n_gold", "exact", "matched"))}
    return df.select("sample_id", *about, *(c for c in df.columns if c != "sample_id" and c not in inner and not c.startswith("_")))


def judge_run_rows(scores: DataFrame) -> DataFrame:
    """A row for each judge run of each score row; one that tells why there was none."""
    single = F.array(F.struct(F.lit(1).alias("repeat_index"), F.col("goal_judge_status").alias("status"), F.col("judge_score").alias("judge_score"), *(F.lit(None).cast(t).alias(c) for c, t in JUDGED.items())))
    kind = ", ".join(f"{c}: {t}" for c, t in {"repeat_index": "int", "status": "string", "judge_score": "double", **JUDGED}.items())
    runs = F.coalesce(F.col("goal_judge_runs").cast(f"array<struct<{kind}>>"), single.cast(f"array<struct<{kind}>>"))
    each = scores.select("sample_id", "benchmark_case_id", "paper_name", "goal_judge_model", F.explode(runs).alias("r"))
    named = {"status": "goal_judge_status", **{c: f"goal_judge_{c}" for c in JUDGED}}
    return each.select("sample_id", "benchmark_case_id", "paper_name", "r.repeat_index", "goal_judge_model", *(F.col(f"r.{c}").alias(n) for c, n in named.items()), "r.judge_score", (F.col("r.judge_score") / 4).alias("goal_score"))
