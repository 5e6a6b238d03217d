"""Benchmark records from samples, cases and specifications, and what prompts and judges are told of them.

A record's parts are joined by keys; everything inside it is list expressions over the one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import distinct_stripped
from ..functions.frames import matched_rows
from ..functions.text import blank_to_null
from .context import field_of, view_ref

#: Fixed values of the record format.
REQUIREMENTS = {"output_format": "json", "predicted_views_unit": "canonical_subview_or_view_id", "predicted_capabilities_unit": "canonical_capability_id", "workflow_prediction_optional": True, "use_only_ids_from_context": True}
INPUT_MODE = "ordered_episode_images"
EPISODE = ("benchmark_episode_index", "episode_title", "local_goal", "used_views", "used_capabilities")
SCENARIO = ("domain_problem", "analysis_goal", "dataset_context", "initial_question")


def kept(items: Column, rule) -> Column:
    return F.filter(F.coalesce(items, F.array()), rule)


def steps_of(episodes: Column) -> Column:
    """(ref, step) of all steps of a usage case, by '<place of the episode>.<step index>'."""
    ref = lambda i, s: F.concat_ws(".", (i + 1).cast("string"), F.coalesce(s["step_index"], F.lit(0)).cast("string"))
    return F.flatten(F.transform(episodes, lambda e, i: F.transform(F.coalesce(e["steps"], F.array()), lambda s: F.struct(ref(i, s).alias("ref"), s.alias("step")))))


def prefix_step(s: Column) -> Column:
    return F.struct(
        s["step_id"].alias("step_id"), s["step_index"].cast("int").alias("step_index"),
        distinct_stripped(F.transform(s["used_views"], view_ref)).alias("used_views"), distinct_stripped(field_of(s["used_capabilities"], "capability_id")).alias("used_capabilities"),
        F.coalesce(field_of(s["observations"], "description"), F.array().cast("array<string>")).alias("observations"),
        F.coalesce(field_of(s["produced_insights"], "description"), F.array().cast("array<string>")).alias("produced_insights"), blank_to_null(s["outcome_summary"]).alias("outcome_summary"),
    )


def prefix_episode(index: Column) -> Column:
    """The case's episode of an index, the last of equal ones, with the steps that its references name; an error if there is none."""
    found = F.try_element_at(F.filter("episodes", lambda e: e["benchmark_episode_index"] == index), F.lit(-1))

    def of(e: Column) -> Column:
        steps = F.transform(F.coalesce(e["source_step_refs"], F.array().cast("array<string>")), lambda r: F.try_element_at(F.filter("_steps", lambda x: x["ref"] == r), F.lit(-1)))
        return F.struct(
            F.coalesce(e["benchmark_episode_index"], F.raise_error(F.concat(F.lit("no episode "), index.cast("string"), F.lit(" for "), F.col("sample_id"))).cast("int")).alias("benchmark_episode_index"),
            e["benchmark_episode_title"].alias("episode_title"), e["local_goal"].alias("local_goal"), distinct_stripped(e["used_views"]).alias("used_views"),
            distinct_stripped(e["used_capabilities"]).alias("used_capabilities"), distinct_stripped(e["source_step_ids"]).alias("source_step_ids"),
            F.transform(F.filter(steps, lambda x: x.isNotNull()), lambda x: prefix_step(x["step"])).alias("steps"), blank_to_null(e["composite_path"]).alias("image_path"),
        )

    return F.get(F.transform(F.array(found), of), F.lit(0))


def built_records(samples: DataFrame, cases: DataFrame, systems: DataFrame, workflows: DataFrame, usage: DataFrame, instruction: str, schema_version: str, task_name: str) -> DataFrame:
    """(metadata, model_input, gold) of each sample.

    samples: sample_id, benchmark_case_id, paper_name, case_index, prefix (episode indexes), target, target_title, target_image
    and gold_next_goal, gold_next_views, gold_next_capabilities; cases: benchmark_case_id, episodes; systems and workflows:
    paper_name and system_context or workflow_context; usage: paper_name, case_index, scenario, questions, hypotheses,
    usage_episodes. The format's version and the task's name are the caller's. A sample without its case, specifications or episodes is an error when it is read.
    """
    own = matched_rows(samples.withColumn("case_index", F.col("case_index").cast("int")), cases.select("benchmark_case_id", "episodes"), "benchmark_case_id", "no case ")
    own = matched_rows(own, systems.select("paper_name", "system_context"), "paper_name", "no system specification of ")
    own = matched_rows(own, workflows.select("paper_name", "workflow_context"), "paper_name", "no workflow specification of ")
    own = matched_rows(own, usage.select("paper_name", F.col("case_index").cast("int").alias("case_index"), "scenario", "questions", "hypotheses", "usage_episodes"), ["paper_name", "case_index"], "no usage case ")
    own = own.withColumn("_steps", steps_of(F.col("usage_episodes"))).withColumn("prefix", F.transform("prefix", lambda i: i.cast("int")))
    own = own.withColumn("_prefix", F.transform("prefix", prefix_episode))
    both = lambda a, b: lambda x: blank_to_null(x[a]).isNotNull() & blank_to_null(x[b]).isNotNull()
    questions = F.transform(kept(F.col("questions"), both("question_id", "question_text")), lambda q: F.struct(q["question_id"], q["question_text"], blank_to_null(q["status"]).alias("status")))
    hypotheses = F.transform(
        kept(F.col("hypotheses"), both("hypothesis_id", "hypothesis_text")),
        lambda h: F.struct(h["hypothesis_id"], h["hypothesis_text"], blank_to_null(h["status"]).alias("status"), distinct_stripped(h["related_question_ids"]).alias("related_question_ids")),
    )
    scenario = F.struct(*(blank_to_null(F.col("scenario")[c]).alias(c) for c in SCENARIO))
    case = F.struct(scenario.alias("scenario"), questions.alias("questions"), hypotheses.alias("hypotheses"), F.col("_prefix").alias("prefix_episodes"))
    images = F.transform(F.filter("_prefix", lambda e: e["image_path"].isNotNull()), lambda e: F.struct(e["benchmark_episode_index"], e["episode_title"], e["image_path"]))
    visual = F.struct(F.lit(INPUT_MODE).alias("input_mode"), images.alias("prefix_episode_images"))
    given = F.struct(
        F.lit(schema_version).alias("schema_version"), F.lit(task_name).alias("task_name"), "sample_id", F.lit(instruction).alias("task_instruction"), "system_context", "workflow_context",
        case.alias("case_context"), visual.alias("visual_context"), F.struct(*(F.lit(v).alias(k) for k, v in REQUIREMENTS.items())).alias("response_requirements"),
    )
    meta = F.struct("sample_id", "benchmark_case_id", "paper_name", "case_index", F.size("prefix").alias("prefix_length"), F.col("prefix").alias("prefix_episode_indices"), F.col("target").cast("int").alias("target_episode_index"))
    gold = F.struct(
        F.col("target").cast("int").alias("target_episode_index"), F.col("target_title").alias("target_episode_title"), blank_to_null("target_image").alias("target_episode_image_path"),
        "gold_next_goal", *(distinct_stripped(c).alias(c) for c in ("gold_next_views", "gold_next_capabilities")),
    )
    return own.select(meta.alias("metadata"), given.alias("model_input"), gold.alias("gold"))


def prompt_input(model_input: Column | str) -> Column:
    """A model's input with images by their place among those attached instead of their paths."""
    given = F.col(model_input) if isinstance(model_input, str) else model_input
    ref = lambda e, i: F.struct(e["benchmark_episode_index"], e["episode_title"], F.concat(F.lit("attached_image_"), (i + 1).cast("string")).alias("image_ref"))
    return given.withField("visual_context", given["visual_context"].withField("prefix_episode_images", F.transform(given["visual_context"]["prefix_episode_images"], ref)))


def retrieval_prompt(instruction: Column, contract: Column, given: Column, retrieved: Column | None = None) -> Column:
    """Instruction, output contract, input and, if there is any, what was retrieved, each as indented JSON under its heading."""
    told = {"Output JSON contract": contract, "Benchmark input": given} | ({} if retrieved is None else {"Retrieval context": retrieved})
    parts = [F.concat(F.lit(f"{name}:\n"), F.to_json(c, {"ignoreNullFields": "false", "pretty": "true"})) for name, c in told.items()]
    return F.concat(F.concat_ws("\n\n", instruction, *parts), F.lit("\n"))


def judge_payloads(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """(sample_id, payload): what a judge is told of each record with a prediction (sample_id, prediction): the case, its prefix, all
    stages of all workflows in one list, the gold episode and the prediction."""
    given = F.col("model_input")
    case, scenario = given["case_context"], given["case_context"]["scenario"]
    named = lambda x, fields: [x[f].alias(f) for f in fields]
    stage = ("stage_id", "stage_index", "stage_title", "stage_goal", "used_views", "used_capabilities")
    stages = F.flatten(F.transform(given["workflow_context"]["workflows"], lambda w: F.transform(w["stages"], lambda s: F.struct(*named(w, ("workflow_id", "workflow_title")), *named(s, stage)))))
    payload = F.struct(
        F.col("metadata.sample_id").alias("sample_id"), F.col("metadata.paper_name").alias("paper_name"),
        F.struct(*named(scenario, ("domain_problem", "analysis_goal", "initial_question"))).alias("case_summary"),
        F.transform(case["prefix_episodes"], lambda e: F.struct(*named(e, EPISODE))).alias("prefix_episodes"), stages.alias("workflow_stages"),
        F.struct(*named(F.col("gold"), ("target_episode_index", "target_episode_title", "gold_next_goal", "gold_next_views", "gold_next_capabilities"))).alias("gold_next_episode"), F.col("prediction").alias("prediction"),
    )
    own = records.withColumn("sample_id", F.col("metadata.sample_id")).join(predictions.select("sample_id", "prediction"), "sample_id")
    return own.select("sample_id", payload.alias("payload"))
