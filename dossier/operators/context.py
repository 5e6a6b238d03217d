"""Contexts for prompts: normalized trees, workflows, prefixes of cases, payloads and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.arrays import distinct_stripped, or_empty
from ..functions.frames import matched_rows
from ..functions.text import blank_to_null


def view_ref(ref: Column) -> Column:
    """The subview of a reference, or its view."""
    return F.coalesce(blank_to_null(ref["subview_id"]), blank_to_null(ref["view_id"]))


def field_of(items: Column, key: str) -> Column:
    """One field of a list of structs, without nulls and empty texts."""
    return F.filter(F.transform(items, lambda x: blank_to_null(x[key])), lambda x: x.isNotNull())


def system_context(views: Column | str) -> Column:
    """Views with subviews with capabilities: parts without an id go, a missing name is the id, empty texts are null, null lists empty."""
    v = F.col(views) if isinstance(views, str) else views

    def named(x: Column, level: str) -> list[Column]:
        own = blank_to_null(x[f"{level}_id"])
        return [own.alias(f"{level}_id"), F.coalesce(blank_to_null(x[f"{level}_name"]), own).alias(f"{level}_name"), blank_to_null(x["description"]).alias("description")]

    has = lambda level: lambda x: blank_to_null(x[f"{level}_id"]).isNotNull()
    caps = lambda s: F.transform(F.filter(F.coalesce(s["capabilities"], F.array()), has("capability")), lambda c: F.struct(*named(c, "capability")))
    subs = lambda x: F.transform(F.filter(F.coalesce(x["subviews"], F.array()), has("subview")), lambda s: F.struct(*named(s, "subview"), caps(s).alias("capabilities")))
    return F.transform(F.filter(F.coalesce(v, F.array()), has("view")), lambda x: F.struct(*named(x, "view"), subs(x).alias("subviews")))


def coordinations(items: Column | str) -> Column:
    """Coordinations of a system (coordination_id, coordination_type, evidence.reasoning, source and targets as references): those without
    an id go, the reason is the description, references become ids, targets once each."""
    given = F.filter(F.coalesce(F.col(items) if isinstance(items, str) else items, F.array()), lambda c: blank_to_null(c["coordination_id"]).isNotNull())
    return F.transform(
        given,
        lambda c: F.struct(
            c["coordination_id"].alias("coordination_id"), blank_to_null(c["coordination_type"]).alias("coordination_type"), blank_to_null(c["evidence"]["reasoning"]).alias("description"),
            view_ref(c["source"]).alias("source_id"), distinct_stripped(F.transform(F.coalesce(c["targets"], F.array()), view_ref)).alias("target_ids"),
        ),
    )


def workflow_context(stages: DataFrame, transitions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stages of named workflows and transitions between named stages; rows without those ids go. What a stage uses, its views,
    capabilities and coordinations, are lists of ids, or of references to views and structs with an id."""
    kept = stages.where("coalesce(workflow_id, '') <> '' and coalesce(stage_id, '') <> ''")
    kept = kept.withColumn("stage_title", F.coalesce(blank_to_null("stage_title"), F.col("stage_id")))
    ids = {"used_views": view_ref, "used_capabilities": lambda x: x["capability_id"], "used_coordinations": lambda x: x["coordination_id"]}
    for column, id_of in ids.items():
        if column in stages.columns:
            plain = stages.schema[column].dataType.elementType.typeName() == "string"
            kept = kept.withColumn(column, distinct_stripped(column if plain else F.transform(column, id_of)))
    return kept, transitions.where("coalesce(source_stage_id, '') <> '' and coalesce(target_stage_id, '') <> ''")


def first_match(rows: DataFrame, wanted: DataFrame, keys: list[str], order: str) -> DataFrame:
    """wanted with the first row of the same keys; one without is an error when it is read."""
    first = rows.withColumn("_n", F.row_number().over(W.Window.partitionBy(*keys).orderBy(order))).where("_n = 1").drop("_n")
    return matched_rows(wanted, first, keys, "no row for ")


def nth(items: Column, n: Column) -> Column:
    """The n-th of a list, counted from 1; null outside."""
    return F.when((n >= 1) & (n <= F.size(items)), F.get(items, n.cast("int") - 1))


def steps_by_ref(episodes: DataFrame) -> DataFrame:
    """(case_id, ref, step): steps by '<episode>.<index>'; episodes: (case_id, episode, steps array<struct<step_index, ...>>), the last of equal refs wins."""
    flat = episodes.select("case_id", "episode", F.posexplode("steps").alias("p", "step"))
    ref = F.concat_ws(".", F.col("episode").cast("string"), F.coalesce(F.col("step.step_index"), F.lit(0)).cast("string"))
    return flat.select("case_id", ref.alias("ref"), "p", "step").withColumn("_n", F.row_number().over(W.Window.partitionBy("case_id", "ref").orderBy(F.desc("p")))).where("_n = 1").drop("_n", "p")


def prefix_episodes(samples: DataFrame, episodes: DataFrame, strict: bool = True) -> DataFrame:
    """(sample_id, place, episode...) of each sample's prefix; samples: (sample_id, case_id, prefix array<int>), episodes: (case_id, episode, ...).

    An episode that the case lacks is an error when it is read; strict=False leaves it out.
    """
    asked = samples.select("sample_id", "case_id", F.posexplode("prefix").alias("place", "episode"))
    keys = ["case_id", "episode"]
    return matched_rows(asked, episodes, keys, "no episode for ") if strict else asked.join(episodes, keys)


def attached(images: Column) -> Column:
    """Image paths replaced by attached_image_1, attached_image_2, ... in their order."""
    return F.transform(images, lambda x, i: x.withField("image_path", F.concat(F.lit("attached_image_"), (i + 1).cast("string"))))


def with_images(episodes: Column) -> Column:
    return F.filter(or_empty(episodes, "array<struct<image_path: string>>") if isinstance(episodes, str) else episodes, lambda e: blank_to_null(e["image_path"]).isNotNull())


def prompt(instruction: Column, context: Column) -> Column:
    """Instruction and context as one text; nulls are kept and characters as they are."""
    return F.concat(instruction, F.lit("\n\nContext (JSON):\n"), F.to_json(context, {"ignoreNullFields": "false"}))


def judge_payload(views: Column) -> Column:
    """All subviews of all views in one list, each with its view's id."""
    return F.flatten(F.transform(views, lambda v: F.transform(v["subviews"], lambda s: F.struct(v["view_id"].alias("view_id"), s["subview_id"].alias("subview_id")))))
