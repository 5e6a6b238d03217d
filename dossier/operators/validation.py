"""Integrity checks: each gives a table of violations (entity_id, rule, message) instead of stopping at the first."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import distinct_ignoring_case
from ..functions.text import blank_to_null, slug
from .ids import unique_ids
from .summaries import first_wins

VIOLATION = "entity_id string, rule string, message string"


def violations(rows: DataFrame, entity: Column, rules: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row for each rule (broken, message) that an entity breaks; a null condition isn't broken. One pass over the rows."""
    told = F.array(*(F.when(F.coalesce(broken, F.lit(False)), F.struct(F.lit(name).alias("rule"), message.alias("message"))) for name, (broken, message) in rules.items()))
    return rows.select(entity.cast("string").alias("entity_id"), F.explode(F.array_compact(told)).alias("v")).select("entity_id", "v.rule", "v.message")


def unknown_refs(refs: DataFrame, known: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """References (entity_id and keys) that have no row in known."""
    label = F.concat_ws("/", *(F.col(k).cast("string") for k in keys))
    return refs.join(known.select(*keys).distinct(), keys, "left_anti").select(F.col("entity_id").cast("string").alias("entity_id"), F.lit(rule).alias("rule"), label.alias("message"))


def normalized_evidence(rows: DataFrame) -> DataFrame:
    """Evidence lists without repeats (case aside), and whether at least one kind of evidence is there."""
    out = rows.withColumn("figure_refs", distinct_ignoring_case("figure_refs")).withColumn("quotes", distinct_ignoring_case("quotes"))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    return out.withColumn("has_evidence", some("passage_ids") | some("figure_refs") | some("quotes"))


def any_given(rows: DataFrame, *columns: str) -> Column:
    """Whether a text is not empty, a list has an entry or a struct is there; columns that the rows lack count as missing."""

    def given(name: str) -> Column:
        kind = rows.schema[name].dataType
        if isinstance(kind, T.ArrayType | T.MapType):
            return F.coalesce(F.size(name) > 0, F.lit(False))
        if isinstance(kind, T.StringType):
            return F.coalesce(F.length(name) > 0, F.lit(False))
        return F.col(name).isNotNull()

    return reduce(Column.__or__, (given(c) for c in columns if c in rows.columns), F.lit(False))


def category_pair_ok(outer: Column, inner: Column) -> Column:
    """The inner category begins with the letter of the outer one; others(...) may stand anywhere."""
    free = outer.startswith("others(") | inner.startswith("others(")
    return free | (F.substring(inner, 1, 1) == F.substring(outer, 1, 1))


def either_style(kind: Column, style: Column, other: Column) -> Column:
    """A visualization has a style and no other description, everything else the other one and no style."""
    visual = kind == "visualization"
    return F.when(visual, style.isNotNull() & other.isNull()).otherwise(other.isNotNull() & style.isNull())


#: The fields of a step of which one at least must say something.
SEMANTIC = (
    "question_events", "hypothesis_events", "intent_canonical", "intent_text", "strategy_canonical", "strategy_text", "operation_canonical", "operation_text", "used_capabilities", "observations",
    "produced_insights", "decision", "outcome_summary",
)


def step_rules(rows: DataFrame) -> dict[str, tuple[Column, Column]]:
    """Rules of steps (narrative, evidence and the columns SEMANTIC)."""
    return {
        "narrative_or_evidence": (F.col("narrative").isNull() & F.col("evidence").isNull(), F.lit("a step needs a narrative or evidence")),
        "semantic_field": (~any_given(rows, *SEMANTIC), F.lit("a step needs a semantic field")),
    }


def coordination_rules() -> dict[str, tuple[Column, Column]]:
    """Rules of coordinations: source and targets (structs view_id, subview_id) and their capabilities (with capability_id) are
    known (lists known_views and known_capabilities of the same record), and a capability is one of its own end's."""
    same = lambda x, y, fields: reduce(Column.__and__, (x[f].eqNullSafe(y[f]) for f in fields))
    place, part = ("view_id", "subview_id"), ("view_id", "subview_id", "capability_id")
    among = lambda x, items, fields: F.coalesce(F.exists(items, lambda k: same(k, x, fields)), F.lit(False))
    name = lambda x, fields: F.concat_ws("/", *(F.coalesce(x[f], F.lit("-")) for f in fields))
    outside = lambda items, rule: F.filter(F.coalesce(F.col(items), F.array()), lambda x: ~rule(x))
    source, own = F.col("source"), F.col("source_capability")
    bad = {
        "target": (outside("targets", lambda x: among(x, "known_views", place)), place),
        "target_capability": (outside("target_capabilities", lambda x: among(x, "known_capabilities", part)), part),
        "target_capability_parent": (outside("target_capabilities", lambda x: among(x, "targets", place)), part),
    }
    told = {k: (F.size(items) > 0, F.array_join(transformed(items, name, fields), ",")) for k, (items, fields) in bad.items()}
    return {
        "source": (~among(source, "known_views", place), name(source, place)),
        "source_capability": (own.isNotNull() & ~among(own, "known_capabilities", part), name(own, part)),
        "source_capability_parent": (own.isNotNull() & ~same(own, source, place), name(own, part)),
        "some_capability": (own.isNull() & (F.size(F.coalesce("target_capabilities", F.array())) == 0), F.lit("a coordination needs a capability")),
        **told,
    }


def transformed(items: Column, name, fields: tuple[str, ...]) -> Column:
    return F.transform(items, lambda x: name(x, fields))


def workflow_violations(workflows: DataFrame, stages: DataFrame, transitions: DataFrame) -> DataFrame:
    """Workflows (workflow_id) without a stage, stages (workflow_id, stage_id, pos, stage_index) whose index isn't their place, and
    transitions (workflow_id, source_stage_id, target_stage_id) from or to a stage that the workflow lacks."""
    entity = F.concat_ws("/", "workflow_id", "stage_id")
    misplaced = violations(stages, entity, {"stage_index": (F.col("stage_index") != F.col("pos"), F.concat_ws(" is not ", F.col("stage_index").cast("string"), F.col("pos").cast("string")))})
    out = childless(workflows.withColumnRenamed("workflow_id", "_w"), stages.withColumnRenamed("workflow_id", "_w"), "_w").unionByName(misplaced)
    for end in ("source", "target"):
        refs = transitions.select(F.col("workflow_id").alias("entity_id"), "workflow_id", F.col(f"{end}_stage_id").alias("stage_id"))
        out = out.unionByName(unknown_refs(refs, stages, ["workflow_id", "stage_id"], f"{end}_stage"))
    return out


def distinct_transitions(transitions: DataFrame, order: str) -> DataFrame:
    """The first of the transitions of a workflow that agree in both ends and kind."""
    return first_wins(transitions, ["workflow_id", "source_stage_id", "target_stage_id", "transition_type"], order)


#: Where a step and its state refer to questions and hypotheses.
STEP_REFS = (
    ("question", "questions_addressed", "questions_addressed"), ("hypothesis", "hypotheses_touched", "hypotheses_touched"), ("question", "unresolved_question_ids", "unresolved_question_ids"),
    ("question", "state_before.active_questions", "state_before.active_question_ids"), ("hypothesis", "state_before.active_hypotheses", "state_before.active_hypothesis_ids"),
    ("question", "state_after.active_questions", "state_after.active_question_ids"), ("hypothesis", "state_after.active_hypotheses", "state_after.active_hypothesis_ids"),
    ("question", "decision", "decision.target_question_ids"),
)


def case_references(cases: DataFrame, known: dict[str, Callable[[], Column]] | None = None) -> DataFrame:
    """(case_id, entity_id, kind, label, ref) of every reference in case studies to a question, a hypothesis or a step of the same
    episode. cases: case_id, hypotheses, episodes (with steps and transitions), final_outcome; parts that the schema lacks are
    left out. With known (lists of ids by kind, from columns of cases whose names start with _), only references that they lack."""
    kept = [c for c in cases.columns if c.startswith("_")]
    lacking = lambda k, ids: F.filter(ids, lambda r: F.col("case_id").isNull() | ~F.coalesce(F.array_contains(known[k](), r), F.lit(False))) if known else ids

    def has(kind: T.DataType, path: str) -> bool:
        for field in path.split("."):
            kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
            if not isinstance(kind, T.StructType) or field not in kind.names:
                return False
            kind = kind[field].dataType
        return True

    def told(rows: DataFrame, entity: Column, refs: list[tuple[str, str, Column]]) -> DataFrame:
        kind = "array<struct<kind: string, label: string, refs: array<string>>>"
        every = F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(label).alias("label"), lacking(k, ids.cast("array<string>")).alias("refs")) for k, label, ids in refs)) if refs else F.array().cast(kind)
        flat = rows.select("case_id", entity.cast("string").alias("entity_id"), F.explode(every).alias("r"))
        return flat.select("case_id", "entity_id", "r.kind", "r.label", F.explode("r.refs").alias("ref"))

    schema, of = cases.schema, lambda item, path: reduce(lambda c, f: c[f], path.split("."), item)
    hypotheses = cases.select("case_id", *kept, F.explode("hypotheses").alias("h"))
    out = told(hypotheses, F.col("h.hypothesis_id"), [("question", "related_questions", F.col("h.related_question_ids"))])
    episodes = cases.select("case_id", *kept, F.explode("episodes").alias("e"))
    found = [("question", "focus_questions", F.col("e.focus_question_ids"))] if has(schema["episodes"].dataType, "focus_question_ids") else []
    if has(schema["episodes"].dataType, "transitions"):
        found += [("step of episode", f"{end}_step", F.transform("e.transitions", of_end(end))) for end in ("source", "target")]
    out = out.unionByName(told(episodes, F.col("e.episode_id"), found))
    steps = episodes.select("case_id", *kept, F.explode("e.steps").alias("s"))
    kind = steps.schema["s"].dataType
    found = [(k, label, of(F.col("s"), path)) for k, label, path in STEP_REFS if has(kind, path)]
    found += [(k, f"insight.{k}", F.flatten(F.transform("s.produced_insights", of_list(f"related_{k}_ids")))) for k in ("question", "hypothesis") if has(kind, f"produced_insights.related_{k}_ids")]
    out = out.unionByName(told(steps, F.col("s.step_id"), found))
    if "final_outcome" in cases.columns:
        kind, last = schema["final_outcome"].dataType, []
        for k, label, path in (("question", "unresolved", "unresolved_question_ids"), ("question", "final_insight", "final_insights.related_question_ids"), ("hypothesis", "final_insight", "final_insights.related_hypothesis_ids"), ("question", "final_decision", "final_decisions.target_question_ids")):
            if has(kind, path):
                head, _, rest = path.partition(".")
                last.append((k, label, F.flatten(F.transform(f"final_outcome.{head}", of_list(rest))) if rest else F.col(f"final_outcome.{head}")))
        out = out.unionByName(told(cases, F.col("case_id"), last))
    return out


def of_end(end: str):
    return lambda t: t[f"{end}_step_id"]


def of_list(field: str):
    return lambda x: F.coalesce(x[field], F.array().cast("array<string>"))


def unknown_case_references(cases: DataFrame) -> DataFrame:
    """Violations of `case_references`: ids that the case (for steps: the episode) doesn't have. A case is one row, and what it knows is
    looked up there, so nothing is shuffled."""
    ids = lambda path: F.coalesce(F.col(path).cast("array<string>"), F.array().cast("array<string>"))
    places = F.transform("episodes", lambda e: F.struct(e["episode_id"].cast("string").alias("id"), F.transform(e["steps"], lambda s: s["step_id"].cast("string")).alias("steps")))
    held = cases.withColumns({"_questions": ids("questions.question_id"), "_hypotheses": ids("hypotheses.hypothesis_id"), "_episodes": places})
    of_episode = lambda: F.flatten(F.transform(F.filter("_episodes", lambda p: p["id"] == F.col("e.episode_id").cast("string")), lambda p: F.coalesce(p["steps"], F.array().cast("array<string>"))))
    missing = case_references(held, {"question": lambda: F.col("_questions"), "hypothesis": lambda: F.col("_hypotheses"), "step of episode": of_episode})
    return missing.select("entity_id", F.concat(F.lit("unknown "), F.col("kind")).alias("rule"), F.concat_ws(": ", "label", "ref").alias("message"))


def event_rules() -> dict[str, tuple[Column, Column]]:
    text = blank_to_null("text")
    return {
        "id_or_text": (F.col("ref").isNull() & text.isNull(), F.lit("an event needs an id or a text")),
        "introduced_text": (F.col("action").isin("Introduce", "Propose") & text.isNull(), F.lit("a new item needs a text")),
    }


def contiguous_from_one(rows: DataFrame, parent: str, index: str) -> DataFrame:
    """Parents whose indexes aren't 1..n, each once."""
    own = rows.groupBy(parent).agg(F.count(index).alias("n"), F.count_distinct(index).alias("d"), F.min(index).alias("low"), F.max(index).alias("high"))
    return own.where("low <> 1 or high <> n or d <> n").select(F.col(parent).cast("string").alias("entity_id"), F.lit("contiguous").alias("rule"), F.concat_ws("..", "low", "high").alias("message"))


def unique_case_ids(cases: DataFrame) -> DataFrame:
    """cases (spec_id, pos, case_id, case_title) with case_id: as given, else a slug of the title, else case-<n>; unique in the specification."""
    base = F.coalesce(blank_to_null("case_id"), slug("case_title", F.concat(F.lit("case-"), F.col("pos").cast("string"))))
    named = unique_ids(cases.select(F.col("spec_id").cast("string").alias("scope"), base.alias("base"), F.col("pos").cast("long").alias("pos"), "spec_id"))
    return cases.drop("case_id").join(named.select("spec_id", F.col("pos"), F.col("id").alias("case_id")), ["spec_id", "pos"])


def distinct_claims(claims: Column | str) -> Column:
    """Claims without repeats, whatever their case; null if there are none."""
    return distinct_ignoring_case(claims)


def childless(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.select(key).distinct().join(children.select(key).distinct(), key, "left_anti").select(F.col(key).cast("string").alias("entity_id"), F.lit("no_children").alias("rule"), F.lit("").alias("message"))


REGISTERED = "case_id string, pos long, kind string, item_id string, outcome string, text string, status string, inference_type string, related_question_ids array<string>"
#: The status of an item that an event introduces, and how it came to be.
INTRODUCED = {"question": "Open", "hypothesis": "Proposed"}
INFERRED = "StrongInference"


def registered_events(events: DataFrame) -> DataFrame:
    """What becomes of each event of a case, in order; events: (case_id, pos, kind, ref, text, related array<string>,
    known_questions array<string>, known_hypotheses array<string>), kind question or hypothesis.

    An event with a known id refers to it. One with a text makes a new item of its kind, under the case's id (a question is
    open, a hypothesis proposed), unless that id is known by then. Anything else is a violation, and so is a hypothesis that
    is related to an unknown question. Later events see items that earlier ones made, so a case is worked through in order;
    cases are independent and bounded by their length.
    """
    import re

    columns = [c.split()[0] for c in REGISTERED.split(", ")]

    def slugged(text: str | None, fallback: str) -> str:
        return re.sub(r"[^a-z0-9]+", "-", re.sub("['’]", "", (text or "").strip().lower())).strip("-") or fallback

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos", kind="stable")
        case, first = pdf["case_id"].iloc[0], pdf.iloc[0]
        listed = lambda x: [] if x is None or isinstance(x, float) else list(x)  # noqa: E731  a missing list is NaN here
        known = {k: set(listed(first[f"known_{plural}"])) for k, plural in (("question", "questions"), ("hypothesis", "hypotheses"))}
        rows = []
        for pos, kind, ref, text, related in zip(pdf["pos"], pdf["kind"], pdf["ref"], pdf["text"], pdf["related"], strict=True):
            ref, text = (None if x is None or x != x or x == "" else x for x in (ref, text))
            related = listed(related) if kind == "hypothesis" else []
            row = dict.fromkeys(columns) | {"case_id": case, "pos": pos, "kind": kind, "item_id": ref, "outcome": "violation"}
            if not set(related) <= known["question"]:
                pass
            elif ref in known[kind]:
                row["outcome"] = "known"
            elif text:
                name = ref or slugged(text, f"{case}.{kind}-{len(known[kind]) + 1}")
                name = name if name.startswith(f"{case}.") else f"{case}.{name}"
                row |= {"item_id": name, "outcome": "known" if name in known[kind] else "created"}
                if name not in known[kind]:
                    row |= {"text": text, "status": INTRODUCED[kind], "inference_type": INFERRED, "related_question_ids": related or None}
                known[kind].add(name)
            rows.append(row)
        return pd.DataFrame(rows, columns=columns, dtype=object)

    return events.groupBy("case_id").applyInPandas(run, REGISTERED)
