"""Validation of nested JSON by a description of its schema, compiled into one expression.

A description is made of Text, Whole, Number, Flag, Items and Fields. The expression gives every violation of a value, with its path
($.a.b[2].c) and the rule that it breaks, not just the first; a table of values is read once and needs no shuffle. Rules:

    missing     a required value is absent or null          type       a value of another type (whole numbers count as numbers)
    pattern     a text doesn't match                        value      a text isn't one of those allowed
    range       a number outside its bounds                 too_few    a list with fewer entries than it needs
    repeated    a list with equal entries                   one_of     not exactly one of some fields is given
    not_json    a line isn't JSON at all

Fields that a description doesn't name are ignored. What stands below a value of a wrong type isn't looked at.

A value is read once, as the type that its description has, with variants only where the leaves are: taking nested variants apart
level by level copies all that is below at each level.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import computed
from ..functions.jsonx import parsed
from ..functions.text import let
from .ids import IDENTIFIER

PROBLEMS = "array<struct<path: string, rule: string>>"


@dataclass(frozen=True)
class Text:
    pattern: str | None = None
    one_of: tuple[str, ...] = ()
    required: bool = True


@dataclass(frozen=True)
class Whole:
    least: int | None = None
    most: int | None = None
    required: bool = True


@dataclass(frozen=True)
class Number:
    least: float | None = None
    most: float | None = None
    required: bool = True


@dataclass(frozen=True)
class Flag:
    required: bool = True


@dataclass(frozen=True)
class Items:
    of: Rule
    least: int = 0
    different: bool = False
    required: bool = True


@dataclass(frozen=True)
class Fields:
    of: dict[str, Rule] = field(hash=False)
    exactly_one: tuple[str, ...] = ()
    required: bool = True


Rule = Text | Whole | Number | Flag | Items | Fields
Identifier = Text(IDENTIFIER)
Maybe = Text(required=False)


def told(path: Column, rule: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(rule).alias("rule")))


def first(*cases: tuple[Column, Column]) -> Column:
    """What the first case that holds tells; nothing if none does."""
    return reduce(lambda rest, case: F.when(case[0], case[1]).otherwise(rest), reversed(cases), F.array().cast(PROBLEMS))


def empty(v: Column) -> Column:
    return v.isNull() | F.is_variant_null(v)


def absent(rule: Rule, path: Column) -> Column:
    return told(path, "missing") if rule.required else F.array().cast(PROBLEMS)


def problems(value: Column, rule: Rule) -> Column:
    """All violations of a variant as (path, rule), in the order of the description."""
    if kind_of(rule) == "variant":
        return let(value, lambda v: of_variant(v, rule, F.lit("$")))
    return let(value, lambda v: let(F.try_variant_get(v, "$", kind_of(rule)), lambda x: of_typed(x, rule, F.lit("$"), v)))


def kind_of(rule: Rule) -> str:
    """The type that a variant is read as: structs and lists of structs down to variants. Those are single values and lists of them,
    lists whose entries are compared, structs of which some fields exclude each other, and structs whose fields' names don't make
    a type or a path."""
    if isinstance(rule, Items) and not rule.different and kind_of(rule.of) != "variant":
        return f"array<{kind_of(rule.of)}>"
    if isinstance(rule, Fields) and rule.of and not rule.exactly_one:
        names = {n.lower() for n in rule.of if re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", n)}
        if len(names) == len(rule.of):
            return f"struct<{', '.join(f'`{n}`: {kind_of(r)}' for n, r in rule.of.items())}>"
    return "variant"


def of_typed(x: Column, rule: Rule, path: Column, whole: Column) -> Column:
    """Problems of what was read as kind_of(rule) at a path of the whole variant. Where a list or a struct wasn't read, that path tells
    whether there is nothing or something else."""
    if kind_of(rule) == "variant":
        return of_variant(x, rule, path)
    lost = let(F.try_variant_get(whole, path, "variant"), lambda v: F.when(empty(v), absent(rule, path)).otherwise(told(path, "type")))
    if isinstance(rule, Items):
        few = [first((F.size(x) < rule.least, told(path, "too_few")))] if rule.least else []
        below = [*few, F.flatten(F.transform(x, lambda v, i: of_typed(v, rule.of, entry(path, i), whole)))]
    else:
        below = [of_typed(x[name], inner, F.concat(path, F.lit(f".{name}")), whole) for name, inner in rule.of.items()]
    return F.when(x.isNull(), lost).otherwise(F.concat(*below))


def of_variant(v: Column, rule: Rule, path: Column) -> Column:
    return F.when(empty(v), absent(rule, path)).otherwise(present(v, rule, path))


def entry(path: Column, i: Column) -> Column:
    return F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))


def present(v: Column, rule: Rule, path: Column) -> Column:
    of_type = lambda kind, told_: let(F.try_variant_get(v, "$", kind), lambda x: F.when(x.isNull(), told(path, "type")).otherwise(told_(x)))
    if isinstance(rule, Fields):
        return of_type("map<string,variant>", lambda x: fields(x, rule, path))
    if isinstance(rule, Items):
        return of_type("array<variant>", lambda x: items(x, rule, path))
    kind = F.schema_of_variant(v)
    if isinstance(rule, Text):
        text = F.try_variant_get(v, "$", "string")
        cases = [(~text.rlike(rule.pattern), told(path, "pattern"))] if rule.pattern else []
        cases += [(~text.isin(*rule.one_of), told(path, "value"))] if rule.one_of else []
        return first((kind != "STRING", told(path, "type")), *cases)
    if isinstance(rule, Flag):
        return first((kind != "BOOLEAN", told(path, "type")))
    number = F.try_variant_get(v, "$", "double")
    numeric = (kind == "BIGINT") | ((kind.rlike("^DECIMAL|^DOUBLE|^FLOAT")) & (F.lit(isinstance(rule, Number)) | (number == F.floor(number))))
    cases = [(number < rule.least, told(path, "range"))] if rule.least is not None else []
    cases += [(number > rule.most, told(path, "range"))] if rule.most is not None else []
    return first((~numeric, told(path, "type")), *cases)


def fields(x: Column, rule: Fields, path: Column) -> Column:
    one = lambda name, inner: let(F.try_element_at(x, F.lit(name)), lambda v: of_variant(v, inner, F.concat(path, F.lit(f".{name}"))))
    below = [one(name, inner) for name, inner in rule.of.items()]
    if rule.exactly_one:
        given = lambda n: let(F.try_element_at(x, F.lit(n)), lambda v: (v.isNotNull() & ~F.is_variant_null(v)).cast("int"))
        below.append(first((reduce(Column.__add__, map(given, rule.exactly_one)) != 1, told(path, "one_of"))))
    return F.concat(*below) if below else F.array().cast(PROBLEMS)


def items(x: Column, rule: Items, path: Column) -> Column:
    parts = [first((F.size(x) < rule.least, told(path, "too_few")))] if rule.least else []
    if rule.different:
        as_text = F.transform(x, lambda v: F.to_json(v))
        parts.append(first((F.size(F.array_distinct(as_text)) < F.size(x), told(path, "repeated"))))
    return F.concat(*parts, F.flatten(F.transform(x, lambda v, i: of_variant(v, rule.of, entry(path, i)))))


def checked(rows: DataFrame, rule: Rule, text: str = "value") -> DataFrame:
    """rows with `problems` of the JSON in a text column, found once whatever is made of them; blank texts are no rows of a log and go."""
    held = rows.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    own = let(parsed(text), lambda v: F.when(v.isNull(), told(F.lit("$"), "not_json")).otherwise(problems(v, rule)))
    return computed(held, {"problems": own})


def valid_rows(rows: DataFrame, rule: Rule, schema: str, text: str = "value") -> DataFrame:
    """The rows of lines that all keep the rules; the first problem of a line that doesn't is an error when it is read, whatever
    columns are."""
    held = checked(rows, rule, text)
    message = F.concat(F.lit("bad line: "), F.get("problems", F.lit(0))["path"], F.lit(" "), F.get("problems", F.lit(0))["rule"], F.lit(" in "), F.substring(text, 1, 80))
    return held.where(F.when(F.size("problems") == 0, True).otherwise(F.raise_error(message).cast("boolean"))).select(F.from_json(text, schema).alias("row")).select("row.*")


# ---------------------------------------------------------------- the record format

Names = Items(Identifier, required=False)
REF = Fields({"workflow_id": Identifier, "stage_id": Identifier})
CAPABILITY = Fields({"capability_id": Identifier, "capability_name": Text(), "capability_kind": Maybe, "description": Maybe})
SUBVIEW = Fields({"subview_id": Identifier, "subview_name": Text(), "description": Maybe, "capabilities": Items(CAPABILITY, required=False)})
VIEW = Fields({"view_id": Identifier, "view_name": Text(), "description": Maybe, "subviews": Items(SUBVIEW, required=False)})
COORDINATION = Fields({"coordination_id": Identifier, "coordination_type": Maybe, "description": Maybe, "source_id": Text(IDENTIFIER, required=False), "target_ids": Names})
SYSTEM = Fields({"system_name": Maybe, "dataset_types": Items(Text(), required=False), "system_categories": Items(Text(), required=False), "views": Items(VIEW, required=False), "coordinations": Items(COORDINATION, required=False)})
STAGE = Fields({"workflow_id": Identifier, "stage_id": Identifier, "stage_index": Whole(), "stage_title": Text(), "stage_goal": Maybe, "used_views": Names, "used_capabilities": Names, "used_coordinations": Names})
TRANSITION = Fields({"source_stage_id": Identifier, "target_stage_id": Identifier, "transition_type": Text()})
WORKFLOW = Fields({"workflow_id": Identifier, "workflow_title": Text(), "stages": Items(STAGE, required=False), "transitions": Items(TRANSITION, required=False)})
STEP = Fields({"step_id": Identifier, "step_index": Whole(), "used_views": Names, "used_capabilities": Names, "outcome_summary": Maybe})
EPISODE = Fields({"benchmark_episode_index": Whole(), "episode_title": Text(), "local_goal": Text(), "used_views": Names, "used_capabilities": Names, "source_step_ids": Names, "steps": Items(STEP, required=False), "image_path": Maybe})
CASE = Fields({
    "scenario": Fields({}), "questions": Items(Fields({"question_id": Identifier, "question_text": Text()}), required=False),
    "hypotheses": Items(Fields({"hypothesis_id": Identifier, "hypothesis_text": Text(), "related_question_ids": Names}), required=False), "prefix_episodes": Items(EPISODE, required=False),
})
IMAGE = Fields({"benchmark_episode_index": Whole(), "episode_title": Text(), "image_path": Text()})


def record_rule(schema_version: str, task_name: str) -> Fields:
    """What a benchmark record must look like."""
    meta = {"sample_id": Text(), "benchmark_case_id": Text(), "paper_name": Text(), "case_index": Whole(), "prefix_length": Whole(), "prefix_episode_indices": Items(Whole()), "target_episode_index": Whole()}
    given = {
        "schema_version": Text(one_of=(schema_version,), required=False), "task_name": Text(one_of=(task_name,), required=False), "sample_id": Text(), "system_context": SYSTEM,
        "workflow_context": Fields({"workflows": Items(WORKFLOW, required=False)}), "case_context": CASE,
        "visual_context": Fields({"input_mode": Text(one_of=("ordered_episode_images",), required=False), "prefix_episode_images": Items(IMAGE, required=False)}),
    }
    gold = {"target_episode_index": Whole(), "target_episode_title": Text(), "gold_next_goal": Text(), "gold_next_views": Names, "gold_next_capabilities": Names}
    return Fields({"metadata": Fields(meta), "model_input": Fields(given), "gold": Fields(gold)})


#: What a prediction must look like.
PREDICTION = Fields({
    "predicted_next_goal": Text(), "predicted_views": Names, "predicted_capabilities": Names, "predicted_workflow_stage": Fields(REF.of, required=False), "rationale": Maybe,
    "confidence": Number(0.0, 1.0, required=False), "retrieved_evidence": Items(Fields({"paper_name": Text(), "source_type": Text(), "source_id": Maybe, "reason": Text()}), required=False),
})
