"""Ordered distinct lists, set tests and list repairs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col, let, strip


def or_empty(c: Column | str, kind: str = "array<string>") -> Column:
    return F.coalesce(col(c), F.array().cast(kind))


def distinct_stripped(c: Column | str) -> Column:
    """Stripped, without empty ones, first occurrence kept; null is an empty list."""
    return F.array_distinct(F.filter(F.transform(or_empty(c), strip), lambda x: x.isNotNull() & (x != "")))


def distinct_ignoring_case(c: Column | str) -> Column:
    """As distinct_stripped, but spellings that differ in case are one, the first stays, and an empty list is null. By sorting, each
    list once, so that a long list costs little more than a short one for each entry."""
    own = F.filter(F.transform(or_empty(c), strip), lambda x: x.isNotNull() & (x != ""))
    placed = F.sort_array(F.transform(own, lambda x, i: F.struct(F.lower(x).alias("k"), i.alias("i"), x.alias("x"))))
    first = let(placed, lambda s: F.filter(s, lambda e, i: (i == 0) | (e["k"] != F.get(s, i - 1)["k"])))
    kept = F.transform(F.sort_array(F.transform(first, lambda e: F.struct(e["i"], e["x"]))), lambda e: e["x"])
    return let(kept, lambda k: F.when(F.size(k) > 0, k))


def strings_of(variant: Column | str) -> Column:
    """The strings of a JSON list, distinct_stripped; anything but a list gives an empty one."""
    v = col(variant)
    listed = F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    kept = F.filter(or_empty(listed, "array<variant>"), lambda x: F.schema_of_variant(x) == "STRING")
    return distinct_stripped(F.transform(kept, lambda x: F.try_variant_get(x, "$", "string")))


def listed(variant: Column | str) -> Column:
    """A JSON list as it is, and a single string as a list of one."""
    v = col(variant)
    return F.when(F.schema_of_variant(v) == "STRING", F.array(v)).otherwise(F.try_variant_get(v, "$", "array<variant>"))


def same_set(a: Column | str, b: Column | str) -> Column:
    return (F.size(F.array_except(col(a), col(b))) == 0) & (F.size(F.array_except(col(b), col(a))) == 0)


def with_missing(own: Column | str, needed: Column | str, in_order: bool = True) -> Column:
    """A list and what it lacks of another one: behind its own entries, or all sorted (nulls first)."""
    both = F.array_union(col(own), col(needed))
    return both if in_order else F.sort_array(both)


def contiguous(c: Column | str) -> Column:
    """Whether a list is 1, 2, ..., n."""
    own = F.transform(col(c), lambda x: x.cast("int"))
    return F.when(F.size(own) > 0, own == F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)))).otherwise(F.lit(True))
