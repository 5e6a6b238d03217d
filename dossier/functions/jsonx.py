"""JSON in text: tolerant parsing, fragments, types, serialization."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, col, let, strip


def parsed(c: Column | str) -> Column:
    """A variant; null if the text isn't JSON."""
    return F.try_parse_json(col(c))


def is_object(variant: Column | str) -> Column:
    return F.coalesce(F.schema_of_variant(col(variant)).startswith("OBJECT"), F.lit(False))


def is_list(variant: Column | str) -> Column:
    return F.coalesce(F.schema_of_variant(col(variant)).startswith("ARRAY"), F.lit(False))


def string_field(variant: Column | str, name: str) -> Column:
    """A field if it is a string; null if it is missing or of another type."""
    return let(F.try_variant_get(col(variant), f"$.{name}", "variant"), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")))


def first_object(c: Column | str) -> Column:
    """The first balanced {...} of a text, braces in strings and escapes aside; null if none closes.

    Balance is not a regular property, so this is an Arrow function.
    """

    @F.pandas_udf("string")
    def found(s: pd.Series) -> pd.Series:
        return s.map(balanced, na_action="ignore")

    return found(col(c))


def balanced(text: str) -> str | None:
    import re

    start = text.find("{")
    if start < 0:
        return None
    depth = 0
    for m in re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)|[{}]', re.DOTALL).finditer(text, start):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if not depth:
                return text[start : m.end()]
    return None


def ladder(c: Column | str) -> Column:
    """An object from the whole text, else from its first fragment."""
    whole, part = parsed(c), parsed(first_object(c))
    return F.when(is_object(whole), whole).when(is_object(part), part)


def payload(variant: Column | str) -> Column:
    """A prediction: an object as it is, a string that holds one, else null."""
    held = lambda v: parsed(F.when(F.schema_of_variant(v) == "STRING", strip(F.try_variant_get(v, "$", "string"))))
    return let(col(variant), lambda v: F.when(is_object(v), v).otherwise(let(held(v), lambda inner: F.when(is_object(inner), inner))))


def as_json(c: Column | str) -> Column:
    """Nulls are kept, and characters as they are."""
    return F.to_json(col(c), {"ignoreNullFields": "false"})


def text_parts(parts: Column | str) -> Column:
    """The non-empty texts of multipart content, one on each line."""
    return F.array_join(F.filter(F.transform(col(parts), lambda p: blank_to_null(p["text"])), lambda t: t.isNotNull()), "\n")
