"""Rates and scores that are null, not an error, where they have no meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; null if b is 0."""
    return col(a).cast("double") / F.nullif(col(b).cast("double"), F.lit(0.0))


def share(a: Column | str, b: Column | str) -> Column:
    """a / b; 0 if b is 0."""
    return F.coalesce(ratio(a, b), F.lit(0.0))


def half_even(c: Column | str, places: int = 0) -> Column:
    """Rounded to decimal places, halves to even. What is a half is told in doubles, after the multiplication, not by the decimals
    that a double is printed with."""
    return F.rint(col(c).cast("double") * float(10**places)) / float(10**places)


def f1(p: Column | str, r: Column | str) -> Column:
    """Harmonic mean; 0 if both are 0, null if one is null."""
    p, r = col(p), col(r)
    return F.when(p.isNotNull() & r.isNotNull(), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)))


def precision_of(matched: Column | str, predicted: Column | str, gold: Column | str) -> Column:
    """matched / predicted; 1 if there is nothing to predict and nothing predicted, 0 if only one side is empty."""
    p, g = col(predicted), col(gold)
    return F.when((p == 0) & (g == 0), 1.0).when((p == 0) | (g == 0), 0.0).otherwise(ratio(matched, p))


def recall_of(matched: Column | str, predicted: Column | str, gold: Column | str) -> Column:
    return precision_of(matched, gold, predicted)


def unit(c: Column | str) -> Column:
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(0.0)), F.lit(1.0)))


def structure_score(view_f1: Column | str, capability_f1: Column | str) -> Column:
    return 0.5 * col(view_f1) + 0.5 * col(capability_f1)


def next_move_score(view_f1: Column | str, capability_f1: Column | str, goal: Column | str) -> Column:
    """Weighted sum; null without a goal score."""
    return 0.4 * col(view_f1) + 0.4 * col(capability_f1) + 0.2 * col(goal)
