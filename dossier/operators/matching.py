"""Best one-to-one matching of predicted and gold sets with partial credit, in closed form.

Weights fall with the distance in a hierarchy (equal 1, same subview 0.5, same view 0.25), so matching from the bottom
up is optimal: equal ids first, then what is left within each subview, then within each view. That is three nested
aggregations. Rows are dealt once by sample, to more partitions the more input there is; all further grouping keeps that
partitioning, so there is one shuffle, and what a task's hash tables hold doesn't grow with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.frames import dealt
from ..functions.numbers import f1, precision_of, recall_of


def sided(items: DataFrame, *keys: str) -> DataFrame:
    """One row for each id of a sample with p and g (1 or 0): predicted, gold. Rows of a sample are in one partition."""
    flag = lambda side: F.max(F.when(F.col("side") == side, 1).otherwise(0)).cast("long")
    return dealt(items, "sample_id").groupBy("sample_id", *keys).agg(flag("pred").alias("p"), flag("gold").alias("g"))


def strict_matches(items: DataFrame, id_col: str) -> DataFrame:
    """(sample_id, n_pred, n_gold, matched) where only equal ids match."""
    own = sided(items, id_col)
    return own.groupBy("sample_id").agg(F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"), F.sum(F.col("p") * F.col("g")).cast("double").alias("matched"))


def capability_matches(items: DataFrame, dimension: DataFrame) -> DataFrame:
    """(sample_id, n_pred, n_gold, exact, matched) of capability ids; an id that the dimension lacks matches only itself.

    The dimension is joined before rows are dealt by sample; how, the planner decides by its size.
    """
    alone = F.concat(F.lit("?"), F.col("capability_id"))
    placed = items.join(dimension, "capability_id", "left").withColumn("view_id", F.coalesce("view_id", alone)).withColumn("subview_id", F.coalesce("subview_id", alone))
    own, both = sided(placed, "view_id", "subview_id", "capability_id"), F.col("p") * F.col("g")
    totals = [F.sum(c).alias(c) for c in ("n_pred", "n_gold", "exact", "half")]
    subs = own.groupBy("sample_id", "view_id", "subview_id").agg(
        F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"), F.sum(both).alias("exact"), F.sum(F.col("p") - both).alias("p"), F.sum(F.col("g") - both).alias("g")
    )
    subs = subs.withColumn("half", F.least("p", "g"))
    views = subs.groupBy("sample_id", "view_id").agg(*totals, F.least(F.sum(F.col("p") - F.col("half")), F.sum(F.col("g") - F.col("half"))).alias("quarter"))
    out = views.groupBy("sample_id").agg(*totals, F.sum("quarter").alias("quarter"))
    matched = F.col("exact") + 0.5 * F.col("half") + 0.25 * F.col("quarter")
    return out.select("sample_id", "n_pred", "n_gold", F.col("exact").cast("double").alias("exact"), matched.cast("double").alias("matched"))


def view_matches(items: DataFrame, dimension: DataFrame) -> DataFrame:
    """The same for ids of views and subviews: half credit between a view and one of its own subviews, none between subviews."""
    placed = items.join(dimension, "id", "left").withColumn("view_id", F.coalesce("view_id", F.concat(F.lit("?"), F.col("id"))))
    own = sided(placed, "view_id", "id")
    is_view, both = F.col("id") == F.col("view_id"), F.col("p") * F.col("g")
    count = lambda side, of: F.sum(F.when(of, F.col(side) - both).otherwise(0))
    views = own.groupBy("sample_id", "view_id").agg(
        F.sum("p").alias("n_pred"), F.sum("g").alias("n_gold"), F.sum(both).alias("exact"),
        (F.least(count("p", is_view), count("g", ~is_view)) + F.least(count("g", is_view), count("p", ~is_view))).alias("half"),
    )
    out = views.groupBy("sample_id").agg(*(F.sum(c).alias(c) for c in ("n_pred", "n_gold", "exact", "half")))
    return out.select("sample_id", "n_pred", "n_gold", F.col("exact").cast("double").alias("exact"), (F.col("exact") + 0.5 * F.col("half")).cast("double").alias("matched"))


def support_counts(predicted: DataFrame, supported: DataFrame, id_col: str) -> DataFrame:
    """(sample_id, n_pred, n_supported): how many predicted ids of a sample are among the supported ones; one shuffle for both."""
    rows = predicted.select("sample_id", id_col, F.lit("pred").alias("side")).unionByName(supported.select("sample_id", id_col, F.lit("gold").alias("side")))
    own = sided(rows, id_col)
    return own.groupBy("sample_id").agg(F.sum("p").alias("n_pred"), F.sum(F.col("p") * F.col("g")).alias("n_supported"))


def scored(samples: DataFrame, matches: DataFrame, matched: str = "matched", prefix: str = "", suffix: str = "") -> DataFrame:
    """Samples with precision, recall and F1; a sample without any item scores 1."""
    joined = samples.join(matches, "sample_id", "left").fillna(0, ["n_pred", "n_gold", matched])
    p, r = precision_of(matched, "n_pred", "n_gold"), recall_of(matched, "n_pred", "n_gold")
    named = lambda n: f"{prefix}{n}{suffix}"
    out = joined.withColumn(named("precision"), p).withColumn(named("recall"), r)
    return out.withColumn(named("f1"), f1(named("precision"), named("recall")))


def best_matching(weights: list[list[float]]) -> float:
    """The greatest total weight of a one-to-one matching, for weights that follow no hierarchy; rows are the smaller side."""
    best = {0: 0.0}
    for row in weights:
        grown = dict(best)
        for used, total in best.items():
            for k, w in enumerate(row):
                bit = 1 << k
                if w > 0 and not used & bit and grown.get(used | bit, -1.0) < total + w:
                    grown[used | bit] = total + w
        best = grown
    return max(best.values())


def weighted_matches(pairs: DataFrame) -> DataFrame:
    """(sample_id, matched) from (sample_id, pred_id, gold_id, weight) rows, for any weights.

    A sample's rows are bounded by its two lists; the work doubles with each gold id, so hierarchical weights should use
    the closed forms.
    """

    def solve(pdf):
        import pandas as pd

        grid = pdf.pivot_table(index="pred_id", columns="gold_id", values="weight", aggfunc="max", fill_value=0.0).to_numpy()
        if grid.shape[1] > grid.shape[0]:
            grid = grid.T
        return pd.DataFrame({"sample_id": [pdf["sample_id"].iloc[0]], "matched": [best_matching(grid.tolist())]})

    return pairs.groupBy("sample_id").applyInPandas(solve, pairs.select("sample_id").schema.add("matched", "double"))
