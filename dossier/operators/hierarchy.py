"""Three-level hierarchies (view, subview, capability) as dimension tables, and checks against them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W


def capability_dimension(tree: DataFrame) -> DataFrame:
    """(record_id, view_id, subview_id, capability_id) of nested views; the last of repeated ids wins."""
    views = tree.select("record_id", F.posexplode("views").alias("vp", "v"))
    subs = views.select("record_id", "vp", F.col("v.view_id").alias("view_id"), F.posexplode_outer("v.subviews").alias("sp", "s"))
    caps = subs.select("record_id", "vp", "sp", "view_id", F.col("s.subview_id").alias("subview_id"), F.posexplode_outer("s.capabilities").alias("cp", "c"))
    named = caps.select("record_id", "vp", "sp", "cp", "view_id", "subview_id", F.col("c.capability_id").alias("capability_id"))
    last = F.row_number().over(W.Window.partitionBy("record_id", "capability_id").orderBy(F.desc("vp"), F.desc("sp"), F.desc("cp")))
    return named.withColumn("n", F.when(F.col("capability_id").isNotNull(), last).otherwise(1)).where("n = 1").select("record_id", "view_id", "subview_id", "capability_id")


def view_dimension(capabilities: DataFrame) -> DataFrame:
    """(id, view_id): each view with itself and each subview with its view."""
    views = capabilities.select(F.col("view_id").alias("id"), "view_id")
    return views.union(capabilities.where("subview_id is not null").select(F.col("subview_id").alias("id"), "view_id")).distinct()


def supported_views(used: DataFrame, dimension: DataFrame) -> DataFrame:
    """(sample_id, id), perhaps repeated, of every view or subview that a workflow's uses support: used itself, its view is
    used, or (for a view) one of its subviews is used. One join: the dimension lists what each id supports."""
    children = dimension.groupBy(F.col("view_id").alias("id")).agg(F.collect_set("id").alias("down"))
    up = dimension.where("id <> view_id").select("id", F.array("id", "view_id").alias("up"))
    closure = up.join(children, "id", "full").select("id", F.array_union(F.coalesce("up", F.array()), F.coalesce("down", F.array())).alias("supports"))
    reached = used.select("sample_id", "id").join(closure, "id", "left")
    return reached.select("sample_id", F.explode(F.array_union(F.array("id"), F.coalesce("supports", F.array()))).alias("id"))
