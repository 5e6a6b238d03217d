"""Connected components of a link table by alternating stars; nothing but counts comes to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remove_path, scratch_path


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that has a link: root is the smallest node reachable.

    Each round connects all larger neighbours of a node, and then all smaller ones, with the smallest; the number of
    rounds grows with the logarithm of the longest path. A round's links are written to the shared folder, so lineage
    stays short and a lost executor costs one round at most. Minima are combined before they are shuffled, and joins
    on a node with many links can be split by the adaptive planner.
    """
    spark = links.sparkSession
    paths: list[str] = []

    def kept(df: DataFrame) -> tuple[DataFrame, tuple]:
        paths.append(scratch_path(spark, "links"))
        df.write.parquet(paths[-1])
        for old in paths[:-2]:
            remove_path(spark, old)
        del paths[:-2]
        out = spark.read.schema("u long, v long").parquet(paths[-1])
        return out, tuple(out.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    current, mark = kept(links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u <> v").distinct())
    while mark[0]:
        both = current.union(current.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # every link now points from a larger node to a smaller one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.union(least).distinct()
        current, new = kept(small)
        if new == mark:
            break
        mark = new
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(current.select(F.col("v"), F.col("v")).distinct())
