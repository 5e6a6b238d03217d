"""Helpers on whole tables."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share. Where none is set, a session in one process uses one below
    its warehouse; on a cluster that may be a local disk, so it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def dealt(rows: DataFrame, key: str, share: int = 4 << 20) -> DataFrame:
    """rows dealt by a key to one partition for each share of their input files' bytes, so that a task's part of them stays the same
    however large the input is; the session's number of partitions is the least, and is all there is for rows that aren't from files."""
    spark, size = rows.sparkSession, 0
    for file in rows.inputFiles():
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        size += path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getLen()
    many = -(-size // share)
    return rows.repartition(many, key) if many > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows.repartition(key)


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once for each row, however often and wherever they are used later: a generator keeps
    their expressions from being repeated in filters and other columns."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def matched_rows(df: DataFrame, other: DataFrame, keys: str | list[str], message: str) -> DataFrame:
    """df with the rows of the other table; a row without one is an error. The check is a filter on the join, so it holds whatever
    columns are read, rows that are only counted included; there is one join and no job before it."""
    keys = [keys] if isinstance(keys, str) else keys
    joined = df.join(other.withColumn("_there", F.lit(True)), keys, "left")
    told = F.concat(F.lit(message), F.to_json(F.struct(*keys)) if len(keys) > 1 else F.coalesce(F.col(keys[0]).cast("string"), F.lit("null")))
    return joined.where(F.when(F.col("_there"), F.lit(True)).otherwise(F.raise_error(told).cast("boolean"))).drop("_there")
