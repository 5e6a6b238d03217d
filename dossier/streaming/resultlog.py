"""Result logs as streams: JSON lines that keep arriving, each sample once, appended to a log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.jsonx import is_object, parsed, string_field


def result_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, status, arrived, value) of the good lines in files that appear in a folder."""
    lines = spark.readStream.text(folder).withColumn("row", parsed("value"))
    good = lines.where(is_object("row")).withColumn("sample_id", string_field("row", "sample_id")).where("sample_id is not null")
    return good.select("sample_id", string_field("row", "status").alias("status"), F.current_timestamp().alias("arrived"), "value")


def append_new(results: DataFrame, log: str, checkpoint: str, delay: str = "1 hour") -> StreamingQuery:
    """Append the first result of each sample to the log; state is dropped behind the watermark."""
    once = results.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["sample_id"])
    return once.select("sample_id", "status", "value").writeStream.format("json").outputMode("append").option("path", log).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counters(results: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Running counts by status in a memory table, for monitoring."""
    return results.groupBy("status").count().writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
