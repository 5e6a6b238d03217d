"""Result logs: append-only JSON lines whose later rows replace earlier ones of the same sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.frames import computed, matched_rows
from ..functions.jsonx import is_object, parsed, payload, string_field
from ..functions.text import let
from .summaries import last_wins


def classified(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines with the variant they hold (objects only) and whether they count as errors; blank lines are neither. A line is parsed
    once."""
    held = computed(lines.where(F.trim(F.coalesce(F.col(text), F.lit(""))) != ""), {"row": let(parsed(text), lambda v: F.when(is_object(v), v))})
    return held.withColumn("line_error", F.col("row").isNull())


def last_results(lines: DataFrame, key: str = "sample_id", order: str = "line_no") -> DataFrame:
    """The last good row of each sample; ids that aren't strings are no ids."""
    held = classified(lines).where("not line_error").withColumn("_key", string_field("row", key)).where("_key is not null")
    return last_wins(held, "_key", order).withColumnRenamed("_key", key)


def log_counters(lines: DataFrame, key: str = "sample_id") -> DataFrame:
    """One row: lines that aren't objects, objects, those without an id, and those that replace an earlier row."""
    held = classified(lines).withColumn("_key", F.when(~F.col("line_error"), string_field("row", key)))
    good = ~F.col("line_error")
    out = held.agg(F.count_if(F.col("line_error")).alias("errors"), F.count_if(good).alias("rows"), F.count("_key").alias("named"), F.count_distinct("_key").alias("different"))
    return out.select(
        F.col("errors").alias("result_line_parse_error_count"),
        (F.col("rows") - F.col("named")).alias("result_rows_without_sample_id_count"),
        (F.col("named") - F.col("different")).alias("duplicate_result_row_count"),
        F.col("rows").alias("result_row_count"),
    )


def observed_results(lines: DataFrame, key: str = "sample_id", order: str = "line_no") -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """last_results, and its log_counters without another pass: they are observed by the job that reads the rows, on the lines as they
    are read and on the rows that remain. The second value gives them as soon as a job has read all rows; before that it waits.
    A task that is run again is counted once."""
    read, kept = Observation(), Observation()
    held = classified(lines).withColumn("_key", F.when(~F.col("line_error"), string_field("row", key)))
    held = held.observe(read, F.count_if(F.col("line_error")).alias("errors"), F.count_if(~F.col("line_error")).alias("rows"), F.count("_key").alias("named"))
    rows = last_wins(held.where("_key is not null"), "_key", order).observe(kept, F.count(F.lit(1)).alias("different")).withColumnRenamed("_key", key)

    def counters() -> dict[str, int]:
        lines_, different = read.get, kept.get["different"]
        return {
            "result_line_parse_error_count": lines_["errors"],
            "result_rows_without_sample_id_count": lines_["rows"] - lines_["named"],
            "duplicate_result_row_count": lines_["named"] - different,
            "result_row_count": lines_["rows"],
        }

    return rows, counters


def evaluation_status(found: Column, status: Column, prediction: Column, valid: Column) -> Column:
    """What became of a sample, in the order of what is checked first."""
    return (
        F.when(~found, "missing_result")
        .when(F.coalesce(status, F.lit("")) != "ok", F.concat(F.lit("result_status_"), F.coalesce(F.nullif(status, F.lit("")), F.lit("missing"))))
        .when(payload(prediction).isNull(), "prediction_missing_or_non_json")
        .when(~valid, "schema_invalid")
        .otherwise("ok")
    )


def pending(samples: DataFrame, log: DataFrame, overwrite: bool = False, key: str = "sample_id") -> DataFrame:
    """Samples to run: those not in the log, whatever their status there; all with overwrite."""
    return samples if overwrite else samples.join(log.select(key).distinct(), key, "left_anti")


def checked_join(records: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """records with their manifest rows; one without is an error when it is read."""
    return matched_rows(records, manifest, key, "no manifest row for ")
