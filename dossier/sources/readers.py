"""Readers: tolerant and strict JSON lines, JSON documents, CSV with packed lists, optional files, discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.jsonx import is_list, parsed
from ..functions.text import pipe_list


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value) of text lines; classify them with operators.resultlog. line_no orders lines by file, part of the
    file and place in that part, however parts are packed into tasks."""
    part = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"))
    lines = spark.read.text(path).select("value", part.alias("line_no"))
    return lines.select("line_no.file", "line_no", "value")


def strict_json_lines(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of a schema; the first bad line fails the job that reads it."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """A document, or the rows of a list; a byte order mark is no hindrance."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def json_list(spark: SparkSession, path: str) -> DataFrame:
    """(file, items VARIANT list, error) of documents that must be lists."""
    held = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), parsed(F.regexp_replace("value", r"^\x{FEFF}", "")).alias("v"))
    ok = is_list("v")
    return held.select("file", F.when(ok, F.try_variant_get("v", "$", "array<variant>")).alias("items"), F.when(~ok, "not a list").alias("error"))


def packed_csv(spark: SparkSession, path: str, lists: list[str], numbers: list[str]) -> DataFrame:
    """A CSV with a header; some columns are lists packed with pipes, some whole numbers."""
    df = spark.read.option("header", True).csv(path)
    return df.select(*(pipe_list(c).alias(c) if c in lists else F.col(c).cast("int").alias(c) if c in numbers else F.col(c) for c in df.columns))


def optional_csv(spark: SparkSession, path: str, schema: str, numbers: list[str]) -> DataFrame:
    """No rows if the file is missing; missing numbers are 0."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).schema(schema).csv(path).fillna(0, numbers)


def figure_metadata(spark: SparkSession, path: str, tables: bool = False) -> DataFrame:
    """(file, pos, figure VARIANT) of metadata that is a list of figures or has lists of figures and tables."""
    held = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), parsed("value").alias("v"))
    part = lambda p: F.coalesce(F.try_variant_get("v", p, "array<variant>"), F.array().cast("array<variant>"))
    items = F.when(is_list("v"), part("$")).otherwise(F.concat(part("$.figures"), part("$.tables")))
    rows = held.select("file", F.posexplode(items).alias("pos", "figure"))
    kind = F.lower(F.try_variant_get("figure", "$.figType", "string"))
    return rows.where(kind.isin("figure", "table") if tables else kind == "figure")


def file_names(spark: SparkSession, path: str) -> DataFrame:
    """(path) of all files of a glob, without reading them; none if there is none."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string")
    return spark.read.format("binaryFile").load(path).select("path")
