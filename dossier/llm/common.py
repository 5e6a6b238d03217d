"""What the text operators share: tolerant column selection, checkpoint folders and word splitting."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that end a word: space, tab, LF, VT, FF, CR. bytes.split() without arguments splits at exactly these.
WHITESPACE = b" \t\n\r\x0b\x0c"


#: Bytes of text that a task turns into Python objects at once, however large its Arrow batches are.
SLICE_BYTES = 8 << 20


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", size: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most `size` or else SLICE_BYTES of text each, or of one row. Slices share the batch's memory."""
    size = size or SLICE_BYTES
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + size, side="right")))
            yield batch.slice(at, end - at)
            at = end
    released()


def released() -> None:
    """Give memory that is free back to the system: a worker lives on after its task, beside those of the next stage."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def kept_rows(df: DataFrame, text_col: str, judge: Callable[[Iterator[pa.RecordBatch], str], Iterator[tuple[pa.RecordBatch, pa.Array]]]) -> DataFrame:
    """The rows of df, with all their columns, that judge keeps: from slices and the name of their text column it makes each
    slice with a mask. No join is needed, and nothing leaves its task."""
    name = next(n for n in ("text", *(f"text{k}" for k in range(len(df.columns)))) if n not in df.columns or n == text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, mask in judge(sliced(batches, name), name):
            yield part.filter(mask)

    if dict(df.dtypes)[text_col] == "string" and name == text_col:
        return df.mapInArrow(run, df.schema)
    held = df.withColumn(name, F.col(f"`{text_col}`").cast("string"))
    return held.mapInArrow(run, held.schema).select(*(f"`{c}`" for c in df.columns))


def text_rows(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id LONG, text STRING) of a table, whatever other columns it has."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def nearest_ids(df: DataFrame, most: int) -> DataFrame:
    """The `most` different rows of df (doc_id and perhaps more) with the smallest hashes of the id; rows without an id go.

    Only rows below a hash rate that leaves twice as many ids are made different and sorted, so the ids of the whole table aren't
    shuffled. The rate follows from an estimate of their number, whose error is far below that factor.
    """
    known = df.where("doc_id is not null")
    n = known.agg(F.approx_count_distinct("doc_id")).first()[0]
    rate = min(1.0, (2 * most + 1000) / max(n, 1))
    near = known if rate == 1 else known.where(F.xxhash64("doc_id") < int(rate * (1 << 64)) - (1 << 63))
    return near.distinct().orderBy(F.xxhash64("doc_id"), *df.columns).limit(most)


def checkpoint_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share. Where none is set, a session in one process uses one below its
    warehouse; on a cluster that may be a local disk, so it is an error."""
    base = checkpoint_dir(spark)
    if not base and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the jobs inside go as soon as each has ended, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if old is None else spark.conf.set(key, old)


def remove_path(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
