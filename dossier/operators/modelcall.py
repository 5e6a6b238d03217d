"""Model calls as a partition-wise operation with an injectable client, retries, a cache and an append-only log."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jsonx import ladder, string_field

#: A client answers (prompt, json_mode) with text, or raises.
Client = Callable[[str, bool], str]
RESULT = "sample_id string, status string, attempt_count int, response string, error string"


def answered(client: Client, prompt: str, attempts: int) -> tuple[str, int, str | None, str | None]:
    """(status, attempts, response, error): JSON mode first and plain on any failure; both count as one attempt."""
    error = ""
    for n in range(1, attempts + 1):
        try:
            try:
                return "ok", n, client(prompt, True), None
            except Exception:
                return "ok", n, client(prompt, False), None
        except Exception as e:
            error = str(e)
    return "error", attempts, None, error


def run_model(prompts: DataFrame, make_client: Callable[[], Client], attempts: int = 5) -> DataFrame:
    """(sample_id, prompt) rows with what the model said; a client is made once for each task, failures become rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for batch in batches:
            got = [answered(client, p, attempts) for p in batch["prompt"]]
            yield pd.DataFrame({"sample_id": batch["sample_id"], **dict(zip(("status", "attempt_count", "response", "error"), map(list, zip(*got, strict=True)) if got else [[]] * 4, strict=True))})

    return prompts.select(F.col("sample_id").cast("string"), "prompt").mapInPandas(run, RESULT)


def run_samples(prompts: DataFrame, log: str, make_client: Callable[[], Client], attempts: int = 5, overwrite: bool = False, dry_run: bool = False, wanted: list[str] | None = None, most: int | None = None) -> dict[str, int]:
    """Run the samples (sample_id, prompt) that a log of JSON lines doesn't have yet, whatever their status there, append what comes
    of them, and count: processed, skipped, failed. `wanted` and `most` choose samples first (in the order of their ids; less
    than none is none). An answer's prediction is the object in it; a dry run asks nobody.
    """
    from ..sources.readers import exists, json_lines
    from .report import write_jsonl
    from .resultlog import classified, pending

    spark, run = prompts.sparkSession, uuid.uuid4().hex
    chosen = prompts if wanted is None else prompts.where(F.col("sample_id").isin(list(wanted)))
    chosen = chosen if most is None else chosen.orderBy("sample_id").limit(max(0, most))
    todo = chosen
    if exists(spark, log) and not overwrite:
        done = classified(json_lines(spark, log)).where("not line_error").select(string_field("row", "sample_id").alias("sample_id"))
        todo = pending(chosen, done.where("sample_id is not null"))
    if dry_run:
        told = todo.select(F.col("sample_id").cast("string").alias("sample_id"), F.lit("dry_run").alias("status"), F.lit(0).alias("attempt_count"), F.lit(None).cast("string").alias("response"), F.lit(None).cast("string").alias("error"))
    else:
        told = run_model(todo, make_client, attempts)
    total = chosen.count()
    write_jsonl(told.withColumn("prediction", F.to_json(ladder("response"))).withColumn("run_id", F.lit(run)), log, mode="append")
    written = spark.read.schema("sample_id string, status string, run_id string").json(log).where(F.col("run_id") == run)
    n, failed = written.agg(F.count("*"), F.count_if(F.col("status") == "error")).first()
    return {"processed": n - failed, "skipped": total - n, "failed": failed}


def cache_misses(wanted: DataFrame, cache: DataFrame) -> DataFrame:
    """(sample_id, repeat_index, judge_model, prompt_version) rows that the cache has no judgment for."""
    keys = ["sample_id", "repeat_index", "judge_model", "prompt_version"]
    return wanted.join(cache.where("judgment is not null").select(*keys), keys, "left_anti")


def data_urls(files: DataFrame) -> DataFrame:
    """(path, content) rows, as spark.read.format('binaryFile') gives them, with data URLs; unknown kinds count as PNG."""
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.when(kind.isin("jpg", "jpeg"), "image/jpeg").when(kind.isin("gif", "webp", "bmp"), F.concat(F.lit("image/"), kind)).otherwise("image/png")
    return files.withColumn("data_url", F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64("content")))
