"""Reports: condensed figures, missing parts, names of documents, summaries as Markdown, and the sinks."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import removed, shared_path
from ..functions.text import blank_to_null


def condensed_figures(documents: DataFrame, manifest: DataFrame, raw: DataFrame) -> DataFrame:
    """(doc, figures, source): figures of the manifest if a document has one, else the raw list, else none."""
    listed = lambda df: df.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("fig_id", "caption"))).alias("figures"))
    m, r = listed(manifest).withColumnRenamed("figures", "m"), listed(raw).withColumnRenamed("figures", "r")
    both = documents.select("doc").join(m, "doc", "left").join(r, "doc", "left")
    source = F.when(F.col("m").isNotNull(), "manifest").when(F.col("r").isNotNull(), "raw").otherwise("none")
    empty = F.array().cast("array<struct<fig_id: string, caption: string>>")
    return both.select("doc", F.coalesce("m", "r", empty).alias("figures"), source.alias("source"))


def missing_parts(present: dict[str, Column]) -> Column:
    """Names of the parts that aren't there, in the given order."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), name) for name, c in present.items())))


def document_names(paths: list[DataFrame], patterns: list[str]) -> DataFrame:
    """Names found in the paths (column path) of several roots by a pattern each, once, sorted."""
    found = [df.select(blank_to_null(F.regexp_extract("path", p, 1)).alias("doc")) for df, p in zip(paths, patterns, strict=True)]
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.where("doc is not null").distinct().orderBy("doc")


def found_name(names: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc) with the file stem of the same name, or else of the same name but for case (the first in order)."""
    close = wanted.join(names, F.lower("doc") == F.lower("stem"), "left")
    return close.groupBy("doc").agg(F.min_by("stem", F.struct(F.col("stem") != F.col("doc"), F.col("stem"))).alias("stem"))


#: The sections of a document's summary, and what each says of itself.
SECTIONS = {
    "Paper": "Which document this is.",
    "Passages": "Where the passages taken from it are.",
    "Figures": "Where its figures are, and a condensed list of them.",
    "View Images": "Where the parts cut from its interface figure are.",
}


def markdown(rows: DataFrame) -> DataFrame:
    """(doc, text) of documents with title, passages_path, figures_path, figures and views_path: one section for each, its contents
    as indented JSON; what is missing is null there."""
    held = {
        "Paper": F.struct(F.col("doc").alias("paper_name"), F.col("title").alias("paper_full_name")),
        "Passages": F.struct(F.col("passages_path").alias("path")),
        "Figures": F.struct(F.col("figures_path").alias("directory"), F.col("figures").alias("items")),
        "View Images": F.struct(F.col("views_path").alias("directory")),
    }
    head = F.concat(F.lit("# Preprocess Summary: "), F.col("doc"), F.lit("\n\nWhat was taken from one document, and where it is.\n"))
    body = [F.concat(F.lit(f"\n## {name}\n\n{told}\n\n```json\n"), F.to_json(held[name], {"ignoreNullFields": "false", "pretty": "true"}), F.lit("\n```\n")) for name, told in SECTIONS.items()]
    return rows.select("doc", F.concat(head, *body).alias("text"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object on each line, nulls included; mode append for logs."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """With a header; an empty table writes no rows and no header. Lists and structs become JSON."""
    flat = df.select(*(F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes))
    flat.write.mode("overwrite").option("header", not flat.isEmpty()).csv(path)


def write_document(spark: SparkSession, value: object, path: str) -> None:
    """A small object as one indented JSON document, with characters as they are."""
    spark.createDataFrame([(json.dumps(value, ensure_ascii=False, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_once(df: DataFrame, path: str, overwrite: bool = False) -> str:
    """CREATED, OVERWRITTEN or SKIPPED; with overwrite always OVERWRITTEN, even if nothing was there.

    Rows are written beside the path and moved there when complete, so a write that fails leaves nothing, and what was there stays
    until its successor is complete. Of several writers one moves its rows there and says CREATED; the others are SKIPPED.
    """
    spark = df.sparkSession
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    target, beside = path_of(path), path_of(f"{path.rstrip('/')}.{uuid.uuid4().hex}.writing")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(target) and not overwrite:
        return "SKIPPED"
    try:
        df.write.json(beside.toString())
        if overwrite:
            old = path_of(f"{beside.toString()}.old")
            there = files.exists(target) and files.rename(target, old)
            if not moved(files, beside, target):
                if there:
                    files.rename(old, target)
                raise OSError(f"another writer is at {path}")
            files.delete(old, True)
            return "OVERWRITTEN"
        return "CREATED" if moved(files, beside, target) else "SKIPPED"
    finally:
        files.delete(beside, True)


def moved(files, source, target) -> bool:
    """Whether a folder could be moved to a path that nothing had. A move onto a folder that another writer has made meanwhile puts
    it inside, or fails; either is undone."""
    if files.exists(target):
        return False
    try:
        done = files.rename(source, target)
    except Exception:  # noqa: BLE001  a file system may raise where others say no
        done = False
    stray = target.suffix(f"/{source.getName()}")
    if done and files.exists(stray):
        files.delete(stray, True)
        return False
    return bool(done)


def write_evaluation(scores: DataFrame, runs: DataFrame, config: dict, folder: str, groups: tuple[str, ...] = ("paper_name", "prefix_length", "segmentation_mode")) -> None:
    """All artifacts of an evaluation: score rows, review queue and judge runs as JSON lines, the summary twice (as itself and
    as config), and a CSV for each grouping. Scores are computed once, everything else reads the rows that were written, and all
    summaries come from one pass over them."""
    from .summaries import all_summaries, summary

    spark, schema = scores.sparkSession, scores.schema
    write_jsonl(scores, f"{folder}/sample_scores.jsonl")
    scores = spark.read.schema(schema).json(f"{folder}/sample_scores.jsonl")
    made, held = all_summaries(scores, groups), shared_path(spark, "summaries")
    made.write.parquet(held)
    every = spark.read.schema(made.schema).parquet(held)
    own = every.where("group_by is null").drop("group_by", "group_value").first() or summary(scores).first()
    whole = {**config, "aggregate": own.asDict(recursive=True)}
    for name in ("config", "summary"):
        write_document(spark, whole, f"{folder}/{name}.json")
    write_jsonl(scores.where("needs_review"), f"{folder}/review_queue.jsonl")
    write_jsonl(runs, f"{folder}/goal_judge_runs.jsonl")
    for g in groups:
        write_csv(every.where(F.col("group_by") == g).drop("group_by").withColumnRenamed("group_value", g).orderBy(g), f"{folder}/summary_by_{g}.csv")
    removed(spark, held)
