"""Around external tools and services: their inputs and outputs as tables, with a status for each document.

PDF, TEI, figure and image tools aren't part of this environment, so each is a function that the caller gives; what is done
with their results is relational.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.geometry import above_caption, area, clipped, expanded, height, intersects, width
from ..functions.jsonx import is_object, parsed
from ..functions.numbers import half_even
from ..functions.text import backfilled, blank_to_null, figure_number, merged_captions, number_in, padded, safe_name


def from_tool(files: DataFrame, make_tool: Callable[[], Callable[[bytes], str]], attempts: int = 1) -> DataFrame:
    """(path, text, error) of (path, content) rows: what a tool or service says of each file; a failure is a row, not the end."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = make_tool()

        def one(content: bytes) -> tuple[str | None, str | None]:
            error = None
            for _ in range(attempts):
                try:
                    return tool(content), None
                except Exception as e:
                    error = str(e)
            return None, error

        for batch in batches:
            told = [one(c) for c in batch["content"]]
            yield pd.DataFrame({"path": batch["path"], "text": [t for t, _ in told], "error": [e for _, e in told]})

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def validated_lines(lines: DataFrame, schema: str, required: list[str]) -> DataFrame:
    """Rows of JSON lines that must all be objects with the required fields; raises and names the first that isn't."""
    held = lines.where(F.trim("value") != "").withColumn("row", F.from_json("value", schema)).withColumn("ok", F.coalesce(is_object(parsed("value")), F.lit(False)))
    for field in required:
        held = held.withColumn("ok", F.col("ok") & F.col(f"row.{field}").isNotNull())
    if bad := held.where(~F.col("ok")).orderBy("file", "line_no").take(1):
        raise ValueError(f"{bad[0]['file']}: bad line {bad[0]['value'][:80]!r}")
    return held.select("row.*")


def picked_outputs(files: DataFrame) -> DataFrame:
    """(doc, path, error): of the files (doc, path) that a tool wrote for a document, the one with the document's stem or else
    the only one; several others are an error."""
    stem = F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1)
    n = F.count("*").over(W.Window.partitionBy("doc"))
    first = F.row_number().over(W.Window.partitionBy("doc").orderBy((stem != F.col("doc")), "path"))
    own = files.withColumn("same", stem == F.col("doc")).withColumn("n", n).withColumn("first", first).where("first = 1")
    return own.select("doc", F.when(F.col("same") | (F.col("n") == 1), F.col("path")).alias("path"), F.when(~F.col("same") & (F.col("n") > 1), "several outputs").alias("error"))


def chosen_figures(manifests: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc, fig_id, status) of the figure that each manifest names: none selected, not found, without a path, without a caption, or ok."""
    joined = manifests.select("doc", F.col("interface_figure").alias("fig_id")).join(figures.withColumn("_found", F.lit(True)), ["doc", "fig_id"], "left")
    status = (
        F.when(blank_to_null("fig_id").isNull(), "none_selected")
        .when(F.col("_found").isNull(), "not_found")
        .when(blank_to_null("image_path").isNull(), "no_image_path")
        .when(blank_to_null("caption").isNull(), "no_caption")
        .otherwise("ok")
    )
    return joined.select("doc", "fig_id", status.alias("status"))


def visual_primitives(raw: DataFrame, least_side: float = 6.0, least_area: float = 4.0) -> DataFrame:
    """Images, texts and drawings (kind, box) of pages without drawings that are specks: no side of 6 or an area below 4."""
    box = F.col("box")
    speck = (F.greatest(width(box), height(box)) < least_side) | (area(box) < least_area)
    return raw.where((F.col("kind") != "drawing") | ~speck)


def first_block_with(blocks: DataFrame, words: list[str]) -> DataFrame:
    """(page, box) of the first block (page, pos, text, box) with any of the words, whatever their case."""
    hit = F.greatest(*(F.contains(F.lower("text"), F.lit(w)) for w in words), F.lit(False))
    return blocks.where(hit).groupBy("page").agg(F.min_by("box", "pos").alias("box"))


def captions_at(blocks: DataFrame, anchors: DataFrame) -> DataFrame:
    """(page, caption) near the box of a figure's label; blocks: (page, text, box), anchors: (page, number, anchor).

    Blocks that touch the box grown by 40 and 28 points count, for figures other than the first only those with a label;
    without any, those that start from 8 above to 48 below it, within 42 points of the first one's end.
    """
    near = blocks.join(anchors, "page").withColumn("o", F.struct(half_even("box.y0", 1).alias("y"), F.col("box.x0").alias("x")))
    a = F.col("anchor")
    touching = intersects(expanded(a, 40.0, 28.0), F.col("box")) & ((F.col("number") == 1) | number_in("text").isNotNull())
    below = (F.col("box.y0") >= a["y0"] - 8) & (F.col("box.y0") <= a["y1"] + 48)
    marked = near.withColumn("t", touching).withColumn("b", below)
    facts = marked.groupBy("page").agg(F.max("t").alias("any"), F.min_by("box.y1", F.when(F.col("b"), F.col("o"))).alias("seed"))
    kept = marked.join(facts, "page").where(F.when(F.col("any"), F.col("t")).otherwise(F.col("b") & (F.col("box.y0") <= F.col("seed") + 42)))
    texts = kept.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("o", "text"))).alias("l"))
    return texts.select("page", merged_captions(F.transform("l", lambda x: x["text"])).alias("caption"))


def exported(figures: DataFrame, page: Column, padding: float = 8.0) -> DataFrame:
    """Raw figures (doc, index, name, caption, region, caption_box, candidate) as they leave the tool chain.

    region and caption_box are boxes or null. A figure without a region keeps a status that says so. Others get the box that is
    rendered (padded, cut off at the caption, inside the page), a file name and a caption that is backfilled.
    """
    n = figure_number("name", "caption")
    there = F.col("region").isNotNull()
    box = clipped(above_caption(expanded(F.col("region"), padding), F.col("caption_box"), padding), page)
    box = F.when(F.col("caption_box").isNull(), clipped(expanded(F.col("region"), padding), page)).otherwise(box)
    raw_name = F.coalesce(F.col("name"), F.concat(F.lit("figure_"), padded("index", 3)))
    file = F.concat(padded("index", 3), F.lit("_"), safe_name(raw_name), F.lit(".png"))
    own = figures.withColumn("number", n)
    return own.select(
        "doc", "index", "number", F.when(there, backfilled("caption", F.col("number"), F.col("candidate"))).otherwise(F.col("caption")).alias("caption"),
        F.when(there, box).alias("box"), F.when(there, file).alias("file"), F.when(there, "ok").otherwise("missing_region_boundary").alias("status"),
    )


def captions_payload(figures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, fig_id, caption) of every numbered figure with a region, in the order of the numbers; and (doc, fig_id, source) of the
    image that each id has in the end: the last one of a number replaces the others."""
    ok = figures.where("status = 'ok' and number is not null").withColumn("fig_id", F.concat(F.lit("fig_"), F.col("number").cast("string")))
    images = ok.groupBy("doc", "fig_id").agg(F.max_by("file", "index").alias("source"))
    return ok.select("doc", "number", "index", "fig_id", "caption").orderBy("doc", "number", "index").drop("number", "index"), images


def index_rows(names: DataFrame, titles: DataFrame) -> DataFrame:
    """(paper, full_name) of all documents; titles counts only rows where both fields are texts."""
    known = titles.where("paper is not null and full_name is not null")
    return names.select(F.col("doc").alias("paper")).join(known, "paper", "left").orderBy("paper")


def messages(instruction: str, payload: Column, images: Column | None = None) -> Column:
    """Messages of a model call: the instruction, the payload as JSON, and a label and an image for each image (structs label, data_url)."""
    text = F.struct(F.lit("text").alias("type"), F.concat(F.lit(instruction + "\n\nPayload:\n"), F.to_json(payload, {"ignoreNullFields": "false"})).alias("content"))
    if images is None:
        return F.array(text)
    pairs = F.transform(images, lambda i: F.array(F.struct(F.lit("text").alias("type"), i["label"].alias("content")), F.struct(F.lit("image").alias("type"), F.coalesce(i["data_url"], F.raise_error(F.lit("an image is missing"))).alias("content"))))
    return F.concat(F.array(text), F.flatten(pairs))


def resolved(given: Mapping[str, str | None], environment: Mapping[str, str]) -> dict[str, str]:
    """Settings given all together, or else all from the environment (keys in capitals); a part of either is an error."""
    if any(given.values()):
        if missing := [k for k, v in given.items() if not v]:
            raise ValueError(f"given in part; missing: {', '.join(missing)}")
        return {k: str(v) for k, v in given.items()}
    if missing := [k.upper() for k in given if not environment.get(k.upper())]:
        raise ValueError(f"not set: {', '.join(missing)}")
    return {k: environment[k.upper()] for k in given}


def run_name(model: str, at: Column | None = None) -> Column:
    """The time in UTC and the model's name, safe for a folder."""
    return F.concat(F.date_format(F.current_timestamp() if at is None else at, "yyyyMMdd'T'HHmmss'Z'"), F.lit("_"), safe_name(F.lit(model)))


def retrieval_payload(hits: Column) -> Column:
    """Retrieved items (structs paper_name, source_type, source_id, reason, score) with a default for each missing field."""
    return F.transform(
        F.coalesce(hits, F.array()),
        lambda h: F.struct(
            F.coalesce(h["paper_name"], F.lit("")).alias("paper_name"),
            F.coalesce(h["source_type"], F.lit("unknown")).alias("source_type"),
            F.coalesce(h["source_id"], F.lit("")).alias("source_id"),
            F.coalesce(h["reason"], F.lit("")).alias("reason"),
            F.coalesce(h["score"].cast("double"), F.lit(0.0)).alias("score"),
        ),
    )
