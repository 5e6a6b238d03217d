"""Figures of documents: review of captions and numbering, best captions, ranks of roles, clusters and teasers on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.geometry import area, expanded, intersects
from ..functions.numbers import half_even
from ..functions.text import caption_flags, caption_quality, caption_start, from_caption_start, id_number, let, number_in, squeeze

#: Roles of a figure, in the order that decides ties.
ROLES = ("interface", "view", "intended_workflow", "case_study", "evaluation", "other")


def figure_rows(document: DataFrame, kind: str = "figure", tables: bool = False) -> DataFrame:
    """Figures of raw metadata, a list of them or lists of figures and tables; rows of another type only on demand."""
    wanted = F.lower("figType") == kind
    return document.where(wanted | (F.lower("figType") == "table") if tables else wanted)


def review(documents: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc, num_figures, needs_review, issues) of every document; figures: (doc, fig_id, caption).

    Hard: no numbers, not from 1 on, gaps, repeats, an empty caption, a caption without its label or with another number.
    Soft: a very short or a very long caption. Text of the body is an issue that asks for a look at least.
    """
    text = squeeze("caption")
    flags = caption_flags("caption", F.col("n"))
    f = figures.withColumn("n", id_number("fig_id")).withColumn("f", flags).withColumn("empty", text == "")
    has = lambda flag: F.array_contains("f", flag)
    told = lambda of: F.count_if(of)
    facts = f.groupBy("doc").agg(
        F.count("*").alias("items"), F.count("n").alias("numbers"), F.count_distinct("n").alias("different"), F.min("n").alias("low"), F.max("n").alias("high"),
        told(F.col("empty")).alias("empties"), told(has("caption_prefix_unexpected")).alias("prefixes"), told(has("caption_number_mismatch")).alias("mismatches"),
        told(has("caption_contains_body_text")).alias("bodies"), F.max(has("caption_too_short").cast("int")).alias("short"), F.max(has("caption_too_long").cast("int")).alias("long"),
    )
    own = documents.select("doc").join(facts, "doc", "left")
    c = F.col
    none, late = (c("numbers") == 0), (c("numbers") == 0) | (c("low") != 1)
    gaps, repeats = c("high") - c("low") + 1 - c("different"), c("numbers") - c("different")
    issues = F.filter(
        F.array(
            F.when(none, "no figures"),
            F.when(late, "does not start at figure 1"),
            F.when(gaps > 0, F.concat(gaps.cast("string"), F.lit(" missing"))),
            F.when(repeats > 0, F.concat(repeats.cast("string"), F.lit(" repeated"))),
            F.when(c("empties") > 0, F.concat(c("empties").cast("string"), F.lit(" empty captions"))),
            F.when(c("prefixes") > 0, F.concat(c("prefixes").cast("string"), F.lit(" captions without label"))),
            F.when(c("mismatches") > 0, F.concat(c("mismatches").cast("string"), F.lit(" captions of another number"))),
            F.when(c("bodies") > 0, F.concat(c("bodies").cast("string"), F.lit(" captions with body text"))),
        ),
        lambda x: x.isNotNull(),
    )
    hard = none | late | (gaps > 0) | (repeats > 0) | (c("empties") > 0) | (c("prefixes") > 0) | (c("mismatches") > 0)
    soft = c("short") + c("long")
    verdict = F.when(c("items").isNull() | F.coalesce(hard, F.lit(True)) | (soft >= 2), "yes").when((soft == 1) | (c("bodies") > 0), "maybe").otherwise("no")
    return own.select("doc", F.coalesce(c("items").cast("string"), F.lit("0")).alias("num_figures"), verdict.alias("needs_review"), F.coalesce(F.when(c("items").isNull(), "figure extraction failed"), F.array_join(issues, "; ")).alias("issues"))


def best_captions(passages: DataFrame) -> DataFrame:
    """(doc, number, caption): the best text for each figure number; passages: (doc, order, type, text).

    The fewest defects win. Among equals the last passage of type caption, or the first one if none is a caption.
    """
    text = passages.withColumn("text", squeeze("text")).withColumn("number", number_in("text")).where("number is not null")
    cut = text.withColumn("caption", from_caption_start("text", F.col("number"))).where(caption_start("caption", F.col("number")) == 0)
    scored = cut.withColumn("q", caption_quality(caption_flags("caption", F.col("number"))))
    is_caption = F.coalesce(F.col("type") == "caption", F.lit(False))
    order = W.Window.partitionBy("doc", "number").orderBy("q.hard", "q.total", F.desc(is_caption), F.when(is_caption, -F.col("order")).otherwise(F.col("order")))
    return scored.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("doc", "number", "caption")


def primary_role(scores: dict[str, Column]) -> Column:
    """The role with the greatest score; the first declared of equals."""
    top = F.greatest(*scores.values())
    out = F.lit(None).cast("string")
    for role in reversed(list(scores)):
        out = F.when(scores[role] == top, role).otherwise(out)
    return out


def ranked(figures: DataFrame) -> DataFrame:
    """Figures (doc, pos, interface, primary_role) with interface_rank 1, 2, ... in their document, ties in input order."""
    return figures.withColumn("interface_rank", F.row_number().over(W.Window.partitionBy("doc").orderBy(F.desc("interface"), "pos")))


def manifests(figures: DataFrame) -> DataFrame:
    """(doc, interface_figure, needs_manual_review): the best figure whose role is interface; a look is needed if there is
    none, if the best score is below 0.5 or if it leads by less than 0.12 (documents with several figures)."""
    main = F.when(F.col("primary_role") == "interface", F.struct("interface", -F.col("pos")))
    best = figures.groupBy("doc").agg(F.max_by("fig_id", main).alias("interface_figure"))
    # the two best scores: a limit in each group, which is applied before the shuffle as well
    place = F.row_number().over(W.Window.partitionBy("doc").orderBy(F.desc("interface"), "pos"))
    two = figures.select("doc", "interface", "pos").withColumn("place", place).where("place <= 2").groupBy("doc").agg(F.max("interface").alias("top"), F.min("interface").alias("second"), F.count("*").alias("n"))
    own = best.join(two, "doc")
    close = (F.col("n") > 1) & ((F.col("top") < 0.5) | (F.col("top") - F.col("second") < 0.12))
    return own.select("doc", "interface_figure", (F.col("interface_figure").isNull() | F.coalesce(close, F.lit(False))).alias("needs_manual_review"))


def one_interface(figures: DataFrame, chosen: DataFrame) -> DataFrame:
    """Documents whose marked figures contradict their manifest: exactly one is marked if an interface is named, else none."""
    marks = figures.groupBy("doc").agg(F.count_if(F.col("is_interface_figure")).alias("marked"))
    both = chosen.join(marks, "doc", "left")
    expected = F.when(F.col("interface_figure").isNotNull(), 1).otherwise(0)
    return both.where(F.coalesce("marked", F.lit(0)) != expected).select("doc", "marked")


def clusters(primitives: DataFrame, tolerance: float = 14.0, least_area: float = 600.0) -> DataFrame:
    """(page, cluster, x0, y0, x1, y1, kinds, n) of primitives (page, kind, x0, y0, x1, y1).

    One pass from top to bottom: a primitive joins all clusters near it and they become one. The pass isn't repeated, so
    clusters that come near each other later stay apart; connected components would differ. It is a fold over the page's sorted
    list, whose state is the list of clusters. A page's primitives are bounded, and pages are independent.
    """
    cluster = "struct<x0: double, y0: double, x1: double, y1: double, kinds: array<string>, n: bigint>"

    def near(c: Column, p: Column) -> Column:
        across = F.least(c["x1"] + tolerance, p["x1"]) > F.greatest(c["x0"] - tolerance, p["x0"])
        return across & (F.least(c["y1"] + tolerance, p["y1"]) > F.greatest(c["y0"] - tolerance, p["y0"]))

    def joined(a: Column, b: Column) -> Column:
        corners = [f(a[k], b[k]).alias(k) for k, f in (("x0", F.least), ("y0", F.least), ("x1", F.greatest), ("y1", F.greatest))]
        return F.struct(*corners, F.array_union(a["kinds"], b["kinds"]).alias("kinds"), (a["n"] + b["n"]).alias("n"))

    def step(made: Column, p: Column) -> Column:
        own = F.struct(*(p[k].alias(k) for k in ("x0", "y0", "x1", "y1")), F.array(p["kind"]).alias("kinds"), F.lit(1).cast("long").alias("n"))
        first = F.array_position(F.transform(made, lambda c: near(c, p)), True).cast("int")

        def placed(at: Column) -> Column:
            grown = F.aggregate(F.filter(made, lambda c: near(c, p)), own, joined)
            rest = F.filter(F.slice(made, at + 1, F.size(made)), lambda c: ~near(c, p))
            return F.when(at == 0, F.array_append(made, own)).otherwise(F.concat(F.slice(made, 1, F.greatest(at - 1, F.lit(0))), F.array(grown), rest))

        return let(first, placed)

    doubles = [F.col(k).cast("double").alias(k) for k in ("y0", "x0", "x1", "y1")]
    pages = primitives.groupBy("page").agg(F.sort_array(F.collect_list(F.struct(*doubles, "kind"))).alias("own"))
    made = F.aggregate("own", F.array().cast(f"array<{cluster}>"), step)
    kept = F.filter(made, lambda c: (c["x1"] - c["x0"]) * (c["y1"] - c["y0"]) >= least_area)
    rows = pages.select("page", F.posexplode(kept).alias("cluster", "c"))
    return rows.select("page", F.col("cluster").cast("long").alias("cluster"), "c.x0", "c.y0", "c.x1", "c.y1", F.array_join(F.sort_array("c.kinds"), ",").alias("kinds"), "c.n")


def content_score(kinds: Column, image: float, drawing: float, mixed_text: float) -> Column:
    has = lambda k: F.contains(F.concat(F.lit(","), kinds, F.lit(",")), F.lit(f",{k},"))
    points = lambda of, n: F.when(of, F.lit(n)).otherwise(0.0)
    return points(has("image"), image) + points(has("drawing"), drawing) + points(has("text") & F.contains(kinds, F.lit(",")), mixed_text)


def teaser_score(box: Column, kinds: Column, caption: Column, page_height: Column) -> Column:
    """How likely a cluster belongs to the caption below it; null if it can't: not above, too small or too far."""
    gap = F.greatest(F.lit(0.0), caption["y0"] - box["y1"])
    # fixed values: all thresholds and weights of the two scores
    able = (box["y1"] <= caption["y0"]) & (area(box) >= 2500) & (gap <= 0.28 * page_height)
    return F.when(able, content_score(kinds, 25.0, 20.0, 8.0) + F.least(F.lit(30.0), area(box) / 4000) - gap / 3)


def front_page_score(box: Column, kinds: Column, title_bottom: Column, abstract: Column, page_height: Column) -> Column:
    """How likely a cluster on the first page is its teaser, without a caption; null if it is too small or too low."""
    # fixed values, as above
    able = (area(box) >= 4000) & (box["y0"] <= 0.68 * page_height)
    band = F.when(box["y0"] >= title_bottom, 20.0).otherwise(-15.0)
    above = 25.0 - F.greatest(F.lit(0.0), abstract["y0"] - box["y1"]) / 3
    beside = F.when(intersects(expanded(abstract, 12.0), box), 12.0).otherwise(-F.least(F.lit(40.0), F.abs(box["y0"] - abstract["y0"]) / 5))
    near = F.when(abstract.isNull(), -F.abs(box["y0"] - 0.4 * page_height) / 6).when(box["y1"] <= abstract["y0"] + 24, above).otherwise(beside)
    return F.when(able, content_score(kinds, 20.0, 18.0, 6.0) + F.least(F.lit(40.0), area(box) / 5000) + band + near)


def best_of(rows: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """The row with the greatest score of each key; the first of equals; none without a score. A score is computed once for each row:
    a filter on what a generator gives doesn't repeat its expression."""
    n = F.row_number().over(W.Window.partitionBy(key).orderBy(F.desc(score), order))
    once = rows.select(*(c for c in rows.columns if c != score), F.inline(F.array(F.struct(score)))).select(*rows.columns)
    return once.where(F.col(score).isNotNull()).withColumn("_n", n).where("_n = 1").drop("_n")


def with_fallbacks(figures: DataFrame, teasers: DataFrame) -> DataFrame:
    """Figures (doc, index, number, caption, source) of all documents, with a teaser as figure 1 in front where there is none."""
    have = figures.where("number = 1").select("doc").distinct()
    added = teasers.join(have, "doc", "left_anti").select("doc", F.lit(0).cast("long").alias("index"), F.lit(1).cast("long").alias("number"), F.coalesce(F.nullif("caption", F.lit("")), F.lit("Figure 1")).alias("caption"), F.lit("teaser_fallback").alias("source"))
    return figures.select("doc", F.col("index").cast("long").alias("index"), F.col("number").cast("long").alias("number"), "caption", "source").unionByName(added)


def label_box(hits: DataFrame) -> DataFrame:
    """The box around all places of a figure label on a page; hits: (page, number, text, x0, y0, x1, y1)."""
    n = F.col("number").cast("string")
    spelled = F.col("text").isin("") | F.col("text").contains(F.concat(F.lit("Fig. "), n)) | F.col("text").contains(F.concat(F.lit("Fig "), n)) | F.lower("text").contains(F.concat(F.lit("figure "), n)) | F.col("text").contains(F.concat(F.lit("FIG. "), n))
    return hits.where(spelled).groupBy("page", "number").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def captions_below(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, caption) of what stands below a region; blocks: (page, text, x0, y0, x1, y1), regions: (page, number, rx0, ry0, rx1, ry1, height, width).

    Blocks of at most 600 characters in the strip below count; from the one with the figure's label on, or from the first,
    those that start within a band of 48 or 42 points below it.
    """
    pad = F.greatest(F.lit(24.0), 0.08 * (F.col("rx1") - F.col("rx0")))
    inside = (F.col("y0") >= F.col("ry1") - 6) & (F.col("y1") <= F.least("height", F.col("ry1") + 0.18 * F.col("height"))) & (F.col("x1") >= F.greatest(F.lit(0.0), F.col("rx0") - pad)) & (F.col("x0") <= F.least("width", F.col("rx1") + pad))
    near = blocks.join(regions, "page").where(inside & (F.length("text") <= 600)).withColumn("o", F.struct(half_even("y0", 1), "x0"))
    seed = near.groupBy("page").agg(F.min_by(F.struct("o", "y1"), F.when(number_in("text") == F.col("number"), F.col("o"))).alias("s"), F.min_by(F.struct("o", "y1"), "o").alias("f"))
    start = seed.select("page", F.coalesce("s.o", "f.o").alias("from"), F.when(F.col("s").isNotNull(), F.col("s.y1") + 48).otherwise(F.col("f.y1") + 42).alias("end"))
    from ..functions.text import merged_captions

    kept = near.join(start, "page").where((F.col("o") >= F.col("from")) & (F.col("y0") <= F.col("end")))
    texts = kept.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "text"))), lambda x: x["text"]).alias("texts"))
    return texts.select("page", merged_captions("texts").alias("caption"))
