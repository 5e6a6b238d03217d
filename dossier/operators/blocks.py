"""Typed text blocks of documents: extraction, de-duplication, numbering, abstracts, similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.text import compare_form, nfkc, squeeze
from .similar import alike

SKIPPED = r"(?is)<(script|style|nav|footer|header|head)[ >].*?</(script|style|nav|footer|header|head)>|<!--.*?-->"
#: Tags that end a block, opening or closing; all others are inside one.
LIMITS = (
    "address", "article", "aside", "blockquote", "body", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption", "figure", "form", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html",
    "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
)
BLOCK = rf"(?is)<(?:h[1-6]|p|li)(?:\s[^>]*)?>.*?(?=</?(?:{'|'.join(LIMITS)})[\s>/]|\z)"


def html_blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """(id, pos, type, text): headings are titles, p and li paragraphs, up to the next tag of a block, with the text of all tags
    inside them; a line break is a space. Scripts, navigation and the like are skipped."""
    body = F.regexp_replace(F.coalesce(F.col(html_col), F.lit("")), SKIPPED, " ")
    found = pages.select(id_col, F.posexplode(F.regexp_extract_all(body, F.lit(BLOCK), F.lit(0))).alias("pos", "m"))
    kind = F.when(F.lower(F.substring("m", 2, 1)) == "h", "title").otherwise("paragraph")
    text = F.regexp_replace(F.regexp_replace("m", r"(?i)<br\b[^>]*>", " "), "<[^>]*>", "")
    return found.select(id_col, F.col("pos").cast("long").alias("pos"), kind.alias("type"), squeeze(text).alias("text")).where("text <> ''")


def deduplicated(blocks: DataFrame, id_col: str, canonical: Column | None = None) -> DataFrame:
    """The first of the blocks of a document that have the same type and the same comparison form."""
    form = compare_form(nfkc("text")) if canonical is None else canonical
    n = F.row_number().over(W.Window.partitionBy(id_col, "type", "_form").orderBy("pos"))
    return blocks.withColumn("_form", form).withColumn("_n", n).where("_n = 1").drop("_form", "_n")


def numbered(blocks: DataFrame, id_col: str) -> DataFrame:
    """order_index 0, 1, ... in each document."""
    return blocks.withColumn("order_index", F.row_number().over(W.Window.partitionBy(id_col).orderBy("pos")).cast("long") - 1)


def similarity(a: Column, b: Column) -> Column:
    """Matching-block ratio of two comparison forms; null where lengths differ by more than a quarter or one is empty.

    The cheap test is a plain expression, so the function sees only pairs that pass it.
    """
    la, lb = F.length(a), F.length(b)
    near = (la > 0) & (lb > 0) & (F.abs(la - lb) <= 0.25 * F.greatest(la, lb))
    return F.when(near, alike(F.when(near, a).otherwise(""), F.when(near, b).otherwise("")))


def abstract_prefixed(blocks: DataFrame, abstracts: DataFrame, id_col: str, threshold: float = 0.92) -> DataFrame:
    """Blocks of documents with an abstract behind a title 'Abstract' and, if no block is similar to it, the abstract itself."""
    texts = abstracts.select(id_col, squeeze("abstract").alias("abstract")).where("abstract <> ''")
    joined = blocks.join(texts, id_col)
    close = joined.select(id_col, similarity(compare_form(nfkc("text")), compare_form(nfkc("abstract"))).alias("s")).groupBy(id_col).agg(F.max("s").alias("s"))
    known = texts.join(close, id_col, "left").withColumn("exists", F.coalesce(F.col("s") >= threshold, F.lit(False)))
    title = known.select(id_col, F.lit(-2).cast("long").alias("pos"), F.lit("title").alias("type"), F.lit("Abstract").alias("text"))
    added = known.where(~F.col("exists")).select(id_col, F.lit(-1).cast("long").alias("pos"), F.lit("paragraph").alias("type"), F.col("abstract").alias("text"))
    return numbered(title.union(added).union(blocks.select(id_col, "pos", "type", "text")), id_col).select(id_col, "order_index", "type", "text")
