"""Text columns: white space, slugs, figure labels, captions, safe names. All expressions stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space of all scripts, and the four ASCII separators.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: What a figure's number, its label and body text look like.
FIGURE_NUMBER = r"(?i)\bfig(?:ure)?\.?\s*(\d+)\b"
FIGURE_PREFIX = r"(?i)^\s*fig(?:ure)?\.?\s*\d+\b"
BODY_TEXT = r"(?i)\b(Abstract|Introduction|CCS Concepts)\b"
#: How a label before a caption is written, in the order in which they are tried; %d is the number.
CAPTION_LABELS = (r"\bfig\.\s*", r"\bfig\s*", r"\bfigure\s*")
CAPTION_MARK = "\\s*[.:：\\-–—]"
#: Characters that a comparison drops, and those that it reads as a hyphen.
ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
DASHES = "\u2010\u2011\u2012\u2013\u2014\u2015\u2212\u00ad"
#: The flags that speak against a caption.
HARD_FLAGS = ("empty_caption", "caption_prefix_unexpected", "caption_number_mismatch", "caption_contains_body_text")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used: a lambda's variable is not inlined."""
    return F.element_at(F.transform(F.array(value), use), 1)


def blank_to_null(c: Column | str) -> Column:
    return F.nullif(col(c), F.lit(""))


def strip(c: Column | str) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(col(c), r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def squeeze(c: Column | str) -> Column:
    """White space as single spaces, none at the ends; null is empty."""
    return F.coalesce(F.trim(F.regexp_replace(col(c), SPACE, " ")), F.lit(""))


def compare_form(c: Column | str) -> Column:
    """squeeze() after dropping zero-width characters and unifying dashes; compatibility forms are unified by `nfkc` first."""
    return squeeze(F.translate(F.translate(col(c), ZERO_WIDTH, ""), DASHES, "-" * len(DASHES)))


def nfkc(c: Column | str) -> Column:
    """Unicode compatibility composition, which has no built-in. Only texts with other characters than ASCII go to Python, and there a
    slice of about a megabyte at a time becomes Python strings, however long a batch is."""

    @F.arrow_udf("string")
    def composed(texts: pa.Array) -> pa.Array:
        return pa.concat_arrays([pa.array((t if t is None else unicodedata.normalize("NFKC", t) for t in part.to_pylist()), pa.string(), size=len(part)) for part in slices(texts)] or [texts])

    own = col(c)
    return F.coalesce(composed(F.when(own.rlike(r"[^\x00-\x7F]"), own)), own)


def slices(texts: pa.Array, size: int = 1 << 20) -> Iterator[pa.Array]:
    """An array cut where its texts add up to a size; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(texts):
        end = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + size, side="right")))
        yield texts.slice(start, end - start)
        start = end


def slug(c: Column | str, fallback: Column | str) -> Column:
    """Lower-case letters and digits joined by single hyphens; the fallback if nothing remains."""
    bare = F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "['’]", "")
    return F.coalesce(blank_to_null(F.trim(F.regexp_replace(bare, "[^a-z0-9]+", "-"), F.lit("-"))), col(fallback))


def initials(c: Column | str) -> Column:
    """First letters of the parts of a slug; x if it has none."""
    found = F.array_join(F.transform(F.split(col(c), "[.-]"), lambda p: F.substring(p, 1, 1)), "")
    return F.coalesce(blank_to_null(found), F.lit("x"))


def pipe_list(c: Column | str) -> Column:
    """Trimmed, non-empty parts between pipes; null is an empty list."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), r"\|"), strip)
    return F.filter(parts, lambda p: p != "")


def number_in(c: Column | str) -> Column:
    """The number of the first figure label in a text."""
    return F.try_to_number(blank_to_null(F.regexp_extract(col(c), FIGURE_NUMBER, 1)), F.lit("9999999999")).cast("long")


def figure_number(name: Column | str, caption: Column | str) -> Column:
    return F.coalesce(number_in(name), number_in(caption))


def id_number(c: Column | str) -> Column:
    """7 for fig_7; null for anything else."""
    return blank_to_null(F.regexp_extract(col(c), r"^fig_(\d+)$", 1)).cast("long")


def has_figure_prefix(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit("")).rlike(FIGURE_PREFIX)


def caption_start(text: Column | str, number: Column | str) -> Column:
    """Offset of the label that starts a caption: the first spelling that occurs wins, not the earliest place."""
    places = []
    for label in CAPTION_LABELS:
        pattern = F.concat(F.lit(f"(?i){label}"), col(number).cast("string"), F.lit(CAPTION_MARK))
        places.append(F.nullif(F.regexp_instr(col(text), pattern), F.lit(0)))
    return F.coalesce(*places).cast("long") - 1


def from_caption_start(text: Column | str, number: Column | str) -> Column:
    """The squeezed text from its label on, or all of it."""

    def cut(whole: Column) -> Column:
        return let(F.coalesce(caption_start(whole, number), F.lit(0)), lambda at: F.trim(F.substr(whole, (at + 1).cast("int"))))

    return let(squeeze(text), cut)


def caption_flags(caption: Column | str, number: Column | str) -> Column:
    """Names of all defects of a caption, in a fixed order; an empty caption has that defect alone."""

    def defects(text: Column) -> Column:
        found = F.filter(
            F.array(
                F.when(~has_figure_prefix(text), "caption_prefix_unexpected"),
                F.when(number_in(text) != col(number), "caption_number_mismatch"),
                F.when(F.length(text) < 15, "caption_too_short"),
                F.when(F.length(text) > 1200, "caption_too_long"),
                F.when(text.rlike(BODY_TEXT), "caption_contains_body_text"),
            ),
            lambda f: f.isNotNull(),
        )
        return F.when(text == "", F.array(F.lit("empty_caption"))).otherwise(found)

    return let(squeeze(caption), defects)


def caption_quality(flags: Column | str) -> Column:
    """(hard, total) counts of defects; structs compare in that order and less is better."""
    hard = F.size(F.filter(col(flags), lambda f: f.isin(*HARD_FLAGS)))
    return F.struct(hard.cast("long").alias("hard"), F.size(col(flags)).cast("long").alias("total"))


def backfilled(caption: Column | str, number: Column | str, candidate: Column | str) -> Column:
    """The caption itself if it starts with its label; else the candidate if that is strictly better or there is none."""

    def chosen(own: Column, other: Column) -> Column:
        better = caption_quality(caption_flags(other, number)) < caption_quality(caption_flags(own, number))
        keep = (caption_start(own, number) == 0) | col(number).isNull() | (other == "")
        return F.when(F.coalesce(keep, F.lit(False)), own).when(better | (own == ""), other).otherwise(own)

    return let(from_caption_start(caption, number), lambda own: let(from_caption_start(candidate, number), lambda other: chosen(own, other)))


def merged_captions(parts: Column | str) -> Column:
    """Blocks in reading order as one text; one that repeats the part kept before it, or is contained in it, is left out."""
    empty = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(None).cast("string").alias("last"))

    def step(state: Column, text: Column) -> Column:
        skip = state["last"].isNotNull() & ((text == state["last"]) | F.contains(F.lower(state["last"]), F.lower(text)))
        grown = F.struct(F.concat(state["kept"], F.array(text)).alias("kept"), text.alias("last"))
        return F.when(skip, state).otherwise(grown)

    return F.aggregate(col(parts), empty, step, lambda state: squeeze(F.array_join(state["kept"], " ")))


def safe_name(c: Column | str) -> Column:
    """Letters, digits, hyphen and underscore; all else is an underscore."""
    return F.regexp_replace(col(c), r"[^\p{L}\p{N}_-]", "_")


def padded(number: Column | str, digits: int) -> Column:
    """A number with leading zeros; longer ones keep all their digits."""
    return let(col(number).cast("string"), lambda s: F.lpad(s, F.greatest(F.lit(digits), F.length(s)), F.lit("0")))


def view_id(c: Column | str) -> Column:
    """view-7 for 7; other ids without white space at the ends."""
    return F.when(strip(c).rlike(r"^\d+$"), F.concat(F.lit("view-"), strip(c))).otherwise(strip(c))


def labelled_score(text: Column | str, label: str) -> Column:
    """The number after a label and a colon, as a score from 0 to 1."""
    plain = F.regexp_extract(col(text), f"(?i)`?{label}`?\\s*[:：]\\s*([01](?:\\.\\d+)?)", 1)
    quoted = F.regexp_extract(col(text), f'(?i)"{label}"\\s*[:：]\\s*([01](?:\\.\\d+)?)', 1)
    return let(F.coalesce(blank_to_null(plain), blank_to_null(quoted)).cast("double"), lambda x: F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))))


def paired(category: str, inner: str) -> Column:
    """'A > B' for each inner name of a pair, or the outer name alone."""
    return F.flatten(
        F.transform(F.coalesce(F.col(category), F.array()), lambda p: F.when(F.size(F.coalesce(p[inner], F.array())) > 0, F.transform(p[inner], lambda x: F.concat(p["name"], F.lit(" > "), x))).otherwise(F.array(p["name"])))
    )


def data_url(content: Column | str, mime: Column | str) -> Column:
    return F.concat(F.lit("data:"), F.coalesce(col(mime), F.lit("image/png")), F.lit(";base64,"), F.base64(col(content)))


#: A line that ends an abstract starts with one of these, in the order in which they are tried.
ABSTRACT_ENDS = (
    r"\bkeywords?\b", r"\bkey\s*words?\b", r"\bindex\b", r"\bindex\s*terms?\b", r"\bindexing\s*terms?\b", r"\bintroduction\b",
    r"\bbackground\b", r"\brelated\s+work\b", r"^\s*1\s*[\.\)]\s*", r"^\s*i\s*[\.\)]\s*", r"^\s*section\s+1\b", r"^\s*chapter\s+1\b",
)


def abstract(c: Column | str) -> Column:
    """The abstract in a text: from the first line with that word to the first heading that ends it; null below 20 characters."""
    space = r"[\s\x1c-\x1f]"
    lines = F.regexp_replace(F.regexp_replace(col(c), "\r\n?", "\n"), "[ \t]+", " ")
    tidy = strip(F.regexp_replace(lines, "\n{3,}", "\n\n"))
    rest = blank_to_null(F.regexp_extract(tidy, r"(?isdU)(?:^|\n)([^\n]*\babstract\b.*)$", 1))

    def ended(body: Column) -> Column:
        ends = [F.nullif(F.regexp_instr(body, F.lit(rf"(?imdU)^\s*{p}\b".replace(r"\s", space))), F.lit(0)) for p in ABSTRACT_ENDS]
        return F.substr(body, F.lit(1), F.coalesce(*ends, F.length(body) + 1) - 1)

    body = let(F.regexp_replace(rest, r"(?iU)\A\s*(abstract|摘要)\s*[:：\-—]*\s*".replace(r"\s", space), ""), ended)
    return let(strip(F.regexp_replace(strip(body), r"(?U)\s*\n\s*".replace(r"\s", space), " ")), lambda text: F.when(F.length(text) >= 20, text))
