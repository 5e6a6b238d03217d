"""Figure queries. A part is a figure: its brand the document, its size the number; every seventh kind has another defect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.geometry import above_caption, clipped, is_box, is_visual_text, pixel_box, rect
from ..functions.numbers import half_even
from ..functions.text import backfilled, caption_flags, caption_quality, caption_start, figure_number, from_caption_start, id_number, merged_captions
from ..operators.evaluation import computed
from ..operators.extraction import chosen_figures, exported
from ..operators.figures import ROLES, best_captions, best_of, clusters, front_page_score, label_box, manifests, primary_role, ranked, review, teaser_score, with_fallbacks
from .registry import query, table


def captions(spark: SparkSession, d: str) -> DataFrame:
    """(p_partkey, doc, number, caption)"""
    k, n, name = F.col("p_partkey") % 7, F.col("p_size"), F.col("p_name")
    label = lambda of, mark: F.concat(F.lit("Fig. "), of.cast("string"), F.lit(mark))
    text = (
        F.when(k == 0, F.lit("  "))
        .when(k == 1, name)
        .when(k == 2, F.concat(label(n + 1, ": "), name))
        .when(k == 3, F.concat(label(n, ". "), F.lit("Introduction to "), name))
        .when(k == 4, F.concat(F.lit("Figure "), n.cast("string"), F.lit(": x")))
        .when(k == 5, F.concat(F.lit("As seen in "), label(n, ": "), name, F.lit(" "), F.col("p_type")))
        .otherwise(F.concat(label(n, ": "), name, F.lit(" "), F.col("p_type")))
    )
    return table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("doc"), n.cast("long").alias("number"), text.alias("caption"))


CAPTION = """cap AS (SELECT p_partkey, p_brand AS doc, p_size::bigint AS number, CASE p_partkey % 7 WHEN 0 THEN '  ' WHEN 1 THEN p_name WHEN 2 THEN 'Fig. ' || (p_size + 1) || ': ' || p_name WHEN 3 THEN 'Fig. ' || p_size || '. Introduction to ' || p_name
  WHEN 4 THEN 'Figure ' || p_size || ': x' WHEN 5 THEN 'As seen in Fig. ' || p_size || ': ' || p_name || ' ' || p_type ELSE 'Fig. ' || p_size || ': ' || p_name || ' ' || p_type END AS caption FROM part),
flag AS (SELECT *, trim(caption) AS t, nullif(regexp_extract(caption, '(?i)\\bfig(?:ure)?\\.?\\s*(\\d+)\\b', 1), '')::bigint AS own FROM cap),
flags AS (SELECT *, CASE WHEN t = '' THEN ['empty_caption'] ELSE list_filter([CASE WHEN NOT regexp_matches(t, '(?i)^\\s*fig(?:ure)?\\.?\\s*\\d+\\b') THEN 'caption_prefix_unexpected' END, CASE WHEN own <> number THEN 'caption_number_mismatch' END,
  CASE WHEN length(t) < 15 THEN 'caption_too_short' END, CASE WHEN length(t) > 1200 THEN 'caption_too_long' END, CASE WHEN regexp_matches(t, '(?i)\\b(Abstract|Introduction|CCS Concepts)\\b') THEN 'caption_contains_body_text' END], lambda x: x IS NOT NULL) END AS f FROM flag)"""


@query(f"WITH {CAPTION} SELECT p_partkey, own AS from_caption, coalesce(CASE WHEN p_partkey % 2 = 0 THEN number END, own) AS number, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE number END AS from_id FROM flags")
def caption_number(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("Figure"), F.col("number").cast("string"))).otherwise("")
    fig = F.concat(F.when(F.col("p_partkey") % 3 == 0, "fig-").otherwise("fig_"), F.col("number").cast("string"))
    return captions(spark, d).select("p_partkey", figure_number(F.lit(""), "caption").alias("from_caption"), figure_number(name, "caption").alias("number"), id_number(fig).alias("from_id"))


@query(f"WITH {CAPTION} SELECT p_partkey, CASE WHEN p_partkey % 7 = 5 THEN 11::bigint WHEN p_partkey % 7 IN (3, 4, 6) THEN 0::bigint END AS start, CASE WHEN p_partkey % 7 = 5 THEN t[12:] ELSE t END AS caption FROM flags", name="caption_start")
def caption_starts(spark: SparkSession, d: str) -> DataFrame:
    return captions(spark, d).select("p_partkey", caption_start("caption", "number").alias("start"), from_caption_start("caption", "number").alias("caption"))


@query(f"WITH {CAPTION} SELECT p_partkey, array_to_string(f, ';') AS flags FROM flags", name="caption_flags")
def flags_of(spark: SparkSession, d: str) -> DataFrame:
    return captions(spark, d).select("p_partkey", F.array_join(caption_flags("caption", "number"), ";").alias("flags"))


@query(f"WITH {CAPTION} SELECT p_partkey, len(list_filter(f, lambda x: x IN ('empty_caption','caption_prefix_unexpected','caption_number_mismatch','caption_contains_body_text')))::bigint AS hard, len(f)::bigint AS total FROM flags", name="caption_quality")
def quality_of(spark: SparkSession, d: str) -> DataFrame:
    held = captions(spark, d).withColumn("f", caption_flags("caption", "number"))
    return held.select("p_partkey", caption_quality("f").alias("q")).select("p_partkey", "q.hard", "q.total")


@query(f"""WITH {CAPTION} SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'Fig. ' || number || ': from text' WHEN 1 THEN 'Fig. ' || number || ': from text' WHEN 2 THEN 'Fig. ' || number || ': from text' WHEN 5 THEN t[12:] ELSE t END AS caption FROM flags""")
def caption_backfill(spark: SparkSession, d: str) -> DataFrame:
    candidate = F.concat(F.lit("See Fig. "), F.col("number").cast("string"), F.lit(": from text"))
    return captions(spark, d).select("p_partkey", backfilled("caption", "number", candidate).alias("caption"))


@query(f"""WITH {CAPTION}, cand AS (SELECT doc, number, p_partkey, CASE WHEN p_partkey % 7 = 5 THEN t[12:] ELSE t END AS caption, p_partkey % 4 = 0 AS is_cap,
  CASE WHEN p_partkey % 7 = 3 THEN 1 ELSE 0 END AS hard, CASE WHEN p_partkey % 7 = 3 THEN 1 ELSE 0 END + CASE WHEN length(CASE WHEN p_partkey % 7 = 5 THEN t[12:] ELSE t END) < 15 THEN 1 ELSE 0 END AS total FROM flags WHERE p_partkey % 7 IN (3, 4, 5, 6)
  UNION ALL SELECT doc, number + 1, p_partkey, t, p_partkey % 4 = 0, 0, CASE WHEN length(t) < 15 THEN 1 ELSE 0 END FROM flags WHERE p_partkey % 7 = 2)
SELECT doc, number, caption FROM (SELECT *, row_number() OVER (PARTITION BY doc, number ORDER BY hard, total, is_cap DESC, CASE WHEN is_cap THEN -p_partkey ELSE p_partkey END) AS n FROM cand) WHERE n = 1""")
def best_caption(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_partkey") % 4 == 0, "caption").otherwise("paragraph")
    return best_captions(captions(spark, d).select("doc", F.col("p_partkey").alias("order"), kind.alias("type"), F.col("caption").alias("text")))


@query(r"""WITH RECURSIVE line AS (SELECT doc_id, string_split(text, chr(10)) AS w FROM documents),
fold(doc_id, w, i, last, kept) AS (SELECT doc_id, w, 0, NULL::varchar, '' FROM line
  UNION ALL SELECT doc_id, w, i + 1, CASE WHEN skip THEN last ELSE x END, CASE WHEN skip THEN kept ELSE kept || ' ' || x END
  FROM (SELECT *, w[i + 1] AS x, last IS NOT NULL AND (w[i + 1] = last OR contains(lower(last), lower(w[i + 1]))) AS skip FROM fold WHERE i < len(w)))
SELECT doc_id, trim(regexp_replace(kept, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS caption FROM fold WHERE i = len(w)""")
def caption_merge(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each document as blocks in reading order, repeats of the part before left out."""
    return table(spark, d, "documents").select("doc_id", merged_captions(F.split("text", "\n")).alias("caption"))


@query(f"""WITH {CAPTION}, agg AS (SELECT doc, count(*) AS items, count(DISTINCT number) AS different, min(number) AS low, max(number) AS high, count_if(t = '') AS empties, count_if(list_contains(f, 'caption_prefix_unexpected')) AS prefixes,
  count_if(list_contains(f, 'caption_number_mismatch')) AS mismatches, count_if(list_contains(f, 'caption_contains_body_text')) AS bodies FROM flags WHERE doc NOT IN ('Brand#1') AND (doc <> 'Brand#2' OR number <> 1) GROUP BY 1),
docs AS (SELECT DISTINCT doc FROM cap)
SELECT doc, coalesce(items::varchar, '0') AS num_figures, 'yes' AS needs_review, CASE WHEN items IS NULL THEN 'figure extraction failed' ELSE array_to_string(list_filter([CASE WHEN low <> 1 THEN 'does not start at figure 1' END, CASE WHEN high - low + 1 > different THEN (high - low + 1 - different) || ' missing' END,
  CASE WHEN items > different THEN (items - different) || ' repeated' END, CASE WHEN empties > 0 THEN empties || ' empty captions' END, CASE WHEN prefixes > 0 THEN prefixes || ' captions without label' END, CASE WHEN mismatches > 0 THEN mismatches || ' captions of another number' END,
  CASE WHEN bodies > 0 THEN bodies || ' captions with body text' END], lambda x: x IS NOT NULL), '; ') END AS issues FROM docs LEFT JOIN agg USING (doc)""")
def figure_review_rollup(spark: SparkSession, d: str) -> DataFrame:
    c = captions(spark, d)
    figures = c.where("doc <> 'Brand#1' and (doc <> 'Brand#2' or number <> 1)").select("doc", F.concat(F.lit("fig_"), F.col("number").cast("string")).alias("fig_id"), "caption")
    return review(c.select("doc").distinct(), figures)


def annotated(spark: SparkSession, d: str) -> DataFrame:
    """Figures with six role scores: the first numbers of an embedding, in half tenths so that ties occur; the label is the document."""
    e = table(spark, d, "embeddings")
    scores = {r: F.round(F.abs(F.col("embedding")[i].cast("double")) * 20) / 20 for i, r in enumerate(ROLES)}
    return e.select(F.col("label").alias("doc"), F.col("vec_id").alias("pos"), F.concat(F.lit("fig_"), F.col("vec_id")).alias("fig_id"), *(v.alias(k) for k, v in scores.items()), primary_role(scores).alias("primary_role"))


ANNOTATED = f"""role AS (SELECT label AS doc, vec_id AS pos, 'fig_' || vec_id AS fig_id, {', '.join(f'round(abs(embedding[{i + 1}]::double) * 20) / 20 AS {r}' for i, r in enumerate(ROLES))} FROM embeddings),
fig AS (SELECT *, CASE greatest({', '.join(ROLES)}) {' '.join(f"WHEN {r} THEN '{r}'" for r in ROLES)} END AS primary_role FROM role)"""


@query(f"WITH {ANNOTATED} SELECT fig_id, primary_role FROM fig")
def argmax_role(spark: SparkSession, d: str) -> DataFrame:
    return annotated(spark, d).select("fig_id", "primary_role")


@query(f"WITH {ANNOTATED} SELECT fig_id, doc, row_number() OVER (PARTITION BY doc ORDER BY interface DESC, pos)::int AS interface_rank FROM fig")
def interface_rank(spark: SparkSession, d: str) -> DataFrame:
    return ranked(annotated(spark, d)).select("fig_id", "doc", "interface_rank")


@query(f"WITH {ANNOTATED}, docs AS (SELECT DISTINCT doc FROM fig) SELECT doc, (SELECT f.fig_id FROM fig f WHERE f.doc = docs.doc AND f.primary_role = 'interface' ORDER BY f.interface DESC, f.pos LIMIT 1) AS interface_figure FROM docs")
def interface_top1(spark: SparkSession, d: str) -> DataFrame:
    return manifests(annotated(spark, d)).select("doc", "interface_figure")


@query(f"""WITH {ANNOTATED}, top AS (SELECT doc, list(interface ORDER BY interface DESC) AS s, count_if(primary_role = 'interface') AS n FROM fig GROUP BY 1) SELECT doc, n = 0 OR (len(s) > 1 AND (s[1] < 0.5 OR s[1] - s[2] < 0.12)) AS needs_manual_review FROM top""")
def manual_review(spark: SparkSession, d: str) -> DataFrame:
    return manifests(annotated(spark, d)).select("doc", "needs_manual_review")


BOX = "(l_partkey % 900) AS l, (l_suppkey * 37 % 900) AS t, (l_partkey % 900 + l_quantity::bigint * 3) AS r, (l_suppkey * 37 % 900 + l_linenumber * 20) AS b"


@query(f"""WITH x AS (SELECT l_orderkey, l_linenumber, {BOX} FROM lineitem),
y AS (SELECT *, greatest(0, round_even(l / 1000.0::double * 1921, 0)::bigint) AS left_, greatest(0, round_even(t / 1000.0::double * 833, 0)::bigint) AS top_, least(1921, round_even(r / 1000.0::double * 1921, 0)::bigint) AS right_, least(833, round_even(b / 1000.0::double * 833, 0)::bigint) AS bottom_ FROM x)
SELECT l_orderkey, l_linenumber, left_ AS "left", top_ AS "top", CASE WHEN right_ - left_ < 24 THEN least(1921, left_ + 24) ELSE right_ END AS "right", CASE WHEN bottom_ - top_ < 24 THEN least(833, top_ + 24) ELSE bottom_ END AS "bottom", r <= 1000 AND b <= 1000 AS ok FROM y""", name="pixel_box")
def pixel_boxes(spark: SparkSession, d: str) -> DataFrame:
    left, top = F.col("l_partkey") % 900, F.col("l_suppkey") * 37 % 900
    right, bottom = left + F.col("l_quantity").cast("long") * 3, top + F.col("l_linenumber") * 20
    box = pixel_box(rect(left, top, right, bottom), F.lit(1921).cast("long"), F.lit(833).cast("long"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", box.alias("p"), is_box(left, top, right, bottom).alias("ok")).select("l_orderkey", "l_linenumber", "p.*", "ok")


def page_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Regions and captions on pages of 612 by 792; numbers of a line as corners."""
    x0, y0 = (F.col("l_partkey") * 7 % 600).cast("double"), (F.col("l_suppkey") * 13 % 700).cast("double")
    region = rect(x0 - 20, y0 - 10, x0 + F.col("l_quantity") * 8, y0 + 40 + F.col("l_linenumber") * 30)
    caption = rect(x0 + F.col("l_linenumber") * 10, y0 + 20 + F.col("l_quantity") * 3, x0 + 200, y0 + 60 + F.col("l_quantity") * 3)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_returnflag", "l_linestatus", "l_quantity", region.alias("region"), caption.alias("caption"))


PAGE = """geo AS (SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus, x - 20 AS x0, y - 10 AS y0, x + l_quantity * 8 AS x1, y + 40 + l_linenumber * 30 AS y1, x + l_linenumber * 10 AS cx0, y + 20 + l_quantity * 3 AS cy0, x + 200 AS cx1, y + 60 + l_quantity * 3 AS cy1
FROM (SELECT *, (l_partkey * 7 % 600)::double AS x, (l_suppkey * 13 % 700)::double AS y FROM lineitem))"""


@query(f"""WITH {PAGE}, clip AS (SELECT * REPLACE (greatest(x0, 0) AS x0, greatest(y0, 0) AS y0, least(x1, 612) AS x1, least(y1, 792) AS y1) FROM geo),
trim AS (SELECT *, greatest(0, least(x1, cx1) - greatest(x0, cx0)) AS shared, least(y1, greatest(y0 + 20, cy0 - 2.8)) AS bottom FROM clip)
SELECT l_orderkey, l_linenumber, x0, y0, x1, CASE WHEN shared >= 0.35 * least(x1 - x0, cx1 - cx0) AND cy0 <= y1 + 12 AND cy0 > y0 AND bottom > y0 + 10 THEN bottom ELSE y1 END AS y1,
NOT ((x1 - x0) / 612 > 0.72 AND 60 > 40) AND l_linenumber <= 4 AS visual FROM trim""")
def rect_clip_trim(spark: SparkSession, d: str) -> DataFrame:
    page = rect(F.lit(0), F.lit(0), F.lit(612), F.lit(792))
    boxed = page_boxes(spark, d).withColumn("region", clipped(F.col("region"), page)).withColumn("out", above_caption(F.col("region"), F.col("caption"), 8.0))
    visual = is_visual_text(F.repeat(F.lit("wide text "), F.lit(6)), F.col("l_linenumber"), F.col("region"), page)
    return boxed.select("l_orderkey", "l_linenumber", "out.*", visual.alias("visual"))


@query(f"""WITH {PAGE}, s AS (SELECT *, CASE WHEN y1 <= cy0 AND greatest(x1-x0,0)*greatest(y1-y0,0) >= 2500 AND greatest(0, cy0 - y1) <= 0.28::double * 792 THEN
  CASE l_returnflag WHEN 'A' THEN 25.0::double WHEN 'N' THEN 20.0 ELSE 8.0 + 25.0 END + least(30.0::double, greatest(x1-x0,0)*greatest(y1-y0,0) / 4000) - greatest(0, cy0 - y1) / 3 END AS score FROM geo)
SELECT l_orderkey, l_linenumber, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS n FROM s WHERE score IS NOT NULL) WHERE n = 1""")
def teaser_top1(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.when(F.col("l_returnflag") == "A", "image").when(F.col("l_returnflag") == "N", "drawing").otherwise("image,text")
    scored = page_boxes(spark, d).withColumn("score", teaser_score(F.col("region"), kinds, F.col("caption"), F.lit(792.0)))
    return best_of(scored, "l_orderkey", "score", "l_linenumber").select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"))


def near(c: str) -> str:
    return f"least({c}.x1 + 14, b.x1) > greatest({c}.x0 - 14, b.x0) AND least({c}.y1 + 14, b.y1) > greatest({c}.y0 - 14, b.y0)"


@query(f"""WITH RECURSIVE {PAGE},
b AS (SELECT l_orderkey AS page, CASE l_returnflag WHEN 'A' THEN 'image' ELSE 'drawing' END AS kind, x0::double AS x0, y0::double AS y0, x1::double AS x1, y1::double AS y1, row_number() OVER (PARTITION BY l_orderkey ORDER BY y0, x0, x1, y1, CASE l_returnflag WHEN 'A' THEN 'image' ELSE 'drawing' END) AS i FROM geo WHERE x1 > x0 AND y1 > y0),
s AS (SELECT page, i, [{{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1, 'kinds': [kind], 'n': 1}}] AS made FROM b WHERE i = 1
UNION ALL SELECT s.page, b.i, CASE WHEN h.n IS NULL THEN list_append(made, {{'x0': b.x0, 'y0': b.y0, 'x1': b.x1, 'y1': b.y1, 'kinds': [b.kind], 'n': 1}})
  ELSE made[1 : h.at - 1] || [{{'x0': least(b.x0, h.x0), 'y0': least(b.y0, h.y0), 'x1': greatest(b.x1, h.x1), 'y1': greatest(b.y1, h.y1), 'kinds': list_append(h.kinds, b.kind), 'n': (h.n + 1)::int}}] || list_filter(made[h.at + 1 :], lambda c: NOT ({near('c')})) END
  FROM s JOIN b ON b.page = s.page AND b.i = s.i + 1, LATERAL (SELECT min(k) AS at, min(c.x0) AS x0, min(c.y0) AS y0, max(c.x1) AS x1, max(c.y1) AS y1, flatten(list(c.kinds)) AS kinds, sum(c.n) AS n FROM (SELECT unnest(made) AS c, generate_subscripts(made, 1) AS k) WHERE {near('c')}) h),
f AS (SELECT page, unnest(list_filter(arg_max(made, i), lambda c: (c.x1 - c.x0) * (c.y1 - c.y0) >= 600)) AS c, generate_subscripts(list_filter(arg_max(made, i), lambda c: (c.x1 - c.x0) * (c.y1 - c.y0) >= 600), 1) - 1 AS cluster FROM s GROUP BY page)
SELECT page, cluster::bigint AS cluster, c.x0 AS x0, c.y0 AS y0, c.x1 AS x1, c.y1 AS y1, array_to_string(list_sort(list_distinct(c.kinds)), ',') AS kinds, c.n::bigint AS n FROM f""")
def primitive_clusters(spark: SparkSession, d: str) -> DataFrame:
    boxes = page_boxes(spark, d).select(F.col("l_orderkey").alias("page"), F.when(F.col("l_returnflag") == "A", "image").otherwise("drawing").alias("kind"), "region.*")
    return clusters(boxes.where("x1 > x0 and y1 > y0"))


@query(f"""WITH {CAPTION}, f AS (SELECT doc, p_partkey AS "index", own AS number, caption, 'tool' AS source FROM flags WHERE own IS NOT NULL AND number > 5),
t AS (SELECT doc, min(caption) AS caption FROM flags GROUP BY 1) SELECT * FROM f UNION ALL SELECT doc, 0, 1, coalesce(nullif(caption, ''), 'Figure 1'), 'teaser_fallback' FROM t WHERE doc NOT IN (SELECT doc FROM f WHERE number = 1)""")
def fallback_insert(spark: SparkSession, d: str) -> DataFrame:
    c = captions(spark, d).withColumn("own", figure_number(F.lit(""), "caption"))
    figures = c.where("own is not null and number > 5").select("doc", F.col("p_partkey").alias("index"), F.col("own").alias("number"), "caption", F.lit("tool").alias("source"))
    return with_fallbacks(figures, c.groupBy("doc").agg(F.min("caption").alias("caption")))


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY round_even(l_extendedprice / 7, 1), l_discount, l_linenumber)::int AS place FROM lineitem""")
def reading_order(spark: SparkSession, d: str) -> DataFrame:
    order = W.Window.partitionBy("l_orderkey").orderBy(half_even(F.col("l_extendedprice") / 7, 1), "l_discount", "l_linenumber")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.row_number().over(order).alias("place"))


@query("""SELECT p_brand AS doc, p_partkey, 'fig_' || p_size AS fig_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey)::int AS place FROM part""")
def numeric_suffix_sort(spark: SparkSession, d: str) -> DataFrame:
    """Figures of a document by the number in their id, not by its digits."""
    own = table(spark, d, "part").select(F.col("p_brand").alias("doc"), "p_partkey", F.concat(F.lit("fig_"), F.col("p_size")).alias("fig_id"))
    return own.withColumn("place", F.row_number().over(W.Window.partitionBy("doc").orderBy(id_number("fig_id"), "p_partkey")))


@query(f"""WITH {PAGE}, s AS (SELECT *, greatest(x1-x0,0)*greatest(y1-y0,0) AS a, CASE l_returnflag WHEN 'A' THEN 20.0::double WHEN 'N' THEN 18.0 ELSE 26.0 END AS k FROM geo),
t AS (SELECT *, CASE WHEN a >= 4000 AND y0 <= 0.68::double * 792 THEN k + least(40.0::double, a / 5000) + CASE WHEN y0 >= 100 THEN 20.0::double ELSE -15.0 END +
  CASE WHEN l_linenumber % 3 = 0 THEN -abs(y0 - 0.4::double * 792) / 6 WHEN y1 <= cy0 + 24 THEN 25.0::double - greatest(0, cy0 - y1) / 3 WHEN least(cx1 + 12, x1) > greatest(cx0 - 12, x0) AND least(cy1 + 12, y1) > greatest(cy0 - 12, y0) THEN 12.0::double ELSE -least(40.0::double, abs(y0 - cy0) / 5) END END AS score FROM s)
SELECT l_orderkey, l_linenumber, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score DESC, l_linenumber) AS n FROM t WHERE score IS NOT NULL) WHERE n = 1""")
def front_page_top1(spark: SparkSession, d: str) -> DataFrame:
    """The best cluster of a first page; every third line has no abstract on its page."""
    kinds = F.when(F.col("l_returnflag") == "A", "image").when(F.col("l_returnflag") == "N", "drawing").otherwise("image,text")
    abstract = F.when(F.col("l_linenumber") % 3 != 0, F.col("caption"))
    placed = computed(page_boxes(spark, d), {"kinds": kinds, "abstract": abstract})
    scored = placed.withColumn("score", front_page_score(F.col("region"), F.col("kinds"), F.lit(100.0), F.col("abstract"), F.lit(792.0)))
    return best_of(scored, "l_orderkey", "score", "l_linenumber").select("l_orderkey", "l_linenumber", F.round("score", 6).alias("score"))


@query(f"""WITH {ANNOTATED}, docs AS (SELECT DISTINCT doc FROM fig), m AS (SELECT doc, (SELECT f.fig_id FROM fig f WHERE f.doc = docs.doc AND f.primary_role = 'interface' ORDER BY f.interface DESC, f.pos LIMIT 1) AS fig_id FROM docs)
SELECT m.doc, m.fig_id, CASE WHEN m.fig_id IS NULL THEN 'none_selected' WHEN f.pos % 4 = 0 THEN 'not_found' WHEN f.pos % 4 = 1 THEN 'no_image_path' WHEN f.pos % 4 = 2 THEN 'no_caption' ELSE 'ok' END AS status FROM m LEFT JOIN fig f ON f.doc = m.doc AND f.fig_id = m.fig_id""")
def interface_lookup(spark: SparkSession, d: str) -> DataFrame:
    own, k = annotated(spark, d), F.col("pos") % 4
    files = own.where(k != 0).select("doc", "fig_id", F.when(k != 1, "path").alias("image_path"), F.when(k != 2, "caption").alias("caption"))
    return chosen_figures(manifests(own), files)


@query("""SELECT l_orderkey AS page, l_linenumber AS number, min(l_quantity) AS x0, min(l_discount) AS y0, max(l_quantity + 10) AS x1, max(l_discount + 1) AS y1 FROM lineitem WHERE l_partkey % 5 <> 4 GROUP BY 1, 2""")
def label_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes around all places of a label; it is spelled in four ways, and a fifth one is none."""
    li, k, n = table(spark, d, "lineitem"), F.col("l_partkey") % 5, F.col("l_linenumber").cast("string")
    text = F.concat(F.when(k == 0, "see Fig. ").when(k == 1, "Fig ").when(k == 2, "Figure ").when(k == 3, "FIG. ").otherwise("Table "), n)
    hits = li.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("number"), text.alias("text"), F.col("l_quantity").alias("x0"), F.col("l_discount").alias("y0"), (F.col("l_quantity") + 10).alias("x1"), (F.col("l_discount") + 1).alias("y1"))
    return label_box(hits)


@query(f"""WITH {CAPTION}, g AS (SELECT *, p_partkey * 7 % 500 AS x, p_partkey * 13 % 600 AS y FROM flags)
SELECT doc, p_partkey AS "index", own AS number, CASE WHEN p_partkey % 6 = 0 THEN caption WHEN own = number AND p_partkey % 7 = 5 THEN t[12:] ELSE t END AS caption, CASE WHEN p_partkey % 6 <> 0 THEN greatest(x - 8, 0)::double END AS x0, CASE WHEN p_partkey % 6 <> 0 THEN greatest(y - 8, 0)::double END AS y0,
CASE WHEN p_partkey % 6 <> 0 THEN least(x + 208, 612)::double END AS x1, CASE WHEN p_partkey % 6 <> 0 THEN least(y + 108, 792)::double END AS y1, CASE WHEN p_partkey % 6 <> 0 THEN lpad(p_partkey::varchar, greatest(3, length(p_partkey::varchar))::int, '0') || '_' || regexp_replace(p_name, '[^\\p{{L}}\\p{{N}}_-]', '_', 'g') || '.png' END AS file,
CASE WHEN p_partkey % 6 = 0 THEN 'missing_region_boundary' ELSE 'ok' END AS status FROM (SELECT g.*, p_name FROM g JOIN part USING (p_partkey))""")
def exported_figures(spark: SparkSession, d: str) -> DataFrame:
    x, y = F.col("p_partkey") * 7 % 500, F.col("p_partkey") * 13 % 600
    raw = captions(spark, d).join(table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")), "p_partkey").select(
        "doc", F.col("p_partkey").alias("index"), "name", "caption", F.when(F.col("p_partkey") % 6 != 0, rect(x, y, x + 200, y + 100)).alias("region"), F.lit(None).cast("struct<x0: double, y0: double, x1: double, y1: double>").alias("caption_box"), F.lit("").alias("candidate")
    )
    return exported(raw, rect(F.lit(0), F.lit(0), F.lit(612), F.lit(792))).select("doc", "index", "number", "caption", "box.x0", "box.y0", "box.x1", "box.y1", "file", "status")
