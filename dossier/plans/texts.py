"""Text, list and id queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import distinct_ignoring_case, distinct_stripped, listed, strings_of, with_missing
from ..functions.jsonx import first_object, is_object, ladder, parsed
from ..functions.text import ABSTRACT_ENDS, abstract, compare_form, initials, labelled_score, nfkc, pipe_list, safe_name, slug, squeeze, view_id
from ..operators.blocks import abstract_prefixed, deduplicated, html_blocks, numbered
from ..operators.ids import coordination_id, hierarchical_ids, is_identifier, is_open_value, unique_ids
from ..operators.similar import similar_pairs
from ..operators.tei import tei_blocks
from .registry import query, table

WORDS = """word AS (SELECT doc_id, pos, w FROM (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS pos FROM (SELECT doc_id, regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+') AS w FROM documents)) WHERE w <> '')"""


def words(spark: SparkSession, d: str, which: Column | None = None) -> DataFrame:
    docs = table(spark, d, "documents")
    return (docs if which is None else docs.where(which)).select("doc_id", F.split("text", r"[ \t\n\x0B\f\r]+").alias("w"))


def listed_as(spark_list):
    return F.array_join(spark_list, "|")


@query(f"WITH {WORDS}, f AS (SELECT doc_id, w, min(pos) AS pos FROM word GROUP BY 1, 2) SELECT doc_id, string_agg(w, '|' ORDER BY pos) AS w FROM f GROUP BY 1")
def ordered_dedupe_cs(spark: SparkSession, d: str) -> DataFrame:
    return words(spark, d).select("doc_id", listed_as(distinct_stripped("w")).alias("w"))


@query(f"WITH {WORDS}, f AS (SELECT doc_id, arg_min(w, pos) AS w, min(pos) AS pos FROM word GROUP BY doc_id, lower(w)) SELECT doc_id, string_agg(w, '|' ORDER BY pos) AS w FROM f GROUP BY 1")
def ordered_dedupe_ci(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a word have no row; that is asked of the text, as a test of the list would compute it twice."""
    return words(spark, d, F.col("text").rlike(r"[^ \t\n\x0B\f\r]")).select("doc_id", listed_as(distinct_ignoring_case("w")).alias("w"))


@query("""WITH item AS (SELECT p_partkey, unnest(['  ' || p_brand, upper(p_brand), p_type || ' ', p_brand, NULL, '', lower(p_type), p_name]) AS w, generate_subscripts([1,2,3,4,5,6,7,8], 1) AS pos FROM part),
f AS (SELECT p_partkey, arg_min(trim(w), pos) AS w, min(pos) AS pos FROM item WHERE trim(coalesce(w, '')) <> '' GROUP BY p_partkey, lower(trim(w))) SELECT p_partkey, string_agg(w, '|' ORDER BY pos) AS w FROM f GROUP BY 1""")
def list_dedupe_ci(spark: SparkSession, d: str) -> DataFrame:
    b, t = F.col("p_brand"), F.col("p_type")
    own = F.array(F.concat(F.lit("  "), b), F.upper(b), F.concat(t, F.lit(" ")), b, F.lit(None).cast("string"), F.lit(""), F.lower(t), F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", listed_as(distinct_ignoring_case(own)).alias("w"))


@query("""WITH ref AS (SELECT l_orderkey, s_nationkey AS n, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey END AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
needed AS (SELECT l_orderkey, s_nationkey AS n, NULL::bigint AS s FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_linenumber % 2 = 0)
SELECT l_orderkey, string_agg(n || ':' || coalesce(s::varchar, '-'), '|' ORDER BY n, s NULLS FIRST) AS refs FROM (SELECT * FROM ref UNION SELECT * FROM needed) GROUP BY 1""")
def struct_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """References (nation, supplier or none) once each, with the parents of those that name a supplier, sorted."""
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    even = F.col("l_linenumber") % 2 == 0
    ref = F.struct(F.col("s_nationkey").alias("n"), F.when(even, F.col("l_suppkey")).alias("s"))
    parent = F.when(even, F.struct(F.col("s_nationkey").alias("n"), F.lit(None).cast("long").alias("s")))
    own = li.groupBy("l_orderkey").agg(F.collect_set(ref).alias("refs"), F.collect_set(parent).alias("needed"))
    text = F.transform(with_missing("refs", "needed", in_order=False), lambda r: F.concat(r["n"].cast("string"), F.lit(":"), F.coalesce(r["s"].cast("string"), F.lit("-"))))
    return own.select("l_orderkey", listed_as(text).alias("refs"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type || '|x' WHEN event_id % 4 = 1 THEN '' WHEN event_id % 4 = 2 THEN '' ELSE 'a|' || event_type END AS strings, CASE WHEN event_id % 4 = 2 THEN 1 WHEN event_id % 4 = 1 THEN NULL WHEN event_id % 4 = 0 THEN 4 ELSE 3 END AS n_listed FROM events""")
def typed_list_coercion(spark: SparkSession, d: str) -> DataFrame:
    """Lists of mixed types, objects, single strings and repeats, as strings only; and single strings as lists."""
    n, t = F.col("event_id") % 4, F.col("event_type")
    text = F.when(n == 0, F.concat(F.lit('["'), t, F.lit('", 5, null, " x "]'))).when(n == 1, F.col("props")).when(n == 2, F.concat(F.lit('"'), t, F.lit('"'))).otherwise(F.concat(F.lit('["a", "'), t, F.lit('", "a"]')))
    held = table(spark, d, "events").select("event_id", parsed(text).alias("v"))
    return held.select("event_id", listed_as(strings_of("v")).alias("strings"), F.nullif(F.size(listed("v")), F.lit(-1)).alias("n_listed"))


@query("""SELECT p_partkey, array_to_string(list_filter(list_transform(string_split(p_name || ' | ' || p_brand || '||' || p_type, '|'), lambda x: trim(x)), lambda x: x <> ''), ';') AS parts FROM part""")
def pipe_split(spark: SparkSession, d: str) -> DataFrame:
    packed = F.concat(F.col("p_name"), F.lit(" | "), F.col("p_brand"), F.lit("||"), F.col("p_type"))
    return table(spark, d, "part").select("p_partkey", F.array_join(pipe_list(packed), ";").alias("parts"))


@query("""SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text FROM documents""")
def normalize_whitespace(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", squeeze("text").alias("text"))


SLUG = "coalesce(nullif(trim(regexp_replace(regexp_replace(lower({0}), '[''’]', '', 'g'), '[^a-z0-9]+', '-', 'g'), '-'), ''), {1})"


@query(f"""SELECT p_partkey, {SLUG.format("p_name || ' (' || p_type || ')'", "'part-' || p_partkey")} AS slug, {SLUG.format("CASE WHEN p_partkey % 3 = 0 THEN '--' ELSE p_brand END", "'part-' || p_partkey")} AS other FROM part""")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    fallback = F.concat(F.lit("part-"), F.col("p_partkey"))
    named = F.concat("p_name", F.lit(" ("), "p_type", F.lit(")"))
    return table(spark, d, "part").select("p_partkey", slug(named, fallback).alias("slug"), slug(F.when(F.col("p_partkey") % 3 == 0, "--").otherwise(F.col("p_brand")), fallback).alias("other"))


@query(f"""SELECT p_partkey, base || CASE WHEN n > 1 THEN '-' || n ELSE '' END AS id FROM (SELECT p_partkey, base, row_number() OVER (PARTITION BY p_brand, base ORDER BY p_partkey) AS n FROM (SELECT *, {SLUG.format('p_name', "'x'")} AS base FROM part))""")
def unique_slug(spark: SparkSession, d: str) -> DataFrame:
    named = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("scope"), slug("p_name", F.lit("x")).alias("base"), F.col("p_partkey").alias("pos"))
    return unique_ids(named).select("p_partkey", "id")


@query("""WITH RECURSIVE b AS (SELECT p_partkey, split_part(p_name, ' ', 1) || CASE WHEN p_size % 3 = 0 THEN '-' || (p_size % 11 + 1) ELSE '' END || CASE WHEN p_partkey % 10 = 0 THEN '-2' WHEN p_partkey % 10 = 1 THEN '-03' ELSE '' END AS base FROM part),
r AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY p_partkey) AS i FROM (SELECT *, regexp_replace(base, '(-[0-9]+)+$', '') AS root FROM b)),
s AS (SELECT root, i, p_partkey, base AS id, [base] AS seen FROM r WHERE i = 1 UNION ALL
SELECT root, i, p_partkey, id, list_append(seen, id) FROM (SELECT r.root, r.i, r.p_partkey, seen, CASE WHEN NOT list_contains(seen, base) THEN base ELSE base || '-' || list_min(list_filter(range(2, len(seen) + 3), lambda k: NOT list_contains(seen, base || '-' || k))) END AS id FROM s JOIN r ON r.root = s.root AND r.i = s.i + 1))
SELECT p_partkey, id FROM s""")
def unique_suffixes(spark: SparkSession, d: str) -> DataFrame:
    """All parts in one scope; many bases look like others with a suffix, of one or two levels."""
    k, n = F.col("p_partkey"), F.col("p_size")
    base = F.concat(F.substring_index("p_name", " ", 1), F.when(n % 3 == 0, F.concat(F.lit("-"), n % 11 + 1)).otherwise(""), F.when(k % 10 == 0, "-2").when(k % 10 == 1, "-03").otherwise(""))
    return unique_ids(table(spark, d, "part").select("p_partkey", F.lit("all").alias("scope"), base.alias("base"), k.alias("pos"))).select("p_partkey", "id")


@query("""SELECT n_nationkey, 'coord-' || 'n' || (n_nationkey::varchar)[1] || '-r' || '-' || 'ls' || '-' || md5('n-' || n_nationkey || '||linked.select|r-' || n_regionkey || ':')[1:6] AS id FROM nation""")
def coordination_ids(spark: SparkSession, d: str) -> DataFrame:
    src = F.concat(F.lit("n-"), F.col("n_nationkey"))
    target = F.array(F.struct(F.concat(F.lit("r-"), F.col("n_regionkey")).alias("view_id"), F.lit(None).cast("string").alias("subview_id")))
    whole = coordination_id(src, F.lit(None).cast("string"), F.lit("linked.select"), target)
    # the source's short name with that of the kind of its targets, as a second form of the same initials
    return table(spark, d, "nation").select("n_nationkey", F.concat(F.lit("coord-"), initials(src), F.lit("-"), initials(F.lit("r")), F.lit("-"), initials(F.lit("linked.select")), F.lit("-"), F.substring_index(whole, "-", -1)).alias("id"))


@query("""WITH v AS (SELECT r_regionkey, regexp_replace(lower(r_name), '[^a-z0-9]+', '-', 'g') AS vid FROM region), s AS (SELECT n_nationkey, vid, vid || '.' || regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') AS sid FROM nation JOIN v ON n_regionkey = r_regionkey)
SELECT s_suppkey, vid AS view_id, sid AS subview_id, sid || '.' || coalesce(nullif(trim(regexp_replace(lower(s_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'x') AS capability_id FROM supplier JOIN s ON s_nationkey = n_nationkey""", name="hierarchical_ids")
def hierarchy_ids(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    own = table(spark, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    rows = own.select("s_suppkey", F.lit("all").alias("record_id"), F.col("r_name").alias("view_name"), F.col("r_regionkey").alias("view_pos"), F.col("n_name").alias("subview_name"), F.col("n_nationkey").alias("subview_pos"), F.col("s_name").alias("capability_name"), F.col("s_suppkey").alias("capability_pos"))
    return hierarchical_ids(rows).select("s_suppkey", "view_id", "subview_id", "capability_id")


@query("""SELECT p_partkey, regexp_full_match(replace(lower(p_name), ' ', CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE ' ' END), '[a-z0-9]+([._:-][a-z0-9]+)*') AS ok FROM part""")
def identifier_check(spark: SparkSession, d: str) -> DataFrame:
    value = F.when(F.col("p_partkey") % 2 == 0, F.translate(F.lower("p_name"), " ", "-")).otherwise(F.lower("p_name"))
    return table(spark, d, "part").select("p_partkey", is_identifier(value).alias("ok"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment IN ('BUILDING','MACHINERY') WHEN c_custkey % 3 = 1 THEN true ELSE false END AS ok FROM customer""")
def taxonomy_check(spark: SparkSession, d: str) -> DataFrame:
    """Values of a vocabulary, values that others(...) names, and an empty others()."""
    k, m = F.col("c_custkey") % 3, F.col("c_mktsegment")
    value = F.when(k == 0, m).when(k == 1, F.concat(F.lit("others("), m, F.lit(")"))).otherwise(F.lit("others()"))
    return table(spark, d, "customer").select("c_custkey", is_open_value(value, ["BUILDING", "MACHINERY"]).alias("ok"))


@query("""SELECT p_partkey, regexp_replace(p_name || '/' || p_brand, '[^\\p{L}\\p{N}_-]', '_', 'g') AS name FROM part""")
def safe_file_name(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", safe_name(F.concat_ws("/", "p_name", "p_brand")).alias("name"))


@query("""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'view-' || page_id ELSE 'v' || page_id END AS id FROM pages""")
def view_id_normalize(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("page_id")
    return table(spark, d, "pages").select("page_id", view_id(F.when(k % 2 == 0, F.concat(F.lit(" "), k)).otherwise(F.concat(F.lit("v"), k, F.lit("\t")))).alias("id"))


# ---------------------------------------------------------------- blocks of pages and documents

# pieces between tags; a piece belongs to the last tag of a block before it
BLOCK = """piece AS (SELECT page_id, unnest(string_split(b, '<')) AS x, generate_subscripts(string_split(b, '<'), 1) AS i
  FROM (SELECT page_id, regexp_replace(html, '(?is)<(script|style|nav|footer|header|head)[ >].*?</(script|style|nav|footer|header|head)>|<!--.*?-->', ' ', 'g') AS b FROM pages)),
tagged AS (SELECT page_id, i, CASE WHEN i > 1 THEN lower(regexp_extract(x, '^/?[a-zA-Z0-9]+')) ELSE '' END AS t, CASE WHEN i > 1 THEN x[position('>' IN x) + 1:] ELSE x END AS s FROM piece),
parted AS (SELECT *, sum((ltrim(t, '/') IN ('h1','h2','h3','h4','h5','h6','p','li','ul','ol','div','article','section','main','body','html','table','tr','td','th','blockquote','pre','hr'))::int) OVER (PARTITION BY page_id ORDER BY i) AS pos FROM tagged),
block AS (SELECT page_id, pos, CASE WHEN arg_min(t, i)[1] = 'h' THEN 'title' ELSE 'paragraph' END AS type,
  trim(regexp_replace(string_agg(CASE WHEN t = 'br' THEN ' ' || s ELSE s END, '' ORDER BY i), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text
  FROM parted GROUP BY page_id, pos HAVING arg_min(t, i) IN ('h1','h2','h3','h4','h5','h6','p','li'))"""


@query(f"WITH {BLOCK} SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS order_index, type, text FROM block WHERE text <> ''")
def page_blocks(spark: SparkSession, d: str) -> DataFrame:
    return numbered(html_blocks(table(spark, d, "pages"), "page_id", "html"), "page_id").select("page_id", "order_index", "type", "text")


@query(f"WITH {BLOCK}, f AS (SELECT page_id, type, text, min(pos) AS pos FROM block WHERE text <> '' GROUP BY 1, 2, 3) SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS order_index, type, text FROM f")
def page_block_dedupe(spark: SparkSession, d: str) -> DataFrame:
    own = deduplicated(html_blocks(table(spark, d, "pages"), "page_id", "html"), "page_id", canonical=squeeze("text"))
    return numbered(own, "page_id").select("page_id", "order_index", "type", "text")


TEI_ROWS = """part AS (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS k, type, text FROM block WHERE text <> ''),
said AS (SELECT page_id, -1.0 AS o, 'paragraph' AS type, CASE WHEN page_id % 3 = 0 THEN 'Front ' ELSE 'About ' END || page_id AS text FROM (SELECT DISTINCT page_id FROM part) WHERE page_id % 3 = 0 OR page_id % 2 = 0
UNION ALL SELECT page_id, k, CASE WHEN type = 'paragraph' AND k % 3 = 0 THEN 'caption' ELSE type END, text || CASE WHEN type = 'paragraph' THEN ['  inner', '', ' & more'][k % 3 + 1] ELSE '' END FROM part)"""


@query(f"""WITH {BLOCK}, {TEI_ROWS}, f AS (SELECT page_id, type, regexp_replace(text, ' +', ' ', 'g') AS text, min(o) AS o FROM said GROUP BY 1, 2, 3)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1 AS order_index, type, text FROM f""")
def tei_passages(spark: SparkSession, d: str) -> DataFrame:
    """Pages as TEI: heads, paragraphs with references and CDATA, figures inside figures with descriptions, back matter, and abstracts
    in the text or in the header; the blocks once each, numbered."""
    own = numbered(html_blocks(table(spark, d, "pages"), "page_id", "html"), "page_id")
    text = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    k, of = F.col("order_index") % 3, lambda *parts: F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))
    caption = of('<figure n="a>b"><head>no</head><figDesc>', text, "</figDesc><figure><figDesc>inner</figDesc></figure></figure>")
    part = F.when(F.col("type") == "title", of("<head>", text, "</head>")).when(k == 0, caption).when(k == 1, of("<p>", text, "</p>")).otherwise(of("<div><p><ref>", text, "</ref><![CDATA[ & more]]></p></div>"))
    pages = own.withColumn("part", part).groupBy("page_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order_index", "part"))), lambda x: x["part"]), "\n").alias("body"))
    n = F.col("page_id")
    header = F.when(n % 2 == 0, of("<abstract><p>About ", n.cast("string"), "</p></abstract>")).otherwise("")
    front = F.when(n % 3 == 0, of('<front><div type="abstract"><p>Front ', n.cast("string"), "</p></div></front>")).otherwise("")
    xml = of('<?xml version="1.0"?>\n<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader>', header, "</teiHeader><!-- <p>no</p> --><text>", front, "<body>", F.col("body"), "</body><back><p>gone</p></back></text></TEI>")
    made = deduplicated(tei_blocks(pages.select("page_id", xml.alias("xml")), "page_id", "xml"), "page_id", canonical=squeeze("text"))
    return numbered(made, "page_id").select("page_id", "order_index", "type", "text")


def abstract_sql(made: str) -> str:
    """The whole rule: where an abstract begins, which of the end patterns cuts it off, and how it is tidied."""
    ends = " ".join(f"WHEN regexp_matches(body, '(?im)^\\s*{p}\\b') THEN regexp_extract(body, '(?ims)\\A(.*?)^\\s*{p}\\b', 1)" for p in ABSTRACT_ENDS)
    blank = "E' \\n\\t\\r\\x0B\\f'"
    return f"""WITH made AS ({made}),
tidy AS (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {blank}) AS t FROM made),
rest AS (SELECT doc_id, regexp_replace(nullif(regexp_extract(t, '(?is)(?:^|\\n)([^\\n]*\\babstract\\b.*)$', 1), ''), '(?i)^\\s*(abstract|摘要)\\s*[:：\\-—]*\\s*', '') AS body FROM tidy),
cut AS (SELECT doc_id, trim(regexp_replace(trim(CASE {ends} ELSE body END, {blank}), '\\s*\\n\\s*', ' ', 'g'), {blank}) AS x FROM rest)
SELECT doc_id, CASE WHEN length(x) >= 20 THEN x END AS abstract FROM cut"""


MADE = """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE 'Some title' || chr(10) || 'Abstract: ' || text END || CASE doc_id % 7 WHEN 1 THEN chr(10) || 'Introduction follows' WHEN 2 THEN chr(10) || ' KEY  words: a' WHEN 3 THEN chr(10) || '1 . First' || chr(10) || 'Index' WHEN 4 THEN chr(10) || 'i) First' || chr(10) || 'Background' WHEN 5 THEN chr(10) || 'Related' || chr(10) || 'work' WHEN 6 THEN chr(10) || 'Section 1 x' ELSE '' END AS text FROM documents"""


@query(name="abstract_finder", sql=abstract_sql(MADE))
def abstracts(spark: SparkSession, d: str) -> DataFrame:
    """Documents as abstracts behind a title, or as they are, with one of six headings that end an abstract, or none, behind them."""
    k, text, line = F.col("doc_id"), F.col("text"), "\n"
    ends = {1: "Introduction follows", 2: " KEY  words: a", 3: f"1 . First{line}Index", 4: f"i) First{line}Background", 5: f"Related{line}work", 6: "Section 1 x"}
    end = F.lit("")
    for n, heading in ends.items():
        end = F.when(k % 7 == n, line + heading).otherwise(end)
    made = F.concat(F.when(k % 3 == 0, text).otherwise(F.concat(F.lit("Some title\nAbstract: "), text)), end)
    return table(spark, d, "documents").select("doc_id", abstract(made).alias("abstract"))


@query(abstract_sql("SELECT doc_id, text FROM documents"))
def document_abstracts(spark: SparkSession, d: str) -> DataFrame:
    """The abstract in each document's own text; null without one."""
    return table(spark, d, "documents").select("doc_id", abstract("text").alias("abstract"))


@query()
def abstract_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Each page's blocks behind its abstract, if no block is similar to it; its abstract is its first paragraph with one word changed."""
    blocks = numbered(html_blocks(table(spark, d, "pages"), "page_id", "html"), "page_id")
    own = blocks.where("type = 'paragraph'").groupBy("page_id").agg(F.min_by("text", "order_index").alias("t"))
    texts = own.select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat("t", F.lit(" end"))).otherwise(F.reverse("t")).alias("abstract"))
    return abstract_prefixed(blocks, texts, "page_id")


@query()
def similar_passages(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents, and items that were copied with another first word (negative ids), that are much like benchmark items:
    every pair that reaches the threshold."""
    items = table(spark, d, "benchmark").select("item_id", F.regexp_replace("text", "\n", " ").alias("text"))
    copied = items.select((-1 - F.col("item_id")).alias("doc_id"), F.regexp_replace("text", r"^\S+", "Another").alias("text"))
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("text")).union(copied)
    pairs = similar_pairs(lines.withColumnRenamed("text", "a"), items.withColumnRenamed("text", "b"), "a", "b")
    return pairs.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity")).distinct()


@query()
def canonical_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", compare_form(nfkc("text")).alias("text"))


# ---------------------------------------------------------------- JSON in text


@query("""SELECT page_id, nullif(regexp_extract(html, '\\{[^{}]*\\}', 0), '') AS object FROM pages""")
def first_json_object(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", first_object("html").alias("object"))


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE (props->>'$.k')::bigint END AS k FROM events""")
def parse_ladder(spark: SparkSession, d: str) -> DataFrame:
    n, p = F.col("event_id") % 3, F.col("props")
    text = F.when(n == 0, p).when(n == 1, F.concat(F.lit("Answer: "), p, F.lit(" as asked {"))).otherwise(F.lit("none"))
    held = table(spark, d, "events").select("event_id", ladder(text).alias("v"))
    return held.select("event_id", F.when(is_object("v"), F.try_variant_get("v", "$.k", "long")).alias("k"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN least((event_id % 16) / 10.0::double, 1.0) END AS score, CASE WHEN event_id % 3 = 0 THEN 1.0::double END AS other FROM events""")
def score_scrape(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    number = F.concat(F.floor((k % 16) / 10).cast("string"), F.lit("."), (k % 10).cast("string"))
    number = F.when(k % 16 >= 10, F.concat(F.lit("1."), (k % 16 - 10).cast("string"))).otherwise(F.concat(F.lit("0."), (k % 16).cast("string")))
    text = F.concat(F.lit("Scores. "), F.when(k % 2 == 0, F.concat(F.lit("`Interface`： "), number)).otherwise("interface unknown"), F.when(k % 3 == 0, '; "view": 1').otherwise("; view none"))
    return table(spark, d, "events").select("event_id", labelled_score(text, "interface").alias("score"), labelled_score(text, "view").alias("other"))
