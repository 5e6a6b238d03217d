"""Small parts of records and specifications: lookups, positions, references, rules and encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.jsonx import text_parts
from ..operators import context, hierarchy, modelcall, validation
from ..operators.figures import one_interface
from .registry import query, table
from .specs import tree


@query("""SELECT DISTINCT o_custkey, first_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first_order, first_value(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS o_orderstatus FROM orders""")
def first_case(spark: SparkSession, d: str) -> DataFrame:
    """The first order of each customer that has one; a customer without one would be an error."""
    o = table(spark, d, "orders")
    found = context.first_match(o.select("o_custkey", F.col("o_orderkey").alias("first_order"), "o_orderstatus"), o.select("o_custkey").distinct(), ["o_custkey"], "first_order")
    return found.select("o_custkey", "first_order", "o_orderstatus")


@query("""WITH x AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey) AS n FROM lineitem), k AS (SELECT DISTINCT l_orderkey, l_orderkey % 5 AS n FROM lineitem)
SELECT k.l_orderkey, x.l_partkey FROM k LEFT JOIN x ON x.l_orderkey = k.l_orderkey AND x.n = k.n""")
def positional_case(spark: SparkSession, d: str) -> DataFrame:
    """The n-th part of each order, n from 0 to 4; places outside the list have none."""
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey"))).alias("x"))
    return own.select("l_orderkey", context.nth(F.transform("x", lambda x: x["l_partkey"]), F.col("l_orderkey") % 5).alias("l_partkey"))


@query("""WITH x AS (SELECT l_orderkey, CASE WHEN l_returnflag = 'R' THEN 's' || l_suppkey WHEN l_returnflag = 'A' THEN 'p' || l_partkey END AS ref, CASE WHEN l_linestatus = 'O' THEN 's' || l_suppkey END AS name FROM lineitem)
SELECT l_orderkey, coalesce(string_agg(ref, '|' ORDER BY ref), '') AS refs, coalesce(string_agg(name, '|' ORDER BY name), '') AS names FROM x GROUP BY 1""")
def normalized_refs(spark: SparkSession, d: str) -> DataFrame:
    """References to a subview, else to a view, else to nothing; and one field of a list without its empty entries."""
    s, p, f = F.concat(F.lit("s"), F.col("l_suppkey")), F.concat(F.lit("p"), F.col("l_partkey")), F.col("l_returnflag")
    ref = F.struct(F.when(f == "N", "").otherwise(p).alias("view_id"), F.when(f == "R", s).otherwise("").alias("subview_id"), F.when(F.col("l_linestatus") == "O", s).otherwise("").alias("name"))
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(ref).alias("x"))
    refs = F.filter(F.transform("x", context.view_ref), lambda r: r.isNotNull())
    return own.select("l_orderkey", F.array_join(F.array_sort(refs), "|").alias("refs"), F.array_join(F.array_sort(context.field_of(F.col("x"), "name")), "|").alias("names"))


@query("""SELECT conv_id || '-' || turn AS entity_id, 'id_or_text' AS rule, 'an event needs an id or a text' AS message FROM conversations WHERE turn % 2 = 1 AND role = 'system'
UNION ALL SELECT conv_id || '-' || turn, 'introduced_text', 'a new item needs a text' FROM conversations WHERE role = 'system'""", name="event_rules")
def events(spark: SparkSession, d: str) -> DataFrame:
    """Turns as events that introduce something: what a system says has no text, and odd turns have no id."""
    c = table(spark, d, "conversations")
    rows = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.when(F.col("turn") % 2 == 0, "q").alias("ref"), F.when(F.col("role") != "system", F.col("text")).otherwise("").alias("text"), F.lit("Introduce").alias("action"))
    return validation.violations(rows, F.col("id"), validation.event_rules())


@query("""SELECT page_id, 'data:' || CASE WHEN page_id % 3 = 0 THEN 'image/jpeg' WHEN page_id % 3 = 1 THEN 'image/webp' ELSE 'image/png' END || ';base64,' || base64(encode(html)) AS data_url FROM pages""", name="data_urls")
def data_url(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 3 == 0, ".JPG").when(F.col("page_id") % 3 == 1, ".webp").otherwise(".tiff")
    files = table(spark, d, "pages").select("page_id", F.concat(F.lit("/x/"), F.col("page_id"), kind).alias("path"), F.col("html").cast("binary").alias("content"))
    return modelcall.data_urls(files).select("page_id", F.regexp_replace("data_url", r"[\r\n]", "").alias("data_url"))


@query("""SELECT r_regionkey AS record_id, 'r-' || r_regionkey AS view_id, 'n-' || n_nationkey AS subview_id, 's-' || s_suppkey AS capability_id
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 9 <> 0""", name="capability_dimension")
def dimension(spark: SparkSession, d: str) -> DataFrame:
    """The hierarchy of each region's tree; the second view of each, a copy of the first without an id, goes before ids are looked at."""
    views = tree(spark, d).select(F.col("r_regionkey").alias("record_id"), context.system_context("views").alias("views"))
    return hierarchy.capability_dimension(views).where("capability_id is not null")


@query("""SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations WHERE role <> 'system' AND text <> '' GROUP BY 1""", name="text_parts")
def parts_of_messages(spark: SparkSession, d: str) -> DataFrame:
    """Turns as parts of one content; those of a system have no text."""
    part = F.struct("turn", F.when(F.col("role") != "system", F.col("text")).alias("text"))
    own = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("x"))
    return own.select("conv_id", text_parts("x").alias("text")).where("text <> ''")


@query("""WITH x AS (SELECT o_custkey, o_orderkey, lower(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '-', 'g')) AS base, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, base ORDER BY pos) AS k FROM x)
SELECT o_custkey AS spec_id, pos, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS case_id FROM n""")
def case_ids(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cases of a customer's specification, named by their priority."""
    from pyspark.sql.window import Window as W

    pos = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long")
    cases = table(spark, d, "orders").select(F.col("o_custkey").alias("spec_id"), pos.alias("pos"), F.lit("").alias("case_id"), F.col("o_orderpriority").alias("case_title"))
    return validation.unique_case_ids(cases).select("spec_id", "pos", "case_id")


@query("""WITH m AS (SELECT o_custkey AS doc, count_if(o_orderstatus = 'P') AS marked, min(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END) AS named FROM orders GROUP BY 1)
SELECT doc, marked FROM m WHERE marked <> CASE WHEN named IS NULL THEN 0 ELSE 1 END""")
def interface_invariant(spark: SparkSession, d: str) -> DataFrame:
    """Orders as figures of a customer's manifest, those in part as marked ones; an urgent order names an interface."""
    o = table(spark, d, "orders")
    chosen = o.groupBy(F.col("o_custkey").alias("doc")).agg(F.min(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey"))).cast("string").alias("interface_figure"))
    return one_interface(o.select(F.col("o_custkey").alias("doc"), (F.col("o_orderstatus") == "P").alias("is_interface_figure")), chosen)
