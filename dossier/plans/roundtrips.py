"""Given tables written through the sinks and read again through the scans, and the parts of tool chains that need no tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import shared_path
from ..functions.geometry import rect
from ..operators import extraction, report
from ..sources import readers
from .registry import query, table


def of(*parts: Column | str) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


#: Rows of one document; there are as many documents as a table has rows by this.
ROWS = 1000


def documents(df: DataFrame, row: str, text: Column, name: str) -> str:
    """One file for each thousand row numbers, with the text that is made of their rows, in a folder named after the thousand."""
    path = shared_path(df.sparkSession, name)
    df.groupBy(F.floor(F.col(row) / ROWS).alias("block")).agg(text.alias("value")).repartition("block").write.partitionBy("block").text(path)
    return path


def block_of(file: Column | str) -> Column:
    return F.regexp_extract(file, "block=([^/]*)", 1).cast("long")


@query("""SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS status, o_totalprice AS price, 'CREATED' AS first_write, 'SKIPPED' AS second_write FROM orders""")
def jsonl_scan(spark: SparkSession, d: str) -> DataFrame:
    """Orders written once as JSON lines, nulls included; a second writer is told that they are there; and a strict reading."""
    path = shared_path(spark, "orders")
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") != "F", F.col("o_orderstatus")).alias("status"), F.col("o_totalprice").alias("price"))
    said = [report.write_once(rows, path), report.write_once(rows.limit(0), path)]
    return readers.strict_json_lines(spark, path, rows.schema).withColumn("first_write", F.lit(said[0])).withColumn("second_write", F.lit(said[1]))


@query("""SELECT event_id, event_type, count(*) OVER (PARTITION BY event_type) AS n FROM events""")
def log_append_scan(spark: SparkSession, d: str) -> DataFrame:
    """A log appended to type by type, and read as lines."""
    path = shared_path(spark, "log")
    events = table(spark, d, "events").select("event_id", "event_type")
    for kind in ("view", "click", "signup", "error"):
        report.write_jsonl(events.where(F.col("event_type") == kind), path, mode="append")
    report.write_jsonl(events.where(~F.col("event_type").isin("view", "click", "signup", "error")), path, mode="append")
    lines = readers.json_lines(spark, path).select(F.from_json("value", events.schema).alias("x")).select("x.*")
    return lines.join(lines.groupBy("event_type").agg(F.count("*").alias("n")), "event_type").select("event_id", "event_type", "n")


@query("""SELECT p_partkey::int AS p_partkey, array_to_string(string_split(p_name, ' '), ';') AS words, len(string_split(p_name, ' ')) AS n_words, p_brand, p_size FROM part""")
def csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """Parts as a CSV with a packed list, quotes and line ends in it, and numbers."""
    path = shared_path(spark, "parts")
    report.write_csv(table(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), F.replace("p_name", F.lit(" "), F.lit(" | ")), F.lit("||")).alias("words"), "p_brand", "p_size"), path)
    own = readers.packed_csv(spark, path, ["words"], ["p_partkey", "p_size"])
    return own.select("p_partkey", F.array_join("words", ";").alias("words"), F.size("words").cast("long").alias("n_words"), "p_brand", "p_size")


@query("""SELECT c_custkey, c_custkey // 1000 AS block, c_name, 'list' AS kind FROM customer UNION ALL SELECT -1, -1 - r_regionkey, NULL, 'not a list' FROM region""")
def json_list_scan(spark: SparkSession, d: str) -> DataFrame:
    """Customers by the thousand as documents that are lists; and documents that aren't."""
    path = documents(table(spark, d, "customer"), "c_custkey", F.to_json(F.collect_list(F.struct("c_custkey", "c_name"))), "lists")
    table(spark, d, "region").select((-1 - F.col("r_regionkey")).alias("block"), F.to_json(F.struct("r_name")).alias("value")).write.mode("append").partitionBy("block").text(path)
    rows = readers.json_list(spark, f"{path}/*/*").select(block_of("file").alias("block"), "error", F.explode_outer("items").alias("v"))
    return rows.select(F.coalesce(F.try_variant_get("v", "$.c_custkey", "long"), F.lit(-1)).alias("c_custkey"), "block", F.try_variant_get("v", "$.c_name", "string").alias("c_name"), F.coalesce("error", F.lit("list")).alias("kind"))


@query("""SELECT c_custkey // 1000 AS block, c_custkey, c_acctbal AS balance FROM customer""")
def json_document_scan(spark: SparkSession, d: str) -> DataFrame:
    """Customers by the thousand as indented documents."""
    whole = F.to_json(F.struct(F.floor(F.min("c_custkey") / ROWS).alias("block"), F.collect_list(F.struct("c_custkey", F.col("c_acctbal").alias("balance"))).alias("customers")), {"pretty": "true"})
    path = documents(table(spark, d, "customer"), "c_custkey", whole, "documents")
    held = readers.json_document(spark, f"{path}/*/*", "block long, customers array<struct<c_custkey: long, balance: double>>")
    return held.select("block", F.explode("customers").alias("c")).select("block", "c.*")


@query("""SELECT s_suppkey::int AS s_suppkey, s_name, CASE WHEN s_nationkey % 2 = 0 THEN s_nationkey ELSE 0 END::int AS pages FROM supplier""")
def missing_csv_scan(spark: SparkSession, d: str) -> DataFrame:
    """A CSV whose missing numbers are 0, and one that isn't there."""
    path, schema = shared_path(spark, "suppliers"), "s_suppkey int, s_name string, pages int"
    report.write_csv(table(spark, d, "supplier").select("s_suppkey", "s_name", F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey")).alias("pages")), path)
    return readers.optional_csv(spark, path, schema, ["pages"]).union(readers.optional_csv(spark, f"{path}-missing", schema, ["pages"]))


@query("""SELECT p_partkey // 1000 AS block, p_partkey, CASE WHEN p_size % 3 = 0 THEN 'Table' ELSE 'Figure' END AS kind FROM part WHERE p_size % 3 <> 0 OR p_partkey // 1000 % 2 = 0""")
def figure_metadata_scan(spark: SparkSession, d: str) -> DataFrame:
    """Figures and tables by the thousand, as one list or, for even thousands, as two; tables are read of the latter only."""
    every = F.collect_list(F.struct(F.when(F.col("p_size") % 3 == 0, "Table").otherwise("Figure").alias("figType"), F.col("p_partkey").alias("name")))
    part = lambda name: F.filter(every, lambda x: x["figType"] == name)
    two = F.to_json(F.struct(part("Figure").alias("figures"), part("Table").alias("tables")))
    path = documents(table(spark, d, "part"), "p_partkey", F.when(F.floor(F.min("p_partkey") / ROWS) % 2 == 0, two).otherwise(F.to_json(every)), "figures")
    with_tables, figures = (readers.figure_metadata(spark, f"{path}/*/*", tables=t).withColumn("block", block_of("file")) for t in (True, False))
    both = figures.where("block % 2 <> 0").unionByName(with_tables.where("block % 2 = 0"))
    return both.select("block", F.try_variant_get("figure", "$.name", "long").alias("p_partkey"), F.try_variant_get("figure", "$.figType", "string").alias("kind"))


@query("""SELECT p.o_custkey::varchar AS paper, c.c_name AS full_name FROM (SELECT DISTINCT o_custkey FROM orders) p LEFT JOIN customer c ON c.c_custkey = p.o_custkey AND c.c_acctbal > 0""")
def index_csv(spark: SparkSession, d: str) -> DataFrame:
    """An index of customers with orders and their names, where there is one, through the two-column CSV."""
    c, path = table(spark, d, "customer"), shared_path(spark, "index")
    names = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("doc")).distinct()
    titles = c.select(F.when(F.col("c_custkey").isNotNull(), F.col("c_custkey").cast("string")).alias("paper"), F.when(F.col("c_acctbal") > 0, F.col("c_name")).alias("full_name"))
    report.write_csv(extraction.index_rows(names, titles), path)
    return readers.optional_csv(spark, path, "paper string, full_name string", [])


@query("""SELECT DISTINCT p_partkey // 1000 AS block, 'block=' || p_partkey // 1000 || '/' AS folder FROM part""")
def file_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Names of files that a sink has written, found without reading them."""
    path = documents(table(spark, d, "part"), "p_partkey", F.count("*").cast("string"), "found")
    names = readers.file_names(spark, f"{path}/*/*").union(readers.file_names(spark, f"{path}-none/*"))
    return names.select(block_of("path").alias("block"), F.regexp_extract("path", "(block=[^/]*/)[^/]*$", 1).alias("folder"))


@query("""SELECT l_orderkey, string_agg(type || ':' || content, chr(10) ORDER BY o) AS messages FROM (
SELECT l_orderkey, 0 AS o, 'text' AS type, 'Judge.' || chr(10) || chr(10) || 'Payload:' || chr(10) || '{"order":' || l_orderkey || ',"lines":' || count(*) || ',"note":null}' AS content FROM lineitem GROUP BY 1
UNION ALL SELECT l_orderkey, 2 * n + k, ['text', 'image'][k + 1], ['Line ' || l_linenumber, 'data:' || l_partkey][k + 1] FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem), (SELECT unnest([0, 1]) AS k)) GROUP BY 1""")
def model_messages(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as the images of a model call, each behind its label."""
    own = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))
    payload = F.struct(F.col("l_orderkey").alias("order"), F.size("x").alias("lines"), F.lit(None).cast("string").alias("note"))
    images = F.transform("x", lambda x: F.struct(of("Line ", x["l_linenumber"]).alias("label"), of("data:", x["l_partkey"]).alias("data_url")))
    told = F.transform(extraction.messages("Judge.", payload, images), lambda m: of(m["type"], ":", m["content"]))
    return own.select("l_orderkey", F.array_join(told, "\n").alias("messages"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE '' END AS paper_name, CASE WHEN l_linenumber % 3 = 0 THEN l_linestatus ELSE 'unknown' END AS source_type, '' AS source_id, CASE WHEN l_linenumber % 5 = 0 THEN 'r' ELSE '' END AS reason, CASE WHEN l_linenumber % 4 = 0 THEN l_quantity ELSE 0 END::double AS score FROM lineitem""")
def retrieval_defaults(spark: SparkSession, d: str) -> DataFrame:
    """What was retrieved, with a default for each field that is missing."""
    n, none = F.col("l_linenumber"), F.lit(None).cast("string")
    hit = F.struct(F.when(n % 2 == 0, F.col("l_returnflag")).alias("paper_name"), F.when(n % 3 == 0, F.col("l_linestatus")).alias("source_type"), none.alias("source_id"), F.when(n % 5 == 0, "r").alias("reason"), F.when(n % 4 == 0, F.col("l_quantity").cast("string")).alias("score"))
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.explode(extraction.retrieval_payload(F.array(hit))).alias("x"))
    return own.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "x.*")


@query("""SELECT o_orderkey, strftime(o_orderdate::timestamp, '%Y%m%dT%H%M%SZ') || '_a_model_v1_5' AS name FROM orders""")
def run_names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", extraction.run_name("a/model v1.5", F.col("o_orderdate").cast("timestamp")).alias("name"))


BLOCKS = """b AS (SELECT l_orderkey AS page, l_linenumber AS pos, l_partkey, l_suppkey, l_returnflag || CASE WHEN l_linenumber % 3 = 0 THEN ' ABSTRACT ' ELSE ' text ' END || l_partkey || '.' || l_suppkey || '.' || l_quantity::int || '.' || l_linenumber || ';' AS text, l_quantity::double AS x0, (l_suppkey % 50)::double AS y0 FROM lineitem)"""


def page_texts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("l_linenumber")
    text = of(F.col("l_returnflag"), F.when(n % 3 == 0, " ABSTRACT ").otherwise(" text "), F.col("l_partkey"), ".", F.col("l_suppkey"), ".", F.col("l_quantity").cast("int"), ".", n, ";")
    x, y = F.col("l_quantity").cast("double"), (F.col("l_suppkey") % 50).cast("double")
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page"), n.alias("pos"), "l_partkey", "l_suppkey", text.alias("text"), rect(x, y, x + 10, y + 5).alias("box"))


@query(f"""WITH {BLOCKS} SELECT page, min(pos) AS pos FROM b WHERE contains(lower(text), 'abstract') GROUP BY 1""")
def first_block(spark: SparkSession, d: str) -> DataFrame:
    """The first block of a page with a word; a block is told by its place."""
    own = page_texts(spark, d).withColumn("box", F.col("pos"))
    return extraction.first_block_with(own, ["abstract", "summary of nothing"]).select("page", F.col("box").alias("pos"))


@query(f"""WITH {BLOCKS}, a AS (SELECT l_orderkey AS page, min(l_quantity)::double AS x, min(l_suppkey % 50)::double AS y FROM lineitem GROUP BY 1),
m AS (SELECT page, text, round_even(y0, 1) AS ry, x0, least(x + 50, x0 + 10) > greatest(x - 40, x0) AND least(y + 33, y0 + 5) > greatest(y - 28, y0) AS t, y0 >= y - 8 AND y0 <= y + 53 AS b, y0 FROM b JOIN a USING (page)),
f AS (SELECT page, bool_or(t) AS hit FROM m GROUP BY 1)
SELECT page, string_agg(text, ' ' ORDER BY ry, x0, text) AS caption FROM (SELECT DISTINCT page, text, ry, x0 FROM m JOIN f USING (page) WHERE t) GROUP BY page""")
def captions_near_labels(spark: SparkSession, d: str) -> DataFrame:
    """Blocks that touch the grown box of a page's label, which stands in the corner of all blocks."""
    own = page_texts(spark, d)
    x, y = F.min("box.x0"), F.min("box.y0")
    anchors = own.groupBy("page").agg(F.lit(1).alias("number"), rect(x, y, x + 10, y + 5).alias("anchor"))
    return extraction.captions_at(own.select("page", "text", "box"), anchors)
