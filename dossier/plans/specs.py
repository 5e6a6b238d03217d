"""Specifications, contexts and reports: integrity checks, trees, prefixes, payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.frames import computed, dealt
from ..functions.text import paired
from ..operators import context, records, report, rules, validation
from .registry import query, table

#: The record format's version and its task.
VERSION, TASK = "v1", "next_move"


@query("""SELECT l_orderkey::varchar AS entity_id, 'contiguous' AS rule, min(l_linenumber) || '..' || max(l_linenumber) AS message FROM lineitem GROUP BY l_orderkey HAVING min(l_linenumber) <> 1 OR max(l_linenumber) <> count(*) OR count(DISTINCT l_linenumber) <> count(*)""")
def sequence_contiguity(spark: SparkSession, d: str) -> DataFrame:
    return validation.contiguous_from_one(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey::varchar AS entity_id, 'customer' AS rule, o_custkey::varchar AS message FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)
UNION ALL SELECT l_orderkey::varchar, 'part_supplier', l_partkey || '/' || l_suppkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part, supplier WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND (p_size > 25) = (s_acctbal >= 0))
UNION ALL SELECT DISTINCT o_orderkey::varchar, 'no_children', '' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
def fk_violations(spark: SparkSession, d: str) -> DataFrame:
    orders, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    customers = table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("o_custkey"))
    a = validation.unknown_refs(orders.select(F.col("o_orderkey").alias("entity_id"), "o_custkey"), customers, ["o_custkey"], "customer")
    # pairs that exist: both keys do, and large parts have suppliers without debts, small ones those with debts
    refs = li.select(F.col("l_orderkey").alias("entity_id"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"))
    known = refs.select("p", "s").distinct().join(table(spark, d, "part").select(F.col("p_partkey").alias("p"), (F.col("p_size") > 25).alias("large")), "p").join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("s"), (F.col("s_acctbal") >= 0).alias("free")), "s")
    b = validation.unknown_refs(refs, known.where("large = free"), ["p", "s"], "part_supplier")
    c = validation.childless(orders.select(F.col("o_orderkey").alias("o")), li.select(F.col("l_orderkey").alias("o")), "o")
    return a.unionByName(b).unionByName(c)


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN source WHEN doc_id % 4 = 1 THEN source || '|x' END AS figure_refs, doc_id % 4 <> 3 AS has_evidence FROM documents""")
def evidence_rule(spark: SparkSession, d: str) -> DataFrame:
    k, s = F.col("doc_id") % 4, F.col("source")
    refs = F.when(k == 0, F.array(s, F.upper("source"), F.lit(" "))).when(k == 1, F.array(s, F.lit("x"), F.lit("X "))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "documents").select("doc_id", refs.alias("figure_refs"), F.lit(None).cast("array<string>").alias("quotes"), F.when(k == 2, F.array(F.col("doc_id"))).alias("passage_ids"))
    return validation.normalized_evidence(rows).select("doc_id", F.array_join("figure_refs", "|").alias("figure_refs"), "has_evidence")


@query("""WITH x AS (SELECT d.doc_id, l.quality, l.toxic, d.lang FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id::varchar AS entity_id, 'narrative_or_evidence' AS rule, 'a step needs a narrative or evidence' AS message FROM x WHERE quality IS NULL AND lang <> 'en'
UNION ALL SELECT doc_id::varchar, 'semantic_field', 'a step needs a semantic field' FROM x WHERE coalesce(quality, 0) = 0 AND coalesce(toxic, 0) = 0""")
def semantic_payload(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    none = F.lit(None).cast("string")
    rows = x.select(
        "doc_id", F.when(F.col("quality").isNotNull(), "told").alias("narrative"), F.when(F.col("lang") == "en", "seen").alias("evidence"), F.when(F.col("quality") == 1, "read").otherwise("").alias("intent_text"),
        F.when(F.col("toxic") == 1, F.array(F.lit("warn"))).otherwise(F.array().cast("array<string>")).alias("observations"), none.alias("outcome_summary"),
    )
    return validation.violations(rows, F.col("doc_id"), validation.step_rules(rows))


@query("""SELECT p_partkey, p_partkey % 5 = 0 OR upper(p_name)[1] = p_type[1] AS ok FROM part""")
def category_prefix(spark: SparkSession, d: str) -> DataFrame:
    inner = F.when(F.col("p_partkey") % 5 == 0, "others(new)").otherwise(F.upper("p_name"))
    return table(spark, d, "part").select("p_partkey", validation.category_pair_ok(F.col("p_type"), inner).alias("ok"))


@query("""SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_partkey % 3 = 0 ELSE p_partkey % 3 = 1 END AS ok FROM part""")
def xor_rule(spark: SparkSession, d: str) -> DataFrame:
    kind, k = F.when(F.col("p_size") % 2 == 0, "visualization").otherwise("control"), F.col("p_partkey") % 3
    return table(spark, d, "part").select("p_partkey", validation.either_style(kind, F.when(k.isin(0, 2), F.col("p_type")), F.when(k.isin(1, 2), F.col("p_name"))).alias("ok"))


@query("""WITH e AS (SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'question' ELSE 'hypothesis' END AS kind, 'case-' || conv_id || '.t-' || (turn // 2) AS ref, role <> 'system' AS told, turn % 5 = 4 AS odd FROM conversations),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, kind, ref ORDER BY turn) AS n FROM e WHERE told AND NOT (kind = 'hypothesis' AND odd))
SELECT 'case-' || e.conv_id AS case_id, e.turn AS pos, e.kind, e.ref AS item_id, CASE WHEN f.n = 1 THEN 'created' WHEN f.n > 1 THEN 'known' ELSE 'violation' END AS outcome,
CASE WHEN f.n = 1 THEN CASE WHEN e.kind = 'question' THEN 'Open' ELSE 'Proposed' END END AS status, CASE WHEN f.n = 1 THEN 'StrongInference' END AS inference_type
FROM e LEFT JOIN f ON f.conv_id = e.conv_id AND f.turn = e.turn""")
def event_registration(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as events: even ones are questions, odd ones hypotheses; what a system says has no text, and every
    fifth turn is related to a question that nobody asked."""
    c, turn = table(spark, d, "conversations"), F.col("turn")
    case = F.concat(F.lit("case-"), F.col("conv_id"))
    none = F.array().cast("array<string>")
    events = c.select(
        case.alias("case_id"), turn.alias("pos"), F.when(turn % 2 == 0, "question").otherwise("hypothesis").alias("kind"), F.concat(case, F.lit(".t-"), F.floor(turn / 2)).alias("ref"),
        F.when(F.col("role") != "system", F.col("text")).alias("text"), F.when(turn % 5 == 4, F.array(F.lit("nobody"))).otherwise(none).alias("related"), none.alias("known_questions"), none.alias("known_hypotheses"),
    )
    return validation.registered_events(events).select("case_id", "pos", "kind", "item_id", "outcome", "status", "inference_type")


@query("""WITH stage AS (SELECT o_custkey AS w, o_orderkey AS s, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos, CASE WHEN o_orderstatus = 'P' THEN 1 END AS idx FROM orders),
edge AS (SELECT o_custkey AS w, o_orderkey AS a, o_orderkey + 1 AS b FROM orders)
SELECT c_custkey::varchar AS entity_id, 'no_children' AS rule, '' AS message FROM customer WHERE c_custkey NOT IN (SELECT w FROM stage)
UNION ALL SELECT w || '/' || s, 'stage_index', idx || ' is not ' || pos FROM stage WHERE idx <> pos
UNION ALL SELECT w::varchar, 'target_stage', w || '/' || b FROM edge WHERE NOT EXISTS (SELECT 1 FROM stage WHERE stage.w = edge.w AND stage.s = edge.b)""")
def workflow_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Customers are workflows, their orders the stages in order; a stage leads to the next key, which another customer may have."""
    o = table(spark, d, "orders")
    pos = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    stages = o.select(F.col("o_custkey").alias("workflow_id"), F.col("o_orderkey").alias("stage_id"), pos.alias("pos"), F.when(F.col("o_orderstatus") == "P", 1).alias("stage_index"))
    edges = o.select(F.col("o_custkey").alias("workflow_id"), F.col("o_orderkey").alias("source_stage_id"), (F.col("o_orderkey") + 1).alias("target_stage_id"))
    return validation.workflow_violations(table(spark, d, "customer").select(F.col("c_custkey").alias("workflow_id")), stages, edges)


@query("""WITH li AS (SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS s, s_nationkey AS sub, n_regionkey AS v, l_returnflag = 'R' AS wrong FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
SELECT k || '-' || n AS entity_id, 'source_capability_parent' AS rule, v || '/' || sub || '/' || s AS message FROM li WHERE wrong AND sub <> 0
UNION ALL SELECT k || '-' || n, 'source_capability', v || '/' || sub || '/' || s FROM li WHERE s % 5 = 0
UNION ALL SELECT k || '-' || n, 'target_capability_parent', v || '/' || sub || '/' || s FROM li WHERE v <> 1
UNION ALL SELECT k || '-' || n, 'target_capability', v || '/' || sub || '/' || s FROM li WHERE s % 5 = 0""")
def coordination_integrity(spark: SparkSession, d: str) -> DataFrame:
    """Lines as coordinations from a supplier's nation (returned ones: from nation 0) to the whole view of region 1."""
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    text = lambda c: F.col(c).cast("string")
    place = lambda v, s: F.struct(v.alias("view_id"), s.alias("subview_id"))
    own = F.struct(text("n_regionkey").alias("view_id"), text("s_nationkey").alias("subview_id"), text("l_suppkey").alias("capability_id"))
    source = F.when(F.col("l_returnflag") == "R", place(F.lit("0"), F.lit("0"))).otherwise(place(text("n_regionkey"), text("s_nationkey")))
    target = place(F.lit("1"), text("s_nationkey"))
    rows = li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), source.alias("source"), own.alias("source_capability"), F.array(target).alias("targets"), F.array(own).alias("target_capabilities"),
        F.array(place(text("n_regionkey"), text("s_nationkey")), place(F.lit("0"), F.lit("0")), target).alias("known_views"), F.when(F.col("l_suppkey") % 5 != 0, F.array(own)).alias("known_capabilities"),
    )
    return validation.violations(rows, F.col("id"), validation.coordination_rules())


@query("""WITH li AS (SELECT DISTINCT l_orderkey AS k, l_linenumber AS n FROM lineitem), q AS (SELECT l_orderkey AS k, l_suppkey AS s FROM lineitem WHERE l_linestatus = 'O')
SELECT l.l_orderkey || '.' || l.l_linenumber AS entity_id, 'unknown question' AS rule, 'questions_addressed: ' || l.l_suppkey AS message FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.k = l.l_orderkey AND q.s = l.l_suppkey)
UNION ALL SELECT l.l_orderkey || '.' || l.l_linenumber, 'unknown hypothesis', 'state_after.active_hypotheses: ' || l.l_partkey FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM lineitem r WHERE r.l_orderkey = l.l_orderkey AND r.l_partkey = l.l_partkey AND r.l_returnflag = 'R')
UNION ALL SELECT l.l_orderkey::varchar, 'unknown step of episode', 'target_step: ' || l.l_orderkey || '.' || (l.l_linenumber + 1) FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM li WHERE li.k = l.l_orderkey AND li.n = l.l_linenumber + 1)""")
def case_references(spark: SparkSession, d: str) -> DataFrame:
    """Orders as cases of one episode, lines as steps: questions are suppliers of open lines, hypotheses parts of returned ones; each
    step leads to the next line number."""
    li, text = table(spark, d, "lineitem"), lambda c: F.col(c).cast("string")
    own = li.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_linestatus", "l_returnflag")).alias("x"))
    step_id = lambda n: F.concat_ws(".", text("l_orderkey"), n.cast("string"))
    of = lambda x, c: x[c].cast("string")
    step = lambda x: F.struct(step_id(x["l_linenumber"]).alias("step_id"), F.array(of(x, "l_suppkey")).alias("questions_addressed"), F.struct(F.array(of(x, "l_partkey")).alias("active_hypothesis_ids")).alias("state_after"))
    move = lambda x: F.struct(step_id(x["l_linenumber"]).alias("source_step_id"), step_id(x["l_linenumber"] + 1).alias("target_step_id"))
    open_, returned = F.filter("x", lambda x: x["l_linestatus"] == "O"), F.filter("x", lambda x: x["l_returnflag"] == "R")
    own = own.withColumns({
        "questions": F.array_distinct(F.transform(open_, lambda x: F.struct(of(x, "l_suppkey").alias("question_id")))),
        "hypotheses": F.array_distinct(F.transform(returned, lambda x: F.struct(of(x, "l_partkey").alias("hypothesis_id"), F.array().cast("array<string>").alias("related_question_ids")))),
        "steps": F.transform("x", step), "transitions": F.transform("x", move),
    })
    episode = F.struct(text("l_orderkey").alias("episode_id"), "steps", "transitions")
    return validation.unknown_case_references(own.select(text("l_orderkey").alias("case_id"), "questions", "hypotheses", F.array(episode).alias("episodes")))


def tree(spark: SparkSession, d: str) -> DataFrame:
    """(r_regionkey, views) as raw nested specifications: some parts lack an id or a name."""
    s = table(spark, d, "supplier").groupBy("s_nationkey").agg(
        F.array_sort(F.collect_list(F.struct(F.when(F.col("s_suppkey") % 9 != 0, F.concat(F.lit("s-"), F.col("s_suppkey"))).alias("capability_id"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).otherwise("").alias("capability_name"), F.lit("").alias("description")))).alias("capabilities")
    )
    n = table(spark, d, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy("n_regionkey").agg(
        F.array_sort(F.collect_list(F.struct(F.concat(F.lit("n-"), F.col("n_nationkey")).alias("subview_id"), F.lit(None).cast("string").alias("subview_name"), F.col("n_name").alias("description"), F.col("capabilities")))).alias("subviews")
    )
    r = table(spark, d, "region").join(n, F.col("r_regionkey") == F.col("n_regionkey"), "left")
    view = F.struct(F.concat(F.lit("r-"), F.col("r_regionkey")).alias("view_id"), F.col("r_name").alias("view_name"), F.lit(None).cast("string").alias("description"), F.col("subviews"))
    return r.select("r_regionkey", F.array(view, F.struct(F.lit("").alias("view_id"), F.col("r_name").alias("view_name"), F.lit("x").alias("description"), F.col("subviews"))).alias("views"))


@query("""SELECT l_orderkey AS k, 'c-' || l_partkey || '-' || l_linenumber AS coordination_id, CASE WHEN l_linenumber % 4 <> 0 THEN l_returnflag END AS coordination_type, CASE WHEN l_linenumber % 3 = 0 THEN 'because ' || l_linenumber END AS description,
CASE WHEN l_linenumber % 2 = 0 THEN 'v.s-' || l_suppkey WHEN l_linenumber % 5 <> 0 THEN 'v' END AS source_id, CASE WHEN l_suppkey % 2 = 0 THEN 'v.s-' || l_suppkey || '|v' ELSE 'v' END AS target_ids FROM lineitem WHERE l_partkey % 6 <> 0""")
def system_coordinations(spark: SparkSession, d: str) -> DataFrame:
    """Lines as coordinations of their order: some without an id, a type, a reason or a source, targets repeated and empty."""
    n, s = F.col("l_linenumber"), F.col("l_suppkey")
    ref = lambda view, sub: F.struct(view.alias("view_id"), sub.alias("subview_id"))
    none, sub, view = F.lit(None).cast("string"), F.concat(F.lit("v.s-"), s), F.lit("v")
    targets = F.array(ref(view, F.when(s % 2 == 0, sub).otherwise("")), ref(view, none), ref(F.lit(""), none), ref(view, F.lit("")))
    one = F.struct(
        F.when(F.col("l_partkey") % 6 != 0, F.concat(F.lit("c-"), F.col("l_partkey"), F.lit("-"), n)).otherwise("").alias("coordination_id"), F.when(n % 4 != 0, F.col("l_returnflag")).otherwise("").alias("coordination_type"),
        F.struct(F.when(n % 3 == 0, F.concat(F.lit("because "), n)).alias("reasoning")).alias("evidence"), ref(F.when((n % 2 == 0) | (n % 5 != 0), view), F.when(n % 2 == 0, sub)).alias("source"), targets.alias("targets"),
    )
    own = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.collect_list(one).alias("x"))
    rows = own.select("k", F.explode(context.coordinations("x")).alias("c"))
    return rows.select("k", "c.coordination_id", "c.coordination_type", "c.description", "c.source_id", F.array_join("c.target_ids", "|").alias("target_ids"))


@query("""SELECT 'w-' || s_nationkey AS workflow_id, 's-' || s_suppkey AS stage_id, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'k-' || s_suppkey || '|x' END AS used_capabilities, CASE WHEN s_suppkey % 2 = 0 THEN 'c-' || s_suppkey ELSE '' END AS used_coordinations FROM supplier""")
def stage_uses(spark: SparkSession, d: str) -> DataFrame:
    """Capabilities and coordinations that stages use, from references of which some have no id and some are repeated."""
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    ref = lambda name, *ids: F.array(*(F.struct(i.alias(name)) for i in ids))
    own = F.concat(F.lit("k-"), k)
    caps = F.when(k % 3 == 0, ref("capability_id", F.lit(""))).otherwise(ref("capability_id", own, F.lit("x"), own))
    stages = s.select(F.concat(F.lit("w-"), F.col("s_nationkey")).alias("workflow_id"), F.concat(F.lit("s-"), k).alias("stage_id"), F.lit("t").alias("stage_title"), caps.alias("used_capabilities"), F.when(k % 2 == 0, ref("coordination_id", F.concat(F.lit("c-"), k), F.lit(""))).alias("used_coordinations"))
    kept, _ = context.workflow_context(stages, stages.select(F.col("stage_id").alias("source_stage_id"), F.col("stage_id").alias("target_stage_id")))
    return kept.select("workflow_id", "stage_id", *(F.array_join(c, "|").alias(c) for c in ("used_capabilities", "used_coordinations")))


@query("""SELECT 'r-' || r_regionkey AS view_id, r_name AS view_name, 'n-' || n_nationkey AS subview_id, 'n-' || n_nationkey AS subview_name, 's-' || s_suppkey AS capability_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 's-' || s_suppkey END AS capability_name, NULL::varchar AS description
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 9 <> 0""", name="system_context")
def systems(spark: SparkSession, d: str) -> DataFrame:
    own = tree(spark, d).select(F.explode(context.system_context("views")).alias("v")).select("v.*").select("view_id", "view_name", F.explode("subviews").alias("s"))
    caps = own.select("view_id", "view_name", "s.subview_id", "s.subview_name", F.explode("s.capabilities").alias("c"))
    return caps.select("view_id", "view_name", "subview_id", "subview_name", "c.capability_id", "c.capability_name", "c.description")


@query("""SELECT 'w-' || s_nationkey AS workflow_id, 's-' || s_suppkey AS stage_id, CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE 's-' || s_suppkey END AS stage_title, CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE 'n' || s_nationkey || '|x' END AS used_views FROM supplier WHERE s_suppkey % 7 <> 0 AND s_nationkey % 5 <> 0
UNION ALL SELECT NULL, 's-' || s_suppkey, 's-' || (s_suppkey + 1), 'transition' FROM supplier WHERE s_suppkey % 7 <> 0""", name="workflow_context")
def workflows(spark: SparkSession, d: str) -> DataFrame:
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    stage_id = F.when(k % 7 != 0, F.concat(F.lit("s-"), k))
    used = F.when(k % 3 == 0, F.array(F.lit(" "))).otherwise(F.array(F.concat(F.lit("n"), F.col("s_nationkey")), F.lit("x"), F.lit(" x")))
    stages = s.select(F.when(F.col("s_nationkey") % 5 != 0, F.concat(F.lit("w-"), F.col("s_nationkey"))).alias("workflow_id"), stage_id.alias("stage_id"), F.when(k % 2 == 0, F.col("s_name")).otherwise("").alias("stage_title"), used.alias("used_views"))
    moves = s.select(stage_id.alias("source_stage_id"), F.concat(F.lit("s-"), k + 1).alias("target_stage_id"))
    kept, edges = context.workflow_context(stages, moves)
    a = kept.select("workflow_id", "stage_id", "stage_title", F.array_join("used_views", "|").alias("used_views"))
    return a.union(edges.select(F.lit(None).cast("string"), "source_stage_id", "target_stage_id", F.lit("transition")))


@query("""WITH e AS (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS view_id, max(l_partkey) AS step FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey AS sample_id, place::int AS place, l_linenumber AS episode, view_id, step FROM (SELECT *, row_number() OVER w - 1 AS place, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) AS back FROM e WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)) WHERE back > 1""")
def case_prefix_context(spark: SparkSession, d: str) -> DataFrame:
    """An order is a case and a sample, its line numbers the episodes; the prefix is all of them but the last."""
    li = table(spark, d, "lineitem")
    step = F.struct(F.lit(None).cast("int").alias("step_index"), F.col("l_partkey").alias("part"))
    episodes = li.groupBy(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("episode")).agg(F.max("l_suppkey").alias("view_id"), F.sort_array(F.collect_list(step)).alias("steps"))
    lines = F.sort_array(F.collect_set("l_linenumber"))
    samples = li.groupBy(F.col("l_orderkey").alias("case_id")).agg(lines.alias("all")).select(F.col("case_id").alias("sample_id"), "case_id", F.slice("all", 1, F.size("all") - 1).alias("prefix"))
    steps = context.steps_by_ref(episodes.select("case_id", "episode", "steps")).select("case_id", F.split("ref", r"\.")[0].cast("int").alias("episode"), F.col("step.part").alias("step"))
    got = context.prefix_episodes(samples, episodes.drop("steps")).join(steps, ["case_id", "episode"], "left")
    return got.select("sample_id", "place", "episode", "view_id", "step")


@query("""WITH e AS (SELECT l_orderkey, l_linenumber AS n, '/img/' || l_partkey || '.png' AS p FROM lineitem WHERE l_linenumber % 4 <> 0),
i AS (SELECT l_orderkey, string_agg('{"episode":' || n || ',"image_path":"attached_image_' || k || '"}', ',' ORDER BY k) AS images FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n, p) AS k FROM e) GROUP BY 1)
SELECT o.l_orderkey, 'Predict the next step.' || chr(10) || chr(10) || 'Context (JSON):' || chr(10) || '{"sample_id":' || o.l_orderkey || ',"images":[' || coalesce(images, '') || '],"note":null}' AS prompt
FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN i USING (l_orderkey)""")
def prompt_payload(spark: SparkSession, d: str) -> DataFrame:
    """Prompts of orders: their lines as episodes, images by position."""
    li = table(spark, d, "lineitem")
    item = F.struct(F.col("l_linenumber").alias("episode"), F.concat(F.lit("/img/"), F.col("l_partkey"), F.lit(".png")).alias("image_path"))
    held = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.when(F.col("l_linenumber") % 4 != 0, item))).alias("e"))
    body = F.struct(F.col("l_orderkey").alias("sample_id"), context.attached(F.col("e")).alias("images"), F.lit(None).cast("string").alias("note"))
    return held.select("l_orderkey", context.prompt(F.lit("Predict the next step."), body).alias("prompt"))


@query("""SELECT r_regionkey, string_agg('r-' || r_regionkey || '/n-' || n_nationkey, '|' ORDER BY 'n-' || n_nationkey) AS pairs FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1""")
def judge_payload_flatten(spark: SparkSession, d: str) -> DataFrame:
    own = tree(spark, d).select("r_regionkey", context.judge_payload(context.system_context("views")).alias("p"))
    return own.select("r_regionkey", F.array_join(F.transform("p", lambda x: F.concat_ws("/", x["view_id"], x["subview_id"])), "|").alias("pairs"))


@query("""SELECT p_brand AS doc, string_agg(p_name || '=' || p_type, '|' ORDER BY p_name, p_type) AS categories FROM part GROUP BY 1""")
def category_flatten(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of outer and inner categories as texts; here the outer ones are names and the inner ones types."""
    own = table(spark, d, "part").groupBy(F.col("p_brand").alias("doc")).agg(F.array_sort(F.collect_list(F.struct(F.col("p_name").alias("name"), F.array("p_type").alias("inner")))).alias("c"))
    return own.select("doc", F.array_join(F.transform(paired("c", "inner"), lambda x: F.replace(x, F.lit(" > "), F.lit("="))), "|").alias("categories"))


@query("""WITH m AS (SELECT o_custkey AS doc, o_orderkey AS f, o_orderpriority AS c FROM orders WHERE o_orderstatus = 'O'), r AS (SELECT o_custkey AS doc, o_orderkey AS f, o_orderpriority AS c FROM orders WHERE o_orderstatus <> 'O'),
ms AS (SELECT doc, string_agg(f || ':' || c, '|' ORDER BY f::varchar) AS figures FROM m GROUP BY 1), rs AS (SELECT doc, string_agg(f || ':' || c, '|' ORDER BY f::varchar) AS figures FROM r GROUP BY 1)
SELECT c_custkey AS doc, coalesce(ms.figures, rs.figures, '') AS figures, CASE WHEN ms.doc IS NOT NULL THEN 'manifest' WHEN rs.doc IS NOT NULL THEN 'raw' ELSE 'none' END AS source
FROM customer LEFT JOIN ms ON ms.doc = c_custkey LEFT JOIN rs ON rs.doc = c_custkey""")
def condensed_figures(spark: SparkSession, d: str) -> DataFrame:
    """Customers are the documents, their open orders the figures of a manifest, their other orders raw figures."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").cast("string").alias("fig_id"), F.col("o_orderpriority").alias("caption"), "o_orderstatus")
    got = report.condensed_figures(table(spark, d, "customer").select(F.col("c_custkey").alias("doc")), o.where("o_orderstatus = 'O'"), o.where("o_orderstatus <> 'O'"))
    return got.select("doc", F.array_join(F.transform("figures", lambda f: F.concat_ws(":", f["fig_id"], f["caption"])), "|").alias("figures"), "source")


@query("""SELECT d.doc_id, array_to_string(list_filter([CASE WHEN length(d.text) < 500 THEN 'passages' END, CASE WHEN l.doc_id IS NULL THEN 'figures' END, CASE WHEN p.page_id IS NULL THEN 'views' END], lambda x: x IS NOT NULL), ',') AS missing FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN pages p ON p.page_id = d.doc_id""")
def missing_parts(spark: SparkSession, d: str) -> DataFrame:
    own = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", F.lit(True).alias("l")), "doc_id", "left").join(table(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit(True).alias("p")), "doc_id", "left")
    parts = report.missing_parts({"passages": F.length("text") >= 500, "figures": F.col("l"), "views": F.col("p")})
    return own.select("doc_id", F.array_join(parts, ",").alias("missing"))


@query("""SELECT DISTINCT doc FROM (SELECT nullif(regexp_extract('/figures/' || source || '/figures.json', '/figures/([^/]+)/figures[.]json$', 1), '') AS doc FROM documents UNION ALL SELECT nullif(regexp_extract(url, '/([a-z]{2})/[0-9]+', 1), '') FROM pages) WHERE doc IS NOT NULL""")
def paper_names(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "documents").select(F.concat(F.lit("/figures/"), F.col("source"), F.lit("/figures.json")).alias("path"))
    return report.document_names([a, table(spark, d, "pages").select(F.col("url").alias("path"))], ["/figures/([^/]+)/figures[.]json$", "/([a-z]{2})/[0-9]+"])


def record_tables(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """(samples, cases, systems, workflows, usage): an order is a paper, a case and a sample, its lines are its episodes, stages and
    steps; the prefix is its first two line numbers, as far as there are so many."""
    li, key = table(spark, d, "lineitem").withColumn("key", F.col("l_orderkey").cast("string")), F.col("key")
    text = lambda x: x.cast("string")
    own = dealt(li, "key", 1 << 20).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))).alias("x"))
    episode = lambda x: F.struct(
        x["l_linenumber"].alias("benchmark_episode_index"), text(x["l_partkey"]).alias("benchmark_episode_title"), x["l_returnflag"].alias("local_goal"), F.array(text(x["l_suppkey"]), text(x["l_suppkey"])).alias("used_views"),
        F.array().cast("array<string>").alias("used_capabilities"), F.array().cast("array<string>").alias("source_step_ids"), F.array(F.concat(F.lit("1."), text(x["l_linenumber"])), F.lit("9.9")).alias("source_step_refs"),
        F.when(x["l_returnflag"] == "R", F.concat(F.lit("/i/"), text(x["l_partkey"]))).alias("composite_path"),
    )
    step = lambda x: F.struct(
        text(x["l_partkey"]).alias("step_id"), x["l_linenumber"].alias("step_index"), F.array(F.struct(text(x["l_suppkey"]).alias("view_id"), F.when(x["l_returnflag"] == "N", F.concat(text(x["l_suppkey"]), F.lit(".s"))).alias("subview_id"))).alias("used_views"),
        F.array(F.struct(F.lit("").alias("capability_id"))).alias("used_capabilities"), F.array(F.struct(x["l_returnflag"].alias("description"))).alias("observations"), F.array().cast("array<struct<description: string>>").alias("produced_insights"), F.lit("").alias("outcome_summary"),
    )
    none = F.lit(None).cast("string")
    stage = lambda x: F.struct(text(x["l_partkey"]).alias("stage_id"), x["l_linenumber"].alias("stage_index"), none.alias("stage_title"), none.alias("stage_goal"), F.array(text(x["l_suppkey"])).alias("used_views"), F.array().cast("array<string>").alias("used_capabilities"))
    samples = own.select(
        key.alias("sample_id"), key.alias("benchmark_case_id"), key.alias("paper_name"), F.lit("1").alias("case_index"), F.slice(F.array_distinct(F.transform("x", lambda x: x["l_linenumber"])), 1, 2).alias("prefix"), F.lit("3").alias("target"),
        F.lit("t").alias("target_title"), F.lit("").alias("target_image"), F.lit("g").alias("gold_next_goal"), F.array(F.lit("v")).alias("gold_next_views"), F.array(F.lit("c")).alias("gold_next_capabilities"),
    )
    workflow = F.array(F.struct(F.lit("w").alias("workflow_id"), F.lit("W").alias("workflow_title"), F.transform("x", stage).alias("stages")))
    scenario = F.struct(*(F.lit(c).alias(c) for c in ("domain_problem", "analysis_goal", "dataset_context", "initial_question")))
    usage = own.select(
        key.alias("paper_name"), F.lit(1).alias("case_index"), scenario.alias("scenario"), F.array().cast("array<struct<question_id: string, question_text: string, status: string>>").alias("questions"),
        F.array().cast("array<struct<hypothesis_id: string, hypothesis_text: string, status: string, related_question_ids: array<string>>>").alias("hypotheses"), F.array(F.struct(F.transform("x", step).alias("steps"))).alias("usage_episodes"),
    )
    return samples, own.select(key.alias("benchmark_case_id"), F.transform("x", episode).alias("episodes")), own.select(key.alias("paper_name"), F.struct(key.alias("system_name")).alias("system_context")), own.select(key.alias("paper_name"), F.struct(workflow.alias("workflows")).alias("workflow_context")), usage


@query("""WITH li AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, l_returnflag AS f FROM lineitem),
last AS (SELECT *, dense_rank() OVER (PARTITION BY k ORDER BY n) AS place, row_number() OVER (PARTITION BY k, n ORDER BY p DESC, s DESC, f DESC) AS r FROM li),
pre AS (SELECT * FROM last WHERE place <= 2 AND r = 1)
SELECT k::varchar AS sample_id, count(*) FILTER (place <= 2 AND r = 1) AS prefix_length, string_agg(n || ':' || p || ':' || f || ':' || CASE WHEN f = 'N' THEN s || '.s' ELSE s::varchar END, '|' ORDER BY n) FILTER (place <= 2 AND r = 1) AS prefix,
coalesce(string_agg('/i/' || p, '|' ORDER BY n) FILTER (place <= 2 AND r = 1 AND f = 'R'), '') AS images, string_agg('w/' || p || '/' || n || '/' || s, '|' ORDER BY n, p, s, f) AS stages FROM last GROUP BY k""")
def benchmark_records(spark: SparkSession, d: str) -> DataFrame:
    """Records of orders: their prefixes with steps, their images, and the stages that a judge is told of."""
    held = records.built_records(*record_tables(spark, d), "Predict.", VERSION, TASK)
    told = records.judge_payloads(held, held.select(F.col("metadata.sample_id").alias("sample_id"), F.lit("x").alias("prediction"))).select("sample_id", F.col("payload.workflow_stages").alias("s"))
    episodes, images = F.col("model_input.case_context.prefix_episodes"), F.col("model_input.visual_context.prefix_episode_images")
    each = lambda e: F.concat_ws(":", e["benchmark_episode_index"].cast("string"), e["episode_title"], e["local_goal"], F.get(F.get(e["steps"], F.lit(0))["used_views"], F.lit(0)))
    out = held.select(
        F.col("metadata.sample_id").alias("sample_id"), F.col("metadata.prefix_length").cast("long").alias("prefix_length"), F.array_join(F.transform(episodes, each), "|").alias("prefix"),
        F.array_join(F.transform(images, lambda i: i["image_path"]), "|").alias("images"),
    )
    stages = F.array_join(F.transform("s", lambda x: F.concat_ws("/", x["workflow_id"], x["stage_id"], x["stage_index"].cast("string"), F.get(x["used_views"], F.lit(0)))), "|")
    return out.join(told.select("sample_id", stages.alias("stages")), "sample_id")


@query("""WITH n AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1),
stage AS (SELECT k, '$.model_input.workflow_context.workflows[0].stages[' || i || '].' AS p FROM (SELECT k, unnest(range(n)) AS i FROM n WHERE k % 5 <> 3)),
x AS (SELECT k, CASE k % 5 WHEN 0 THEN '$.metadata.case_index' WHEN 1 THEN '$.gold.gold_next_goal' WHEN 2 THEN '$.gold.gold_next_views[0]' WHEN 3 THEN '$' ELSE '$.model_input.schema_version' END AS path, ['type', 'missing', 'pattern', 'not_json', 'value'][k % 5 + 1] AS rule FROM n)
SELECT k, path, rule FROM x UNION ALL SELECT k, p || 'workflow_id', 'missing' FROM stage UNION ALL SELECT k, p || 'stage_title', 'missing' FROM stage""")
def record_violations(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark records as lines, each with one more defect: their stages lack two fields anyway."""
    held = records.built_records(*record_tables(spark, d), "Predict.", VERSION, TASK)
    k, line = F.col("metadata.sample_id").cast("long"), F.to_json(F.struct("metadata", "model_input", "gold"), {"ignoreNullFields": "false"})
    defects = (('"case_index":1', '"case_index":"one"'), ('"gold_next_goal":', '"gold_goal":'), ('"gold_next_views":[', '"gold_next_views":["Bad Id",'))
    value = F.when(k % 5 == 3, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(F.replace(line, F.lit(f'"{VERSION}"'), F.lit('"v0"')))
    for n, (old, new) in enumerate(defects):
        value = F.when(k % 5 == n, F.replace(line, F.lit(old), F.lit(new))).otherwise(value)
    lines = computed(held, {"k": k, "value": value}).select("k", "value")
    found = rules.checked(lines, rules.record_rule(VERSION, TASK))
    return found.select("k", F.explode("problems").alias("p")).select("k", "p.path", "p.rule")
