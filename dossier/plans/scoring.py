"""Scoring queries. A sample is an order; what is predicted and what is gold comes from its lines.

Capabilities are suppliers, subviews nations, views regions. Predicted are the suppliers of open lines, gold those of
lines that weren't returned as N. Views: the line's nation or region, by the parity of its number (predicted) or of its
quantity (gold).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import same_set
from ..functions.frames import computed
from ..operators.evaluation import with_matches, with_reviews, with_structure, with_support
from ..operators.hierarchy import supported_views, view_dimension
from ..operators.matching import capability_matches, scored, strict_matches, support_counts, view_matches
from ..operators.summaries import all_summaries, summary
from .registry import query, table


def cap_id(c: str):
    return F.concat(F.lit("s:"), F.col(c).cast("string"))


def dimension(spark: SparkSession, d: str) -> DataFrame:
    """(capability_id, subview_id, view_id)"""
    joined = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return joined.select(cap_id("s_suppkey").alias("capability_id"), F.concat(F.lit("n:"), F.col("s_nationkey")).alias("subview_id"), F.concat(F.lit("r:"), F.col("n_regionkey")).alias("view_id"))


def views_of(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.concat(F.lit("n:"), F.col("n_nationkey")).alias("subview_id"), F.concat(F.lit("r:"), F.col("n_regionkey")).alias("view_id"))
    return view_dimension(n)


def lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("sample_id"), "l_suppkey", "l_partkey", "l_linenumber", "l_quantity", (F.col("l_linestatus") == "O").alias("pred"), (F.col("l_returnflag") != "N").alias("gold")
    )


def capabilities(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, side, capability_id)"""
    sides = F.explode(F.array_compact(F.array(F.when(F.col("pred"), "pred"), F.when(F.col("gold"), "gold"))))
    return lines(spark, d).select("sample_id", sides.alias("side"), cap_id("l_suppkey").alias("capability_id"))


def views(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, side, id)"""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    own = lines(spark, d).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    nation, region = F.concat(F.lit("n:"), F.col("n_nationkey")), F.concat(F.lit("r:"), F.col("n_regionkey"))
    pred = F.struct(F.lit("pred").alias("side"), F.when(F.col("l_linenumber") % 2 == 1, nation).otherwise(region).alias("id"))
    gold = F.struct(F.lit("gold").alias("side"), F.when(F.col("l_quantity").cast("long") % 2 == 1, nation).otherwise(region).alias("id"))
    return own.select("sample_id", F.explode(F.array_compact(F.array(F.when(F.col("pred"), pred), F.when(F.col("gold"), gold)))).alias("i")).select("sample_id", "i.*")


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Orders with a line, with the three groupings."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    own = o.select(F.col("o_orderkey").alias("sample_id"), F.col("c_mktsegment").alias("paper_name"), F.col("o_orderpriority").alias("prefix_length"), F.col("o_orderstatus").alias("segmentation_mode"))
    return own.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_id")), "sample_id", "left_semi")


def sets(spark: SparkSession, d: str, only: tuple[str, ...] | None = None, text: bool = False) -> DataFrame:
    """Each order with a line, and lists of what its lines predict, what is gold and what its workflow uses: one pass over the
    lines and one shuffle of them, by sample. Of the lists only those named, if any are; with text, a sample's id is a text."""
    named = lambda df: df.withColumn("sample_id", F.col("sample_id").cast("string")) if text else df
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    own = lines(spark, d).join(s, F.col("l_suppkey") == F.col("s_suppkey"), "left").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    line = F.struct("pred", "gold", (F.col("l_linenumber") % 2 == 1).alias("odd"), (F.col("l_quantity").cast("long") % 2 == 1).alias("odd_quantity"), (F.col("l_quantity") <= 25).alias("used"), "l_suppkey", "n_nationkey", "n_regionkey")
    of_sample = named(own).groupBy("sample_id").agg(F.collect_list(line).alias("_lines"))
    nation, region, supplier = (lambda x, c=c, k=k: F.concat(F.lit(f"{k}:"), x[c]) for c, k in (("n_nationkey", "n"), ("n_regionkey", "r"), ("l_suppkey", "s")))
    capability = lambda x: F.struct(supplier(x).alias("id"), nation(x).alias("subview_id"), region(x).alias("view_id"))
    view = lambda odd: lambda x: F.struct(F.when(x[odd], nation(x)).otherwise(region(x)).alias("id"), region(x).alias("view_id"))
    each = lambda rule, value: F.array_distinct(F.transform(F.filter("_lines", rule), value))
    listed = {
        "pred_capability": each(lambda x: x["pred"], capability),
        "gold_capability": each(lambda x: x["gold"], capability),
        "all_capability": F.array_distinct(F.transform("_lines", capability)),
        "pred_view": each(lambda x: x["pred"], view("odd")),
        "gold_view": each(lambda x: x["gold"], view("odd_quantity")),
        "used_view": each(lambda x: x["used"], lambda x: F.struct(nation(x).alias("id"), region(x).alias("view_id"))),
        "used_capability": each(lambda x: x["used"], lambda x: supplier(x)),
        "_bad_view": each(lambda x: x["pred"] & (x["l_suppkey"] % 11 == 0), lambda x: x["l_suppkey"]),
        "_bad_capability": each(lambda x: x["pred"] & (x["l_suppkey"] % 13 == 0), lambda x: x["l_suppkey"]),
    }
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    about = o.select(F.col("o_orderkey").alias("sample_id"), F.col("c_mktsegment").alias("paper_name"), F.col("o_orderpriority").alias("prefix_length"), F.col("o_orderstatus").alias("segmentation_mode"))
    return computed(named(about).join(of_sample, "sample_id"), {c: x for c, x in listed.items() if not only or c in only}).drop("_lines")


def bundle(spark: SparkSession, d: str) -> DataFrame:
    """All scores of the two set predictions of each sample, strict and relaxed."""
    return with_structure(with_matches(sets(spark, d)))


def used(spark: SparkSession, d: str) -> DataFrame:
    """(sample_id, id) of the lines with a quantity up to 25: what the workflow of a sample uses."""
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("n:"), F.col("s_nationkey")).alias("id"))
    return lines(spark, d).where("l_quantity <= 25").join(s, F.col("l_suppkey") == F.col("s_suppkey")).select("sample_id", "id")


def score_rows(spark: SparkSession, d: str) -> DataFrame:
    """Score rows with the columns that summaries and reviews read. Goal scores come from the order key (a judge's 0 to 4,
    none for every seventh); ids are invalid for every eleventh and thirteenth supplier key."""
    rows = with_support(bundle(spark, d))
    k = F.col("sample_id")
    judged = k % 7 != 0
    rows = rows.select(
        "*", F.size("_bad_view").cast("long").alias("invalid_view_id_count"), F.size("_bad_capability").cast("long").alias("invalid_capability_id_count"),
        F.lit(True).alias("completion"), (k % 5 != 0).alias("json_valid"), (k % 4 != 0).alias("schema_valid"), judged.alias("goal_score_available"), judged.alias("goal_judge_sample_ok"),
        F.when(judged, (k % 5).cast("double") / 4).alias("goal_score"), F.when(judged, "ok").otherwise("judge_not_configured").alias("goal_judge_status"),
        F.when(judged, 1).otherwise(0).cast("long").alias("goal_judge_ok_count"), F.when(judged, 0).otherwise(1).cast("long").alias("goal_judge_error_count"), F.lit(1).cast("long").alias("goal_judge_run_count"),
        F.col("view_n_pred").alias("raw_predicted_view_count"), F.col("capability_n_pred").alias("raw_predicted_capability_count"),
    )
    return with_reviews(rows)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to a fixed number of places, since sums in another order differ in the last ones."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


# ---------------------------------------------------------------- the same in SQL

DIM = """
dim AS (SELECT 's:' || s_suppkey AS capability_id, 'n:' || s_nationkey AS subview_id, 'r:' || n_regionkey AS view_id FROM supplier JOIN nation ON s_nationkey = n_nationkey),
vdim AS (SELECT 'n:' || n_nationkey AS id, 'r:' || n_regionkey AS view_id FROM nation UNION SELECT 'r:' || n_regionkey, 'r:' || n_regionkey FROM nation),
line AS (SELECT l_orderkey AS sample_id, l_suppkey, l_partkey, l_linenumber, l_quantity, l_linestatus = 'O' AS pred, l_returnflag <> 'N' AS gold, 'n:' || s_nationkey AS nid, 'r:' || n_regionkey AS rid
  FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey),
cap AS (SELECT sample_id, 's:' || l_suppkey AS capability_id, max(pred::int) AS p, max(gold::int) AS g FROM line WHERE pred OR gold GROUP BY ALL),
vitem AS (SELECT sample_id, CASE WHEN l_linenumber % 2 = 1 THEN nid ELSE rid END AS id, 1 AS p, 0 AS g FROM line WHERE pred
  UNION ALL SELECT sample_id, CASE WHEN l_quantity::bigint % 2 = 1 THEN nid ELSE rid END, 0, 1 FROM line WHERE gold),
vw AS (SELECT sample_id, id, max(p) AS p, max(g) AS g FROM vitem GROUP BY ALL),
sample AS (SELECT o_orderkey AS sample_id, c_mktsegment AS paper_name, o_orderpriority AS prefix_length, o_orderstatus AS segmentation_mode
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)),
c1 AS (SELECT sample_id, view_id, subview_id, sum(p) AS np, sum(g) AS ng, sum(p*g) AS e, sum(p-p*g) AS p, sum(g-p*g) AS g FROM cap JOIN dim USING (capability_id) GROUP BY ALL),
c2 AS (SELECT sample_id, view_id, sum(np) AS np, sum(ng) AS ng, sum(e) AS e, sum(least(p,g)) AS h, least(sum(p-least(p,g)), sum(g-least(p,g))) AS q FROM c1 GROUP BY ALL),
cm AS (SELECT sample_id, sum(np)::bigint AS np, sum(ng)::bigint AS ng, sum(e)::double AS e, sum(e)::double + 0.5::double*sum(h) + 0.25::double*sum(q) AS m FROM c2 GROUP BY ALL),
v1 AS (SELECT sample_id, view_id, sum(p) AS np, sum(g) AS ng, sum(p*g) AS e,
  least(sum((p-p*g)*(id=view_id)::int), sum((g-p*g)*(id<>view_id)::int)) + least(sum((g-p*g)*(id=view_id)::int), sum((p-p*g)*(id<>view_id)::int)) AS h FROM vw JOIN vdim USING (id) GROUP BY ALL),
vm AS (SELECT sample_id, sum(np)::bigint AS np, sum(ng)::bigint AS ng, sum(e)::double AS e, sum(e)::double + 0.5::double*sum(h) AS m FROM v1 GROUP BY ALL)
"""
P = "CASE WHEN coalesce({a},0)=0 AND coalesce({b},0)=0 THEN 1.0::double WHEN coalesce({a},0)=0 OR coalesce({b},0)=0 THEN 0.0::double ELSE {m}::double/{a} END"
F1 = "coalesce(2*{p}*{r}/nullif({p}+{r},0),0)"


def scores_sql(name: str, matches: str, m: str = "m") -> str:
    p, r = P.format(a="x.np", b="x.ng", m=f"x.{m}"), P.format(a="x.ng", b="x.np", m=f"x.{m}")
    return f"{name} AS (SELECT *, {F1.format(p='p', r='r')} AS f FROM (SELECT s.*, coalesce(x.np,0) AS np, coalesce(x.ng,0) AS ng, coalesce(x.e,0) AS e, {p} AS p, {r} AS r FROM sample s LEFT JOIN {matches} x USING (sample_id)))"


BUNDLE = f"""{DIM}, {scores_sql('cs', 'cm', 'e')}, {scores_sql('cr', 'cm')}, {scores_sql('vs', 'vm', 'e')}, {scores_sql('vr', 'vm')},
bundle AS (SELECT cs.sample_id, cs.paper_name, cs.prefix_length, cs.segmentation_mode,
  vs.p AS view_precision_strict, vs.r AS view_recall_strict, vs.f AS view_f1_strict, vr.p AS view_precision_relaxed, vr.r AS view_recall_relaxed, vr.f AS view_f1_relaxed,
  cs.p AS capability_precision_strict, cs.r AS capability_recall_strict, cs.f AS capability_f1_strict, cr.p AS capability_precision_relaxed, cr.r AS capability_recall_relaxed, cr.f AS capability_f1_relaxed,
  vs.e = vs.np AND vs.e = vs.ng AS view_exact_match, cs.e = cs.np AND cs.e = cs.ng AS capability_exact_match,
  vs.e = vs.np AND vs.e = vs.ng AND cs.e = cs.np AND cs.e = cs.ng AS joint_exact_match, 0.5::double*vr.f + 0.5::double*cr.f AS structure_score, vs.np AS vnp, cs.np AS cnp
  FROM cs JOIN cr USING (sample_id) JOIN vs USING (sample_id) JOIN vr USING (sample_id))"""

SUPPORT = """
used AS (SELECT DISTINCT sample_id, nid AS id, rid, 's:' || l_suppkey AS capability_id FROM line WHERE l_quantity <= 25),
ok AS (SELECT sample_id, id FROM used UNION SELECT sample_id, rid FROM used),
pv AS (SELECT sample_id, id FROM vw WHERE p = 1), pc AS (SELECT sample_id, capability_id FROM cap WHERE p = 1),
v AS (SELECT sample_id, count(*) AS predicted_view_count, count(ok.id) AS workflow_view_supported_count FROM pv LEFT JOIN ok USING (sample_id, id) GROUP BY 1),
c AS (SELECT sample_id, count(*) AS predicted_capability_count, count(u.capability_id) AS workflow_capability_supported_count FROM pc LEFT JOIN (SELECT DISTINCT sample_id, capability_id FROM used) u USING (sample_id, capability_id) GROUP BY 1),
i AS (SELECT sample_id, count(*) AS internal_consistency_supported_count FROM pc JOIN dim USING (capability_id) WHERE EXISTS (SELECT 1 FROM pv WHERE pv.sample_id = pc.sample_id AND pv.id IN (subview_id, view_id)) GROUP BY 1),
support AS (SELECT sample_id, coalesce(predicted_view_count,0) AS predicted_view_count, coalesce(workflow_view_supported_count,0) AS workflow_view_supported_count,
  coalesce(predicted_capability_count,0) AS predicted_capability_count, coalesce(workflow_capability_supported_count,0) AS workflow_capability_supported_count,
  coalesce(internal_consistency_supported_count,0) AS internal_consistency_supported_count, coalesce(predicted_capability_count,0) AS internal_consistency_total_count,
  workflow_view_supported_count::double/nullif(predicted_view_count,0) AS workflow_view_support_rate, workflow_capability_supported_count::double/nullif(predicted_capability_count,0) AS workflow_capability_support_rate,
  coalesce(internal_consistency_supported_count,0)::double/nullif(predicted_capability_count,0) AS internal_consistency_rate
  FROM sample LEFT JOIN v USING (sample_id) LEFT JOIN c USING (sample_id) LEFT JOIN i USING (sample_id))"""

ROWS = f"""{BUNDLE}, {SUPPORT},
bad AS (SELECT sample_id, count(DISTINCT CASE WHEN l_suppkey % 11 = 0 THEN l_suppkey END) AS iv, count(DISTINCT CASE WHEN l_suppkey % 13 = 0 THEN l_suppkey END) AS ic FROM line WHERE pred GROUP BY 1),
r0 AS (SELECT b.*, s.* EXCLUDE (sample_id), coalesce(iv,0) AS invalid_view_id_count, coalesce(ic,0) AS invalid_capability_id_count, sample_id % 7 <> 0 AS judged,
  CASE WHEN sample_id % 7 <> 0 THEN (sample_id % 5)::double/4 END AS goal_score FROM bundle b JOIN support s USING (sample_id) LEFT JOIN bad USING (sample_id)),
r1 AS (SELECT *, 0.4::double*view_f1_relaxed + 0.4::double*capability_f1_relaxed + 0.2::double*goal_score AS next_move_score,
  list_filter([CASE WHEN goal_score >= 0.5 AND structure_score < 0.25 THEN 'goal_good_but_structure_low' END, CASE WHEN goal_score < 0.25 AND structure_score >= 0.7 THEN 'structure_good_but_goal_low' END,
    CASE WHEN invalid_view_id_count + invalid_capability_id_count >= 2 THEN 'many_invalid_ids' END,
    CASE WHEN view_f1_relaxed - view_f1_strict >= 0.5 OR capability_f1_relaxed - capability_f1_strict >= 0.5 THEN 'strict_low_relaxed_high' END], lambda x: x IS NOT NULL) AS reasons FROM r0)"""
MEANS = (
    *(f"{k}_{m}_{h}" for k in ("view", "capability") for h in ("strict", "relaxed") for m in ("precision", "recall", "f1")),
    "structure_score", "workflow_view_support_rate", "workflow_capability_support_rate", "internal_consistency_rate", "goal_score", "next_move_score",
)


def summary_sql(group: str | None) -> str:
    first = f"{group}, " if group else ""
    rate = lambda c: f"round(coalesce(count_if({c})::double/nullif(count(*),0),0),6)"
    return f"""WITH {ROWS} SELECT {f"coalesce({group}::varchar,'None') AS {group}, " if group else ""}count(*) AS sample_count,
    count(*) AS completed_count, round(count(*)::double/nullif(count(*),0),6) AS completion_rate, count_if(sample_id%5<>0)::bigint AS json_valid_count, {rate('sample_id%5<>0')} AS json_valid_rate,
    count_if(sample_id%4<>0)::bigint AS schema_valid_count, {rate('sample_id%4<>0')} AS schema_valid_rate, count_if(judged)::bigint AS goal_score_available_count, {rate('judged')} AS goal_score_available_rate,
    count_if(judged)::bigint AS goal_judge_sample_ok_count, {rate('judged')} AS goal_judge_sample_ok_rate, count_if(judged)::bigint AS goal_judge_ok_count, {rate('judged')} AS goal_judge_ok_rate,
    count_if(NOT judged)::bigint AS goal_judge_error_count, {rate('NOT judged')} AS goal_judge_error_rate, count(*) AS goal_judge_run_count, count_if(NOT judged)::bigint AS goal_judge_not_configured_count, 0::bigint AS goal_judge_multi_run_count,
    {rate('view_exact_match')} AS view_exact_match_rate, {rate('capability_exact_match')} AS capability_exact_match_rate, {rate('joint_exact_match')} AS joint_exact_match_rate,
    sum(invalid_view_id_count)::bigint AS invalid_view_id_count, round(sum(invalid_view_id_count)::double/nullif(sum(vnp),0),6) AS invalid_view_id_rate,
    sum(invalid_capability_id_count)::bigint AS invalid_capability_id_count, round(sum(invalid_capability_id_count)::double/nullif(sum(cnp),0),6) AS invalid_capability_id_rate,
    round(sum(workflow_view_supported_count)::double/nullif(sum(predicted_view_count),0),6) AS workflow_view_support_rate_micro, round(sum(workflow_capability_supported_count)::double/nullif(sum(predicted_capability_count),0),6) AS workflow_capability_support_rate_micro,
    round(sum(internal_consistency_supported_count)::double/nullif(sum(internal_consistency_total_count),0),6) AS internal_consistency_rate_micro, count_if(len(reasons)>0)::bigint AS review_queue_count,
    {', '.join(f'round(avg({m}),6) AS {m}' for m in MEANS)} FROM r1 {f'GROUP BY {first.rstrip(", ")}' if group else ''}"""


def prf_sql(matches: str, m: str = "m") -> str:
    return f"WITH {DIM}, {scores_sql('x', matches, m)} SELECT sample_id, np::bigint AS n_pred, ng::bigint AS n_gold, p AS precision, r AS recall, f AS f1 FROM x"


# ---------------------------------------------------------------- queries


def prf(spark: SparkSession, d: str, matches: DataFrame, matched: str = "matched") -> DataFrame:
    return scored(samples(spark, d).select("sample_id"), matches, matched).select("sample_id", "n_pred", "n_gold", "precision", "recall", "f1")


@query(f"WITH {DIM}, {scores_sql('x', 'cm')} SELECT coalesce(paper_name,'None') AS paper_name, count(*) AS sample_count, round(avg(p),6) AS precision, round(avg(r),6) AS recall, round(avg(f),6) AS f1 FROM x GROUP BY 1")
def flagship_capability_summary(spark: SparkSession, d: str) -> DataFrame:
    grouped = bundle(spark, d).groupBy(F.coalesce(F.col("paper_name").cast("string"), F.lit("None")).alias("paper_name"))
    return rounded(grouped.agg(F.count("*").alias("sample_count"), *(F.avg(f"capability_{c}_relaxed").alias(c) for c in ("precision", "recall", "f1")))).orderBy("paper_name")


@query(prf_sql("cm"))
def capability_relaxed_scores(spark: SparkSession, d: str) -> DataFrame:
    return prf(spark, d, capability_matches(capabilities(spark, d), dimension(spark, d)))


@query(prf_sql("vm"))
def view_relaxed_scores(spark: SparkSession, d: str) -> DataFrame:
    return prf(spark, d, view_matches(views(spark, d), views_of(spark, d)))


@query(prf_sql("cm", "e"))
def strict_scores(spark: SparkSession, d: str) -> DataFrame:
    return prf(spark, d, strict_matches(capabilities(spark, d), "capability_id"))


@query(f"WITH {DIM} SELECT sample_id, coalesce(sum((p<>g)::int),0) = 0 AS capability_exact_match FROM sample LEFT JOIN cap USING (sample_id) GROUP BY 1")
def exact_match_flags(spark: SparkSession, d: str) -> DataFrame:
    sets = lines(spark, d).groupBy("sample_id").agg(F.collect_set(F.when(F.col("pred"), F.col("l_suppkey"))).alias("p"), F.collect_set(F.when(F.col("gold"), F.col("l_suppkey"))).alias("g"))
    return samples(spark, d).select("sample_id").join(sets, "sample_id").select("sample_id", same_set("p", "g").alias("capability_exact_match"))


BUNDLE_COLUMNS = (*MEANS[:13], "view_exact_match", "capability_exact_match", "joint_exact_match")


@query(f"WITH {BUNDLE} SELECT sample_id, {', '.join(BUNDLE_COLUMNS)} FROM bundle")
def structure_bundle(spark: SparkSession, d: str) -> DataFrame:
    return bundle(spark, d).select("sample_id", *BUNDLE_COLUMNS)


SUPPORTED = (
    "predicted_view_count", "workflow_view_supported_count", "predicted_capability_count", "workflow_capability_supported_count", "internal_consistency_supported_count",
    "internal_consistency_total_count", "workflow_view_support_rate", "workflow_capability_support_rate", "internal_consistency_rate",
)


@query(f"WITH {DIM}, {SUPPORT} SELECT * FROM support")
def support_rates(spark: SparkSession, d: str) -> DataFrame:
    return with_support(with_matches(sets(spark, d))).select("sample_id", *SUPPORTED)


@query(f"WITH {DIM}, {SUPPORT} SELECT sample_id, predicted_view_count AS n_pred, workflow_view_supported_count AS n_supported FROM support WHERE predicted_view_count > 0 OR EXISTS (SELECT 1 FROM used WHERE used.sample_id = support.sample_id)")
def supported_view_counts(spark: SparkSession, d: str) -> DataFrame:
    """The same count from tables of ids, for samples whose lists don't fit a row."""
    pv = views(spark, d).where("side = 'pred'").select("sample_id", "id")
    return support_counts(pv, supported_views(used(spark, d), views_of(spark, d)), "id")


@query("""WITH pair AS (SELECT DISTINCT s_nationkey, p_size // 10 AS stage FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey WHERE year(l_shipdate) = 1995),
ask AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 <> 0 THEN s_nationkey END AS n, p_size // 10 AS stage FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
SELECT l_orderkey AS sample_id, l_linenumber AS line, CASE WHEN n IS NOT NULL THEN EXISTS (SELECT 1 FROM pair WHERE pair.s_nationkey = ask.n AND pair.stage = ask.stage) END AS workflow_stage_valid FROM ask""")
def stage_pair_validity(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    stage = (F.col("p_size") / 10).cast("int")
    pairs = li.where(F.year("l_shipdate") == 1995).select(F.col("s_nationkey").alias("n"), stage.alias("stage"), F.lit(True).alias("known")).distinct()
    ask = li.select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("line"), F.when(F.col("l_linenumber") % 3 != 0, F.col("s_nationkey")).alias("n"), stage.alias("stage"))
    return ask.join(pairs, ["n", "stage"], "left").select("sample_id", "line", F.when(F.col("n").isNotNull(), F.coalesce("known", F.lit(False))).alias("workflow_stage_valid"))


@query("""SELECT l_orderkey AS sample_id, l_suppkey AS id, min(l_linenumber) AS first_line FROM lineitem WHERE l_linestatus = 'O' AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0) GROUP BY 1, 2""")
def invalid_ids(spark: SparkSession, d: str) -> DataFrame:
    valid = table(spark, d, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("id"))
    predicted = table(spark, d, "lineitem").where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("sample_id"), F.col("l_suppkey").alias("id"), "l_linenumber")
    return predicted.join(valid, "id", "left_anti").groupBy("sample_id", "id").agg(F.min("l_linenumber").alias("first_line"))


@query(summary_sql(None))
def summary_global(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary(score_rows(spark, d)))


@query(summary_sql("paper_name"))
def summary_by_paper(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary(score_rows(spark, d), "paper_name"))


GROUPS = ("paper_name", "prefix_length", "segmentation_mode")


@query(summary_sql(None).replace(" FROM r1 ", f""", {"CASE " + " ".join(f"WHEN grouping({g}) = 0 THEN '{g}'" for g in GROUPS) + " END"} AS group_by, {"CASE " + " ".join(f"WHEN grouping({g}) = 0 THEN coalesce({g}::varchar, 'None')" for g in GROUPS) + " END"} AS group_value FROM r1 GROUP BY GROUPING SETS ((), {", ".join(f"({g})" for g in GROUPS)})"""))
def summary_all(spark: SparkSession, d: str) -> DataFrame:
    """All four summaries from one pass over the score rows."""
    return rounded(all_summaries(score_rows(spark, d), GROUPS))


@query(summary_sql("prefix_length"))
def summary_by_prefix(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary(score_rows(spark, d), "prefix_length"))


@query(summary_sql("segmentation_mode"))
def summary_by_mode(spark: SparkSession, d: str) -> DataFrame:
    return rounded(summary(score_rows(spark, d), "segmentation_mode"))


@query(f"WITH {ROWS} SELECT sample_id, array_to_string(reasons, ';') AS review_reasons, round(structure_score,6) AS structure_score, goal_score FROM r1 WHERE len(reasons) > 0")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    rows = score_rows(spark, d).where("needs_review")
    return rounded(rows.select("sample_id", F.array_join("review_reasons", ";").alias("review_reasons"), "structure_score", "goal_score"))
