"""Result logs, repeats of judges and model runs. A log is the events in order: the sample is the user, the status the type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.frames import removed, shared_path
from ..functions.jsonx import parsed, payload
from ..operators.modelcall import cache_misses, run_model
from ..operators.report import write_jsonl
from ..operators.resultlog import evaluation_status, last_results, log_counters, observed_results, pending
from ..operators.summaries import repeat_summary, repeated
from ..streaming.lastwins import followed, named_rows, stateful, states
from .registry import query, table


def log_lines(spark: SparkSession, d: str) -> DataFrame:
    """The log as text: some lines are broken, lists or blank, and some ids are numbers."""
    e, k = table(spark, d, "events"), F.col("event_id")
    key = F.when(k % 13 == 0, F.col("user_id").cast("string")).otherwise(F.concat(F.lit('"u'), F.col("user_id").cast("string"), F.lit('"')))
    row = F.concat(F.lit('{"sample_id": '), key, F.lit(', "status": "'), F.col("event_type"), F.lit('", "prediction": '), F.col("props"), F.lit("}"))
    text = F.when(k % 17 == 0, "not json").when(k % 17 == 1, "[1]").when(k % 17 == 2, " ").otherwise(row)
    return e.select(k.alias("line_no"), text.alias("value"))


def file_lines(spark: SparkSession, d: str, files: int = 8) -> str:
    """The log as a folder of JSON lines, dealt to files by a hash, so that later lines come in earlier files."""
    path = shared_path(spark, "log")
    write_jsonl(log_lines(spark, d).repartition(files, F.xxhash64("line_no")), path)
    return path


LOG = """log AS (SELECT event_id AS line_no, user_id, event_type, props, event_id % 17 IN (0, 1) AS bad, event_id % 17 = 2 AS blank, event_id % 13 = 0 AS no_id FROM events)"""


@query(f"""WITH {LOG} SELECT 'u' || user_id AS sample_id, max(line_no) AS line_no, arg_max(event_type, line_no) AS status FROM log WHERE NOT bad AND NOT blank AND NOT no_id GROUP BY user_id""")
def result_log_last_wins(spark: SparkSession, d: str) -> DataFrame:
    return last_results(log_lines(spark, d)).select("sample_id", "line_no", F.try_variant_get("row", "$.status", "string").alias("status"))


@query(f"""WITH {LOG} SELECT count_if(bad)::bigint AS result_line_parse_error_count, count_if(NOT bad AND NOT blank AND no_id)::bigint AS result_rows_without_sample_id_count,
count_if(NOT bad AND NOT blank AND NOT no_id)::bigint - count(DISTINCT CASE WHEN NOT bad AND NOT blank AND NOT no_id THEN user_id END) AS duplicate_result_row_count, count_if(NOT bad AND NOT blank)::bigint AS result_row_count FROM log""")
def result_log_stats(spark: SparkSession, d: str) -> DataFrame:
    return log_counters(log_lines(spark, d))


@query(f"""WITH {LOG} SELECT 'u' || user_id AS sample_id, max(line_no) AS line_no, arg_max(event_type, line_no) AS status, count(*) AS n_rows FROM log WHERE NOT bad AND NOT blank AND NOT no_id GROUP BY user_id""")
def result_log_replayed(spark: SparkSession, d: str) -> DataFrame:
    """The log as a stream of files, three at a time: the states after the last batch."""
    own, folder, made = stateful(spark), file_lines(spark, d), shared_path(spark, "states")
    lines = own.readStream.schema("line_no long, value string").option("maxFilesPerTrigger", 3).json(folder)
    followed(named_rows(lines), f"{made}/changes", f"{made}/checkpoint").awaitTermination()
    states(own, f"{made}/checkpoint").write.parquet(f"{made}/last")
    for path in (folder, f"{made}/changes", f"{made}/checkpoint"):
        removed(spark, path)
    return spark.read.parquet(f"{made}/last").select("sample_id", F.col("place").alias("line_no"), "status", "n_rows")


@query(f"""WITH {LOG}, c AS (SELECT count_if(bad)::bigint AS result_line_parse_error_count, count_if(NOT bad AND NOT blank AND no_id)::bigint AS result_rows_without_sample_id_count,
count_if(NOT bad AND NOT blank AND NOT no_id)::bigint - count(DISTINCT CASE WHEN NOT bad AND NOT blank AND NOT no_id THEN user_id END) AS duplicate_result_row_count, count_if(NOT bad AND NOT blank)::bigint AS result_row_count FROM log)
SELECT 'u' || user_id AS sample_id, max(line_no) AS line_no, {", ".join(f"any_value({n}) AS {n}" for n in ("result_line_parse_error_count", "result_rows_without_sample_id_count", "duplicate_result_row_count", "result_row_count"))} FROM log, c WHERE NOT bad AND NOT blank AND NOT no_id GROUP BY user_id""")
def result_log_observed(spark: SparkSession, d: str) -> DataFrame:
    """The last rows of a log in files, with the counters that the same job observed."""
    folder, made = file_lines(spark, d), shared_path(spark, "results")
    rows, counters = observed_results(spark.read.schema("line_no long, value string").json(folder))
    rows.select("sample_id", "line_no").write.parquet(made)
    removed(spark, folder)
    return spark.read.parquet(made).select("sample_id", "line_no", *(F.lit(n).cast("long").alias(c) for c, n in counters().items()))


@query(f"""WITH {LOG}, last AS (SELECT user_id, arg_max(event_type, line_no) AS status, arg_max(CASE WHEN line_no % 3 = 0 THEN NULL ELSE props END, line_no) FILTER (line_no % 3 <> 0) AS p, max(line_no) AS line_no FROM log WHERE NOT bad AND NOT blank AND NOT no_id GROUP BY 1)
SELECT o_orderkey, CASE WHEN l.user_id IS NULL THEN 'missing_result' WHEN status <> 'click' THEN 'result_status_' || status WHEN line_no % 3 = 0 THEN 'prediction_missing_or_non_json' WHEN line_no % 3 = 1 AND line_no % 2 = 0 THEN 'schema_invalid' ELSE 'ok' END AS evaluation_status
FROM orders LEFT JOIN last l ON o_custkey % 400 = l.user_id""", name="evaluation_status")
def statuses(spark: SparkSession, d: str) -> DataFrame:
    """An order's result is that of its customer; a click is ok; predictions are objects, strings that hold one, or neither."""
    n = F.col("line_no")
    last = last_results(log_lines(spark, d)).select("sample_id", n, F.try_variant_get("row", "$.status", "string").alias("s"), F.try_variant_get("row", "$.prediction", "variant").alias("v"))
    text = F.when(n % 3 == 0, F.lit('"no json"')).when(n % 3 == 1, F.to_json(F.col("v"))).otherwise(F.to_json(F.struct(F.to_json("v").alias("s"))))
    held = last.withColumn("p", F.when(n % 3 == 2, F.try_variant_get(parsed(text), "$.s", "variant")).otherwise(parsed(text)))
    orders = table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("u"), (F.col("o_custkey") % 400).cast("string")).alias("sample_id"))
    joined = orders.join(held, "sample_id", "left")
    status = evaluation_status(F.col("s").isNotNull(), F.when(F.col("s") == "click", "ok").otherwise(F.col("s")), F.col("p"), ~((n % 3 == 1) & (n % 2 == 0)))
    return joined.select("o_orderkey", status.alias("evaluation_status"))


@query("""SELECT o_custkey, count(*) AS n_orders FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING') GROUP BY 1""")
def manifest_integrity(spark: SparkSession, d: str) -> DataFrame:
    known = table(spark, d, "customer").where("c_mktsegment <> 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return table(spark, d, "orders").join(known, "o_custkey", "left_anti").groupBy("o_custkey").agg(F.count("*").alias("n_orders"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')""")
def resume_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Customers are the samples, their urgent finished orders the log."""
    log = table(spark, d, "orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return pending(table(spark, d, "customer").select("c_custkey"), log, key="c_custkey")


@query("""SELECT user_id, count_if(event_type IN ('click','view'))::bigint AS processed, count_if(event_type = 'signup')::bigint AS skipped, count_if(event_type = 'error')::bigint AS failed FROM events GROUP BY 1""")
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    return table(spark, d, "events").groupBy("user_id").agg(F.count_if(t.isin("click", "view")).alias("processed"), F.count_if(t == "signup").alias("skipped"), F.count_if(t == "error").alias("failed"))


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus IN ('O','P') ORDER BY o_orderkey LIMIT 100""")
def id_filter_limit(spark: SparkSession, d: str) -> DataFrame:
    """The limit is the feature: a maximum number of samples; a negative one counts as none."""
    return table(spark, d, "orders").where(F.col("o_orderstatus").isin("O", "P")).orderBy("o_orderkey").limit(max(0, 100)).select("o_orderkey", "o_custkey")


def judge_runs(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    status = F.when(F.col("role") == "system", "judge_not_configured").when(F.length("text") % 7 == 0, "error").otherwise("ok")
    runs = c.select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("repeat_index"), status.alias("status"), F.col("text").alias("rationale"), (F.length("text") % 5).alias("s"))
    return runs.withColumn("judge_score", F.when(F.col("status") == "ok", F.col("s"))).drop("s")


RUNS = """runs AS (SELECT *, CASE WHEN status = 'ok' THEN s / 4.0::double END AS goal FROM (SELECT conv_id AS sample_id, turn AS repeat_index, CASE WHEN role = 'system' THEN 'judge_not_configured' WHEN length(text) % 7 = 0 THEN 'error' ELSE 'ok' END AS status, text AS rationale, length(text) % 5 AS s FROM conversations))"""


@query(f"""WITH {RUNS} SELECT sample_id, count(*) AS run_count, count_if(status='ok')::bigint AS ok_count, count_if(status<>'ok')::bigint AS error_count, round(avg(goal),6) AS goal_score_mean, round(stddev_pop(goal),6) AS goal_score_std,
min(goal) AS goal_score_min, max(goal) AS goal_score_max, coalesce(string_agg(goal::varchar, ',' ORDER BY repeat_index) FILTER (goal IS NOT NULL), '') AS goal_scores, arg_min(rationale, repeat_index) AS rationale FROM runs GROUP BY 1""")
def judge_repeat_aggregate(spark: SparkSession, d: str) -> DataFrame:
    own = repeat_summary(judge_runs(spark, d)).drop("status")
    return own.withColumn("goal_scores", F.array_join(F.col("goal_scores").cast("array<string>"), ",")).withColumn("goal_score_mean", F.round("goal_score_mean", 6)).withColumn("goal_score_std", F.round("goal_score_std", 6))


@query(f"""WITH {RUNS} SELECT sample_id, CASE WHEN count(*) = 1 THEN min(status) WHEN count_if(status='ok') = count(*) THEN 'multi_run_all_ok' WHEN count_if(status='ok') > 0 THEN 'multi_run_partial_ok' WHEN count_if(status='judge_not_configured') = count(*) THEN 'multi_run_not_configured' ELSE 'multi_run_all_error' END AS status FROM runs GROUP BY 1""")
def judge_status(spark: SparkSession, d: str) -> DataFrame:
    return repeat_summary(judge_runs(spark, d)).select("sample_id", "status")


@query("""SELECT s AS sample_id, r AS repeat_index FROM (SELECT DISTINCT conv_id AS s FROM conversations), range(1, 4) t(r) WHERE (s, r) NOT IN (SELECT (conv_id, turn) FROM conversations WHERE role = 'assistant' AND length(text) % 2 = 0)""")
def judge_cache_misses(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    ask = repeated(c.select(F.col("conv_id").alias("sample_id")).distinct(), 3).withColumn("repeat_index", F.col("repeat_index").cast("long"))
    ask = ask.withColumn("judge_model", F.lit("judge")).withColumn("prompt_version", F.lit("v1"))
    good = F.when(F.length("text") % 2 == 0, F.col("text"))
    cache = c.where("role = 'assistant'").select(F.col("conv_id").alias("sample_id"), F.col("turn").alias("repeat_index"), F.lit("judge").alias("judge_model"), F.lit("v1").alias("prompt_version"), good.alias("judgment"))
    return cache_misses(ask, cache).select("sample_id", "repeat_index")


def echoing():
    """A client without a network: JSON mode fails for odd lengths, and prompts of a length divisible by 9 always fail."""

    def ask(prompt: str, json_mode: bool) -> str:
        if len(prompt) % 9 == 0 or (json_mode and len(prompt) % 2):
            raise RuntimeError(f"refused {len(prompt)}")
        return f'{{"n": {len(prompt)}}}'

    return ask


@query("""SELECT conv_id || '-' || turn AS sample_id, CASE WHEN length(text) % 9 = 0 THEN 'error' ELSE 'ok' END AS status, CASE WHEN length(text) % 9 = 0 THEN 5 ELSE 1 END AS attempt_count,
CASE WHEN length(text) % 9 <> 0 THEN '{"n": ' || length(text) || '}' END AS response, CASE WHEN length(text) % 9 = 0 THEN 'refused ' || length(text) END AS error FROM conversations""")
def mock_model_run(spark: SparkSession, d: str) -> DataFrame:
    prompts = table(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("sample_id"), F.col("text").alias("prompt"))
    return run_model(prompts, echoing)


@query("""SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE (props->>'$.k')::bigint END AS k FROM events""")
def parse_payload(spark: SparkSession, d: str) -> DataFrame:
    """Predictions as objects, as strings that hold one, with space around, or broken."""
    n = F.col("event_id") % 4
    quoted = F.to_json(F.struct(F.concat(F.lit("  "), F.col("props")).alias("s")))
    held = F.when(n == 0, parsed("props")).when(n == 3, parsed(F.lit("[1]"))).otherwise(F.try_variant_get(parsed(quoted), "$.s", "variant"))
    return table(spark, d, "events").select("event_id", F.try_variant_get(payload(held), "$.k", "long").alias("k"))
