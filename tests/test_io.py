import json
import os

import pytest
from pyspark.sql import functions as F

from dossier.functions import frames
from dossier.operators import report, resultlog, summaries
from dossier.operators.modelcall import answered, cache_misses, data_urls, run_model, run_samples
from dossier.sources import readers
from dossier.streaming import lastwins
from dossier.streaming import resultlog as stream


def test_tolerant_lines(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"sample_id": "a", "status": "error"}\n\n   \nbroken\n[1]\n{"sample_id": 5}\n{"status": "ok"}\n{"sample_id": "a", "status": "ok"}\n{"sample_id": "b", "n": null}\n')
    lines = readers.json_lines(spark, str(path))
    assert tuple(resultlog.log_counters(lines).first()) == (2, 2, 1, 5)
    got = {r.sample_id: r.s for r in resultlog.last_results(lines).select("sample_id", F.try_variant_get("row", "$.status", "string").alias("s")).collect()}
    assert got == {"a": "ok", "b": None}
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.strict_json_lines(spark, str(path), "sample_id string").collect()


def test_documents(spark, tmp_path):
    (tmp_path / "a.json").write_text("\ufeff" + json.dumps([{"x": 1}, {"x": 2}], indent=1), encoding="utf-8")
    assert [r.x for r in readers.json_document(spark, str(tmp_path / "a.json")).orderBy("x").collect()] == [1, 2]
    (tmp_path / "b.json").write_text('{"x": 1}')
    got = {os.path.basename(r.file): (r.n, r.error) for r in readers.json_list(spark, str(tmp_path / "*.json")).select("file", F.size("items").alias("n"), "error").collect()}
    assert got == {"a.json": (2, None), "b.json": (None, "not a list")}


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,n,parts\nx,3,a | b||\ny,,\n")
    rows = readers.packed_csv(spark, str(tmp_path / "a.csv"), ["parts"], ["n"]).collect()
    assert [(r.id, r.n, r.parts) for r in rows] == [("x", 3, ["a", "b"]), ("y", None, [])]
    assert [(r.id, r.n) for r in readers.optional_csv(spark, str(tmp_path / "a.csv"), "id string, n int, parts string", ["n"]).collect()] == [("x", 3), ("y", 0)]
    assert readers.optional_csv(spark, str(tmp_path / "none.csv"), "id string, n int", ["n"]).count() == 0


def test_figure_metadata(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"figType": "Figure", "name": "1"}, {"figType": "Table", "name": "2"}]')
    (tmp_path / "b.json").write_text('{"figures": [{"figType": "figure", "name": "3"}], "tables": [{"figType": "Table", "name": "4"}]}')
    name = F.try_variant_get("figure", "$.name", "string").alias("n")
    assert sorted(r.n for r in readers.figure_metadata(spark, str(tmp_path)).select(name).collect()) == ["1", "3"]
    assert sorted(r.n for r in readers.figure_metadata(spark, str(tmp_path), tables=True).select(name).collect()) == ["1", "2", "3", "4"]


def test_discovery(spark, tmp_path):
    for name in ("p/Alpha.pdf", "q/beta/figures.json"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    roots = [readers.file_names(spark, str(tmp_path / "p/*.pdf")), readers.file_names(spark, str(tmp_path / "q/*/figures.json")), readers.file_names(spark, str(tmp_path / "none/*"))]
    assert [r.doc for r in report.document_names(roots, [r"/([^/]+)\.pdf$", r"/([^/]+)/figures\.json$", "(x)"]).collect()] == ["Alpha", "beta"]
    names = spark.createDataFrame([("alpha",), ("Alpha",), ("BETA",)], "stem string")
    got = dict(report.found_name(names, spark.createDataFrame([("Alpha",), ("beta",), ("none",)], "doc string")).collect())
    assert got == {"Alpha": "Alpha", "beta": "BETA", "none": None}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("é", None, [1, 2])], "a string, b string, c array<int>")
    report.write_jsonl(df, str(tmp_path / "x"))
    report.write_jsonl(df, str(tmp_path / "x"), mode="append")
    lines = [x for f in (tmp_path / "x").glob("part*") for x in f.read_text().splitlines()]
    assert lines == ['{"a":"é","b":null,"c":[1,2]}'] * 2
    report.write_csv(df.limit(0), str(tmp_path / "empty"))
    assert "".join(f.read_text() for f in (tmp_path / "empty").glob("part*")) == ""
    report.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == ["a", "b", "c"]
    report.write_document(spark, {"a": "é", "b": None}, str(tmp_path / "doc"))
    assert json.loads("".join(f.read_text() for f in (tmp_path / "doc").glob("part*"))) == {"a": "é", "b": None}
    assert [report.write_once(df, str(tmp_path / "once")), report.write_once(df, str(tmp_path / "once")), report.write_once(df, str(tmp_path / "once"), True)] == ["CREATED", "SKIPPED", "OVERWRITTEN"]
    rows = [("d", None, "p.json", "/f", [("fig_1", "ü")], None)]
    text = report.markdown(spark.createDataFrame(rows, "doc string, title string, passages_path string, figures_path string, figures array<struct<fig_id: string, caption: string>>, views_path string")).first().text
    assert text.startswith("# Preprocess Summary: d\n") and [x[3:] for x in text.splitlines() if x.startswith("## ")] == ["Paper", "Passages", "Figures", "View Images"]
    held = [json.loads(x.split("```")[0]) for x in text.split("```json\n")[1:]]
    assert held == [{"paper_name": "d", "paper_full_name": None}, {"path": "p.json"}, {"directory": "/f", "items": [{"fig_id": "fig_1", "caption": "ü"}]}, {"directory": None}]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    bad = spark.range(40).repartition(4).select(F.when(F.col("id") == 37, F.raise_error(F.lit("no"))).otherwise(F.col("id")).alias("id"))
    good = spark.createDataFrame([(1,)], "id long")
    with pytest.raises(Exception, match="no"):
        report.write_once(bad, str(tmp_path / "out"))
    assert list(tmp_path.iterdir()) == []
    assert report.write_once(good, str(tmp_path / "out")) == "CREATED"
    with pytest.raises(Exception, match="no"):
        report.write_once(bad, str(tmp_path / "out"), overwrite=True)
    assert [p.name for p in tmp_path.iterdir()] == ["out"] and spark.read.json(str(tmp_path / "out")).collect() == [(1,)]


def test_one_of_several_writers_says_created(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "out")
    with ThreadPoolExecutor(6) as pool:
        said = list(pool.map(lambda k: report.write_once(spark.createDataFrame([(k,)] * 5, "k int"), path), range(6)))
    assert sorted(said) == ["CREATED"] + ["SKIPPED"] * 5
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    rows = spark.read.json(path).collect()
    assert len(rows) == 5 and {r.k for r in rows} == {said.index("CREATED")}
    # a writer that finds out only when it moves its rows
    files = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    spark.createDataFrame([(9,)], "k int").write.json(str(tmp_path / "late"))
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    late = type("Files", (), {"exists": lambda self, p: files.exists(p) and p.toString() != path, "rename": lambda self, a, b: files.rename(a, b), "delete": lambda self, p, r: files.delete(p, r)})()
    assert not report.moved(late, path_of(str(tmp_path / "late")), path_of(path))
    assert len(spark.read.json(path).collect()) == 5


def test_all_summaries_in_one_pass(spark, tmp_path):
    columns = "sample_id string, paper_name string, prefix_length int, segmentation_mode string, completion boolean, structure_score double, needs_review boolean"
    scores = spark.createDataFrame([("a", "p", 1, "m", True, 0.5, True), ("b", None, 10, "m", False, None, False), ("c", "p", 1, None, None, 1.0, None)], columns)
    groups = ("paper_name", "prefix_length", "segmentation_mode")
    got = summaries.all_summaries(scores, groups)
    assert got._jdf.queryExecution().executedPlan().toString().count("Scan") == 1
    for g in groups:
        mine = got.where(F.col("group_by") == g).drop("group_by").withColumnRenamed("group_value", g).orderBy(g).collect()
        assert mine == summaries.summary(scores, g).collect()
    assert got.where("group_by is null").drop("group_by", "group_value").collect() == summaries.summary(scores).collect()
    assert summaries.all_summaries(scores.limit(0), groups).count() == 0
    report.write_evaluation(scores.limit(0), scores.select("sample_id"), {}, str(tmp_path / "none"))
    assert json.loads("".join(f.read_text() for f in (tmp_path / "none" / "summary.json").glob("part*")))["aggregate"]["sample_count"] == 0


def test_run_samples(spark, tmp_path):
    """Resume, calls, log and counters as one operation."""
    prompts = spark.createDataFrame([(k, k * 2) for k in "abcd"], "sample_id string, prompt string")
    log = str(tmp_path / "log")

    def make():
        def ask(prompt, json_mode):
            if prompt == "bb":
                raise RuntimeError("no")
            return 'Here: {"predicted_next_goal": "%s"}' % prompt

        return ask

    assert run_samples(prompts, log, make, attempts=2, wanted=["a", "b"]) == {"processed": 1, "skipped": 0, "failed": 1}
    assert run_samples(prompts, log, make, most=3) == {"processed": 1, "skipped": 2, "failed": 0}
    assert run_samples(prompts, log, make, dry_run=True) == {"processed": 1, "skipped": 3, "failed": 0}
    assert run_samples(prompts, log, make, most=-1) == {"processed": 0, "skipped": 0, "failed": 0}
    assert run_samples(prompts, log, make, wanted=["a"], overwrite=True) == {"processed": 1, "skipped": 0, "failed": 0}
    rows = resultlog.last_results(readers.json_lines(spark, log))
    got = {r.sample_id: (r.s, r.p) for r in rows.select("sample_id", F.try_variant_get("row", "$.status", "string").alias("s"), F.try_variant_get("row", "$.prediction", "string").alias("p")).collect()}
    assert got == {"a": ("ok", '{"predicted_next_goal":"aa"}'), "b": ("error", None), "c": ("ok", '{"predicted_next_goal":"cc"}'), "d": ("dry_run", None)}


def test_evaluation_artifacts(spark, tmp_path):
    columns = "sample_id string, paper_name string, prefix_length int, segmentation_mode string, completion boolean, structure_score double, needs_review boolean"
    scores = spark.createDataFrame([("a", "p", 1, "m", True, 0.5, True), ("b", None, 10, "m", False, None, False)], columns)
    report.write_evaluation(scores, scores.select("sample_id"), {"run": "x"}, str(tmp_path))
    made = sorted(p.name for p in tmp_path.iterdir())
    assert made == ["config.json", "goal_judge_runs.jsonl", "review_queue.jsonl", "sample_scores.jsonl", "summary.json", "summary_by_paper_name.csv", "summary_by_prefix_length.csv", "summary_by_segmentation_mode.csv"]
    whole = json.loads("".join(f.read_text() for f in (tmp_path / "summary.json").glob("part*")))
    assert whole["run"] == "x" and whole["aggregate"]["sample_count"] == 2 and whole["aggregate"]["completion_rate"] == 0.5 and whole["aggregate"]["structure_score"] == 0.5
    groups = [r.paper_name for r in summaries.summary(scores, "paper_name").collect()]
    assert groups == ["None", "p"] and [r.prefix_length for r in summaries.summary(scores, "prefix_length").collect()] == ["1", "10"]
    assert tuple(summaries.summary(scores.limit(0)).select("sample_count", "completion_rate", "goal_judge_ok_rate", "structure_score").first()) == (0, 0.0, None, None)


def test_pending_and_manifest(spark):
    samples = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    log = spark.createDataFrame([("a", "error")], "sample_id string, status string")
    assert [r.sample_id for r in resultlog.pending(samples, log).collect()] == ["b"] and resultlog.pending(samples, log, overwrite=True).count() == 2
    with pytest.raises(Exception, match="no manifest row for b"):
        resultlog.checked_join(samples, log, "sample_id").collect()


def test_checks_hold_whatever_is_read(spark):
    records = spark.createDataFrame([("a", 1), ("b", 2)], "sample_id string, v int")
    manifest = spark.createDataFrame([("a", "case")], "sample_id string, title string")
    joined = resultlog.checked_join(records, manifest, "sample_id")
    reads = [lambda: joined.count(), lambda: joined.select("v").collect(), lambda: joined.select("title").distinct().count(), lambda: joined.agg({"v": "sum"}).collect(), lambda: joined.select("sample_id").collect(), lambda: joined.where("title is null or v > 0").count()]
    for read in reads:
        with pytest.raises(Exception, match="no manifest row for b"):
            read()
    assert resultlog.checked_join(records.where("v = 1"), manifest, "sample_id").count() == 1
    pairs = frames.matched_rows(records, manifest.withColumn("v", F.lit(1)), ["sample_id", "v"], "no pair ")
    with pytest.raises(Exception, match=r'no pair \{"sample_id":"b","v":2\}'):
        pairs.count()


def test_lines_of_several_files_keep_their_order(spark, tmp_path):
    """The last row wins by file and line, though a long file's parts are read before a short one's."""
    for name, rows in (("a", 1), ("b", 4000), ("c", 3)):
        lines = [f'{{"sample_id": "s", "n": "{name}{k}"}}' for k in range(rows)]
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = resultlog.last_results(readers.json_lines(spark, str(tmp_path))).select(F.try_variant_get("row", "$.n", "string").alias("n")).collect()
        only = resultlog.last_results(readers.json_lines(spark, str(tmp_path / "b.jsonl"))).select(F.try_variant_get("row", "$.n", "string").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.n for r in got] == ["c2"] and [r.n for r in only] == ["b3999"]


def put(folder, name, rows):
    (folder / f"{name}.json").write_text("\n".join(json.dumps({"line_no": k, "value": v}) for k, v in rows))


@pytest.mark.parametrize("cut", [1, 2, 5])
def test_last_rows_after_any_cut(spark, tmp_path, cut):
    """A log in one to five files, in any order of lines, with a stop and a start from the checkpoint after each file."""
    import random

    rng = random.Random(cut)
    log = [(k, json.dumps({"sample_id": f"s{rng.randrange(6)}", "status": rng.choice(["ok", "error"]), "k": k})) for k in range(60)]
    log += [(60, "broken"), (61, '{"sample_id": 5}'), (62, "[1]"), (63, "")]
    dealt = rng.sample(log, len(log))
    folder = tmp_path / "in"
    folder.mkdir()
    own = lastwins.stateful(spark)
    for n in range(cut):
        put(folder, n, dealt[n::cut])
        lines = own.readStream.schema("line_no long, value string").json(str(folder))
        lastwins.followed(lastwins.named_rows(lines), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination(120)
    put(folder, "again", dealt[:20])  # delivered twice: no row changes
    lines = own.readStream.schema("line_no long, value string").json(str(folder))
    lastwins.followed(lastwins.named_rows(lines), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination(120)
    whole = spark.createDataFrame(log, "line_no long, value string")
    want = {r.sample_id: (r.line_no, r.s) for r in resultlog.last_results(whole).select("sample_id", "line_no", F.try_variant_get("row", "$.status", "string").alias("s")).collect()}
    held = lastwins.states(own, str(tmp_path / "ck")).collect()
    assert {r.sample_id: (r.place, r.status) for r in held} == want
    told = spark.read.json(str(tmp_path / "log")).collect()
    assert sum(r.n_replaced for r in held) == sum(1 for r in told if r.change == "replaced") and sum(1 for r in told if r.change == "new") == len(want)
    chain = {(r.sample_id, r.replaced) for r in told if r.change == "replaced"}
    assert chain <= {(r.sample_id, r.place) for r in told}  # each replaced row was told before


def test_settled_samples_are_told(spark, tmp_path):
    import time

    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, 0, [(1, '{"sample_id": "a", "status": "ok"}')])
    own = lastwins.stateful(spark)
    lines = own.readStream.schema("line_no long, value string").json(str(folder))
    query = lastwins.followed(lastwins.named_rows(lines), str(tmp_path / "log"), str(tmp_path / "ck"), quiet=0.5)
    told: set = set()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if any((tmp_path / "log").glob("part-*")):
                told = {(r.sample_id, r.place, r.change) for r in spark.read.schema(lastwins.CHANGE).json(str(tmp_path / "log")).collect()}
            if ("a", 1, "settled") in told:
                break
    finally:
        query.stop()
    assert told == {("a", 1, "new"), ("a", 1, "settled")}


def test_counters_come_with_the_rows(spark, tmp_path):
    path = tmp_path / "log.jsonl"
    path.write_text('{"sample_id": "a", "status": "error"}\n\n   \nbroken\n[1]\n{"sample_id": 5}\n{"status": "ok"}\n{"sample_id": "a", "status": "ok"}\n{"sample_id": "b", "n": null}\n')
    rows, counters = resultlog.observed_results(readers.json_lines(spark, str(path)))
    # a job for the rows and none for the counters; jobs are numbered
    ran = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    got = rows.select("sample_id", F.try_variant_get("row", "$.status", "string").alias("s")).collect()
    before = ran()
    assert rows._jdf.queryExecution().executedPlan().toString().count("Scan text") == 1
    assert sorted(got) == [("a", "ok"), ("b", None)]
    assert tuple(counters().values()) == (2, 2, 1, 5) and ran() == before
    assert list(counters()) == resultlog.log_counters(readers.json_lines(spark, str(path))).columns


def test_retries():
    seen = []

    def flaky(prompt, json_mode):
        seen.append(json_mode)
        if len(seen) < 4:
            raise RuntimeError("no")
        return "yes"

    assert answered(flaky, "p", 5) == ("ok", 2, "yes", None) and seen == [True, False, True, False]
    assert answered(lambda p, j: 1 / 0, "p", 3)[:3] == ("error", 3, None)


def test_model_and_cache(spark):
    prompts = spark.createDataFrame([("a", "x"), ("b", "fail")], "sample_id string, prompt string")

    def make():
        def ask(prompt, json_mode):
            if prompt == "fail":
                raise ValueError("bad")
            return prompt * 2

        return ask

    got = {r.sample_id: (r.status, r.attempt_count, r.response, r.error) for r in run_model(prompts, make, attempts=2).collect()}
    assert got == {"a": ("ok", 1, "xx", None), "b": ("error", 2, None, "bad")}
    wanted = summaries.repeated(prompts.select("sample_id"), 0).selectExpr("sample_id", "repeat_index", "'m' judge_model", "'v' prompt_version")
    cache = spark.createDataFrame([("a", 1, "m", "v", "j"), ("b", 1, "m", "old", "j")], "sample_id string, repeat_index int, judge_model string, prompt_version string, judgment string")
    assert [r.sample_id for r in cache_misses(wanted, cache).collect()] == ["b"]
    urls = data_urls(spark.createDataFrame([("/a.JPG", bytearray(b"x")), ("/b", bytearray(b"y"))], "path string, content binary")).collect()
    assert [u.data_url for u in urls] == ["data:image/jpeg;base64,eA==", "data:image/png;base64,eQ=="]


def test_judge_statuses(spark):
    rows = [("a", 1, "ok", 4), ("a", 2, "cached", 2), ("b", 1, "error", None), ("b", 2, "ok", 0), ("c", 1, "judge_not_configured", None), ("c", 2, "judge_not_configured", None), ("d", 1, "error", None), ("d", 2, "judge_not_configured", None), ("e", 1, "error", None)]
    df = spark.createDataFrame([(*r, f"{r[0]}{r[1]}") for r in rows], "sample_id string, repeat_index int, status string, judge_score int, rationale string")
    got = {r.sample_id: r for r in summaries.repeat_summary(df).collect()}
    assert {k: r.status for k, r in got.items()} == {"a": "multi_run_all_ok", "b": "multi_run_partial_ok", "c": "multi_run_not_configured", "d": "multi_run_all_error", "e": "error"}
    assert (got["a"].goal_score_mean, got["a"].goal_score_std, got["a"].goal_scores, got["a"].rationale) == (0.75, 0.25, [1.0, 0.5], "a1") and got["c"].goal_score_mean is None


def test_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.jsonl").write_text('{"sample_id": "a", "status": "ok"}\nbad\n{"sample_id": "a", "status": "error"}\n')
    go = lambda: stream.append_new(stream.result_stream(spark, str(folder)), str(tmp_path / "log"), str(tmp_path / "ck")).awaitTermination(60)
    go()
    (folder / "2.jsonl").write_text('{"sample_id": "a", "status": "ok"}\n{"sample_id": "b", "status": "ok"}\n')
    go()
    assert sorted(r.sample_id for r in spark.read.json(str(tmp_path / "log")).collect()) == ["a", "b"]
    q = stream.counters(stream.result_stream(spark, str(folder)), "seen", str(tmp_path / "ck2"))
    q.awaitTermination(60)
    assert dict(spark.table("seen").collect()) == {"ok": 3, "error": 1}
