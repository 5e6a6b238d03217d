"""What the larger tables showed: ties of rounding, plans that grow faster than their input, shapes that are read once."""

import unicodedata

import duckdb
import pyarrow as pa
from pyspark.sql import functions as F

from dossier.functions import frames, numbers, text
from dossier.operators import figures, rules, validation
from dossier.plans import catalog
from dossier.streaming import lastwins


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*sorted(df.columns)).collect())


def sql_rows(sql, **tables):
    """The rows of a query's SQL over small tables given as files."""
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    out = con.sql(sql)
    return sorted(out.project(", ".join(f'"{c}"' for c in sorted(out.columns))).fetchall())


def test_half_even_in_doubles(spark):
    cents = list(range(35, 400_000, 70))
    want = dict(duckdb.sql(f"SELECT i, round_even(i / 100.0::DOUBLE / 7, 1) FROM (SELECT unnest({cents}) AS i)").fetchall())
    got = spark.createDataFrame([(i, i / 100.0) for i in cents], "i long, p double").select("i", numbers.half_even(F.col("p") / 7, 1)).collect()
    assert {i: v for i, v in got} == want


def test_reading_order_of_halves(spark, tmp_path):
    """11.55 / 7 prints as 1.6500000000000001 and 27.65 / 7 as 3.9499999999999997: halves all the same."""
    path = f"{tmp_path}/lineitem.parquet"
    lines = [(1, 1, 11.20, 0.1), (1, 2, 11.55, 0.0), (2, 1, 27.65, 0.1), (2, 2, 28.0, 0.0)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_extendedprice double, l_discount double").coalesce(1).write.parquet(path)
    got = rows_of(catalog.queries()["reading_order"](spark, str(tmp_path)))
    assert got == sql_rows(catalog.oracle_sql()["reading_order"], lineitem=f"{path}/*.parquet")


def told_plan(df, capsys):
    df.explain()
    return capsys.readouterr().out


def test_a_score_is_computed_once(spark, capsys):
    rows = spark.range(9).select((F.col("id") % 2).alias("k"), "id", F.col("id").cast("double").alias("x"))
    best = figures.best_of(rows.withColumn("score", F.log10(F.col("x") - 3)), "k", "score", "id")
    assert told_plan(best, capsys).count("LOG10(") == 1
    assert rows_of(best.select("id", "k")) == [(7, 1), (8, 0)]


def test_nfkc_by_slices(spark):
    texts = pa.array(["é" * 700_000, None, "", "plain", "①" * 10, "ﬁ" * 600_000, "a"])
    parts = list(text.slices(texts))
    assert pa.concat_arrays(parts).equals(texts) and [len(p) for p in parts] == [1, 4, 1, 1]
    assert list(text.slices(texts.slice(0, 0))) == []
    own = [("é ﬁ ①",), ("plain",), (None,), ("",), ("한글 " * 3,)]
    got = [r[0] for r in spark.createDataFrame(own, "t string").coalesce(1).select(text.nfkc("t")).collect()]
    assert got == [t if t is None else unicodedata.normalize("NFKC", t) for (t,) in own]


def test_more_input_means_more_partitions(spark, tmp_path):
    """A task's rows stay as many however large the files are; a sample's rows stay together."""
    spark.range(400_000).select((F.col("id") % 5000).alias("sample_id"), F.rand(1).alias("x")).coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    parts = lambda df: df.select(F.spark_partition_id().alias("p"), "sample_id")
    few, many = parts(frames.dealt(rows, "sample_id")), parts(frames.dealt(rows, "sample_id", 100_000))
    assert few.agg(F.count_distinct("p")).first()[0] <= 4 < 20 < many.agg(F.count_distinct("p")).first()[0]
    assert many.groupBy("sample_id").agg(F.count_distinct("p").alias("n")).where("n > 1").count() == 0
    assert frames.dealt(spark.range(3).withColumnRenamed("id", "sample_id"), "sample_id").count() == 3


def test_case_references_are_looked_up_in_their_row(spark, capsys):
    kind = "case_id string, questions array<struct<question_id: string>>, hypotheses array<struct<hypothesis_id: string, related_question_ids: array<string>>>, episodes array<struct<episode_id: string, steps: array<struct<step_id: string, questions_addressed: array<string>>>, transitions: array<struct<source_step_id: string, target_step_id: string>>>>"
    one = ("c", [("q",), (None,)], [("h", ["q", "z", "z"])], [("e", [("s", ["q", None])], [("s", "t")]), (None, [("t", ["r"])], [("t", "t")])])
    got = validation.unknown_case_references(spark.createDataFrame([one, ("d", None, None, None)], kind))
    assert "Exchange" not in told_plan(got, capsys)
    want = [("h", "unknown question", "related_questions: z")] * 2 + [("s", "unknown question", "questions_addressed"), ("t", "unknown question", "questions_addressed: r"), ("e", "unknown step of episode", "target_step: t")]
    want += [(None, "unknown step of episode", "source_step: t"), (None, "unknown step of episode", "target_step: t")]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_parts_of_records_meet_without_another_shuffle(spark, capsys):
    told = told_plan(catalog.queries()["benchmark_records"](spark, "/root/testdata/sf0.001"), capsys)
    assert "hashpartitioning(key#" in told and not any(f"hashpartitioning({c}" in told for c in ("benchmark_case_id", "paper_name", "sample_id"))


def test_a_line_is_read_and_checked_once(spark, capsys):
    told = told_plan(catalog.queries()["record_violations"](spark, "/root/testdata/sf0.001"), capsys)
    assert told.count("VariantExpressionEvalUtils.parseJson") == 1


def test_lists_of_structs_are_read_as_such(spark):
    """Nothing, null and something else in place of lists and structs, at every depth; names that make no type or differ in case."""
    F_, I_, T_ = rules.Fields, rules.Items, rules.Text
    part = F_({"in": F_({"x": T_("^a$")}, required=False), "list": I_(F_({"y": T_()}), least=1, required=False), "tags": I_(T_(), required=False)})
    rule = F_({"parts": I_(part), "odd name": F_({"z": T_()}), "two": F_({"k": rules.Whole(), "K": rules.Whole()}, required=False), "any": F_({})})
    assert rules.kind_of(rule) == "variant" and rules.kind_of(I_(part)).startswith("array<struct<`in`: struct<`x`: variant>, `list`: array<struct<")
    good = '"odd name": {"z": ""}, "two": {"k": 1, "K": 2}, "any": {}'
    lines = {
        '{"parts": [{}, {"in": null, "list": null, "tags": null}, {"in": {"x": "a", "w": 1}, "list": [{"y": ""}], "tags": ["", "b"]}], %s}' % good: [],
        '{"parts": [null, [], {"in": [], "list": {}, "tags": 1}, {"in": {"x": null}, "list": [], "tags": [1, null]}], %s}' % good: [
            ("$.parts[0]", "missing"), ("$.parts[1]", "type"), ("$.parts[2].in", "type"), ("$.parts[2].list", "type"), ("$.parts[2].tags", "type"),
            ("$.parts[3].in.x", "missing"), ("$.parts[3].list", "too_few"), ("$.parts[3].tags[0]", "type"), ("$.parts[3].tags[1]", "missing"),
        ],
        '{"parts": [{"list": [{"y": "s"}, "s", null, {"y": {}}], "in": {"x": "b"}}], "two": {"k": "1"}, "any": []}': [
            ("$.parts[0].in.x", "pattern"), ("$.parts[0].list[1]", "type"), ("$.parts[0].list[2]", "missing"), ("$.parts[0].list[3].y", "type"),
            ("$.odd name", "missing"), ("$.two.k", "type"), ("$.two.K", "missing"), ("$.any", "type"),
        ],
    }
    inner = F_({"whole": F_({"parts": I_(part)})})
    df = spark.createDataFrame([(v,) for v in lines], "value string")
    assert [[tuple(p) for p in r.problems] for r in rules.checked(df, rule).collect()] == list(lines.values())
    under = df.select(F.concat(F.lit('{"whole": '), "value", F.lit("}")).alias("value"))
    assert [[tuple(p) for p in r.problems] for r in rules.checked(under, inner).collect()] == [[("$.whole" + p[1:], r) for p, r in ps if p.startswith("$.parts")] for ps in lines.values()]
    odd = spark.createDataFrame([('{"whole": {"parts": 3}}',), ('{"whole": 1}',), ('{"whole": {}}',), ("{}",), ("7",)], "value string")
    assert [[tuple(p) for p in r.problems] for r in rules.checked(odd, inner).collect()] == [[("$.whole.parts", "type")], [("$.whole", "type")], [("$.whole.parts", "missing")], [("$.whole", "missing")], [("$", "type")]]


def test_results_are_parsed_once_and_lists_made_for_their_reader(spark, capsys):
    """The log's line is made once and parsed once; the manifest needs no lists, and records meet it without another shuffle."""
    told = told_plan(catalog.queries()["evaluated_samples"](spark, "/root/testdata/sf0.001"), capsys)
    assert told.count("VariantExpressionEvalUtils.parseJson(value") == 1 and told.count("collect_list(struct(pred,") == 4


def test_a_stream_takes_rows_as_they_are(spark, capsys, monkeypatch):
    """No frame for each sample: rows are read some at a time, each line is parsed once, and the state is read once."""
    lines = spark.createDataFrame([(1, '{"sample_id": "a", "status": "ok"}'), (2, '{"sample_id": 7}'), (3, "[]"), (4, "no"), (5, None)], "line_no long, value string")
    named = lastwins.named_rows(lines)
    assert told_plan(named, capsys).count("VariantExpressionEvalUtils.parseJson") == 1
    assert [tuple(r) for r in named.collect()] == [("a", 1, "ok", '{"sample_id": "a", "status": "ok"}')]

    class State:
        value = (5, "old", "v5", 3, 0)

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

    own = lastwins.LastRow(None)
    own.last = State()
    monkeypatch.setattr(lastwins, "SOME", 2)
    rows = iter([lastwins.Row(place=p, status="s", value=f"v{p}") for p in (7, 6, 4, 7, 9)])
    assert [tuple(r) for r in own.handleInputRows(("a",), rows, None)] == [("a", 6, "s", "v6", "replaced", 5), ("a", 7, "s", "v7", "replaced", 6), ("a", 9, "s", "v9", "replaced", 7)]
    assert own.last.value == (9, "s", "v9", 8, 3)
