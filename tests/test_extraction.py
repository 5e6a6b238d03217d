import datetime

import pytest
from pyspark.sql import functions as F

from dossier.functions.geometry import rect
from dossier.operators import extraction, figures


def boxed(df, name="box", prefix=""):
    return df.withColumn(name, rect(f"{prefix}x0", f"{prefix}y0", f"{prefix}x1", f"{prefix}y1"))


def test_tools_fail_by_row(spark):
    files = spark.createDataFrame([("a.pdf", bytearray(b"x")), ("b.pdf", bytearray(b""))], "path string, content binary")

    def make():
        def tool(content):
            if not content:
                raise ValueError("empty")
            return content.decode() * 2

        return tool

    assert {r.path: (r.text, r.error) for r in extraction.from_tool(files, make).collect()} == {"a.pdf": ("xx", None), "b.pdf": (None, "empty")}


def test_validated_lines(spark):
    rows = [("f", 0, '{"id": "a", "n": 1}'), ("f", 1, " "), ("f", 2, '{"id": "b"}')]
    lines = spark.createDataFrame(rows, "file string, line_no long, value string")
    assert [tuple(r) for r in extraction.validated_lines(lines, "id string, n int", ["id"]).collect()] == [("a", 1), ("b", None)]
    with pytest.raises(ValueError, match="bad line"):
        extraction.validated_lines(lines, "id string, n int", ["n"])


def test_picked_outputs(spark):
    rows = [("a", "/m/a.json"), ("a", "/m/z.json"), ("b", "/m/other.json"), ("c", "/m/x.json"), ("c", "/m/y.json")]
    got = {r.doc: (r.path, r.error) for r in extraction.picked_outputs(spark.createDataFrame(rows, "doc string, path string")).collect()}
    assert got == {"a": ("/m/a.json", None), "b": ("/m/other.json", None), "c": (None, "several outputs")}


def test_chosen_figures(spark):
    chosen = spark.createDataFrame([(d, f) for d, f in (("a", None), ("b", "f1"), ("c", "f1"), ("d", "f1"), ("e", "f1"))], "doc string, interface_figure string")
    rows = [("c", "f1", "", "x"), ("d", "f1", "p", ""), ("e", "f1", "p", "c")]
    got = {r.doc: r.status for r in extraction.chosen_figures(chosen, spark.createDataFrame(rows, "doc string, fig_id string, image_path string, caption string")).collect()}
    assert got == {"a": "none_selected", "b": "not_found", "c": "no_image_path", "d": "no_caption", "e": "ok"}


def test_primitives_and_blocks(spark):
    rows = [("drawing", 0.0, 0.0, 5.0, 5.0), ("drawing", 0.0, 0.0, 10.0, 0.1), ("drawing", 0.0, 0.0, 10.0, 1.0), ("image", 0.0, 0.0, 1.0, 1.0)]
    df = boxed(spark.createDataFrame(rows, "kind string, x0 double, y0 double, x1 double, y1 double"))
    assert extraction.visual_primitives(df).count() == 2
    blocks = boxed(spark.createDataFrame([(1, 0, "Title", 0.0, 0.0, 1.0, 1.0), (1, 1, "KEYWORDS: a", 0.0, 5.0, 1.0, 6.0), (1, 2, "Abstract", 0.0, 9.0, 1.0, 10.0)], "page long, pos long, text string, x0 double, y0 double, x1 double, y1 double"))
    assert extraction.first_block_with(blocks, ["abstract", "keywords"]).first().box.y0 == 5.0


def test_captions_at(spark):
    rows = [(1, "Fig. 2: a label", 60.0, 102.0, 90.0, 110.0), (1, "beside", 60.0, 112.0, 90.0, 118.0), (2, "no label", 50.0, 100.0, 90.0, 110.0), (2, "next", 50.0, 120.0, 90.0, 130.0), (2, "too far below", 50.0, 156.0, 90.0, 160.0), (3, "first one's text", 50.0, 90.0, 90.0, 99.0)]
    blocks = boxed(spark.createDataFrame(rows, "page long, text string, x0 double, y0 double, x1 double, y1 double"))
    anchors = boxed(spark.createDataFrame([(1, 2, 50.0, 100.0, 80.0, 110.0), (2, 3, 50.0, 100.0, 80.0, 110.0), (3, 1, 50.0, 100.0, 80.0, 110.0)], "page long, number long, x0 double, y0 double, x1 double, y1 double"), "anchor").select("page", "number", "anchor")
    got = {r.page: r.caption for r in extraction.captions_at(blocks.select("page", "text", "box"), anchors).collect()}
    assert got == {1: "Fig. 2: a label", 2: "no label next", 3: "first one's text"}


def test_exported(spark):
    kind = "struct<x0: double, y0: double, x1: double, y1: double>"
    rows = [
        ("d", 1, "Figure 1", "", (10.0, 10.0, 100.0, 100.0), (10.0, 95.0, 100.0, 120.0), "Fig. 1: from the text, long"),
        ("d", 2, "Fig/2", "Fig. 2: own caption here", (500.0, 10.0, 700.0, 100.0), None, None),
        ("d", 3, "Figure 3", "Fig. 3: no region at all", None, None, None),
        ("d", 4, "Figure 1", "Fig. 1: again, and longer", (0.0, 0.0, 9.0, 9.0), None, None),
    ]
    df = spark.createDataFrame(rows, f"doc string, index int, name string, caption string, region {kind}, caption_box {kind}, candidate string")
    got = extraction.exported(df, rect(F.lit(0), F.lit(0), F.lit(612), F.lit(792)))
    by = {r["index"]: r for r in got.collect()}
    assert tuple(by[1].box) == (2.0, 2.0, 108.0, 92.2) and by[1].caption == "Fig. 1: from the text, long" and by[1].file == "001_Figure_1.png"
    assert tuple(by[2].box) == (492.0, 2.0, 612.0, 108.0) and by[2].file == "002_Fig_2.png" and by[2].number == 2
    assert by[3].status == "missing_region_boundary" and by[3].box is None
    listed, images = extraction.captions_payload(got)
    assert [r.fig_id for r in listed.collect()] == ["fig_1", "fig_1", "fig_2"]
    assert {r.fig_id: r.source for r in images.collect()} == {"fig_1": "004_Figure_1.png", "fig_2": "002_Fig_2.png"}


def test_front_page_teaser(spark):
    kind = "struct<x0: double, y0: double, x1: double, y1: double>"
    rows = [((50.0, 150.0, 550.0, 300.0), "image"), ((50.0, 50.0, 550.0, 140.0), "image"), ((50.0, 600.0, 550.0, 700.0), "image"), ((50.0, 200.0, 80.0, 230.0), "drawing")]
    df = spark.createDataFrame(rows, f"b {kind}, kinds string")
    abstract = rect(F.lit(50), F.lit(320), F.lit(300), F.lit(340))
    got = [r[0] for r in df.select(figures.front_page_score(F.col("b"), F.col("kinds"), F.lit(145.0), abstract, F.lit(792.0))).collect()]
    assert got[0] == pytest.approx(20 + 15 + 20 + 25 - 20 / 3) and got[1] == pytest.approx(20 + 9 - 15 + 25 - 60) and got[2] is None and got[3] is None
    nothing = F.lit(None).cast(kind)
    assert df.select(figures.front_page_score(F.col("b"), F.col("kinds"), F.lit(145.0), nothing, F.lit(792.0))).first()[0] == pytest.approx(20 + 15 + 20 - abs(150 - 316.8) / 6)


def test_settings_and_names(spark):
    none = {"model": None, "api_key": None}
    assert extraction.resolved(none, {"MODEL": "m", "API_KEY": "k"}) == {"model": "m", "api_key": "k"}
    assert extraction.resolved({"model": "x", "api_key": "y"}, {}) == {"model": "x", "api_key": "y"}
    for given, env in (({"model": "x", "api_key": None}, {"API_KEY": "k"}), (none, {"MODEL": "m"})):
        with pytest.raises(ValueError):
            extraction.resolved(given, env)
    at = F.lit(datetime.datetime(2024, 5, 6, 7, 8, 9))
    assert spark.range(1).select(extraction.run_name("a/b", at)).first()[0] == "20240506T070809Z_a_b"


def test_messages_and_records(spark):
    df = spark.createDataFrame([("é", None, [("one", "data:x")])], "a string, b string, i array<struct<label: string, data_url: string>>")
    got = df.select(extraction.messages("Judge.", F.struct("a", "b"), F.col("i"))).first()[0]
    assert [(m.type, m.content) for m in got] == [("text", 'Judge.\n\nPayload:\n{"a":"é","b":null}'), ("text", "one"), ("image", "data:x")]
    with pytest.raises(Exception, match="image is missing"):
        df.withColumn("i", F.transform("i", lambda x: F.struct(x["label"].alias("label"), F.lit(None).cast("string").alias("data_url")))).select(extraction.messages("x", F.struct("a"), F.col("i"))).collect()
    hits = spark.createDataFrame([([(None, "t", None, None, None)],)], "h array<struct<paper_name: string, source_type: string, source_id: string, reason: string, score: float>>")
    assert tuple(hits.select(extraction.retrieval_payload(F.col("h"))).first()[0][0]) == ("", "t", "", "", 0.0)
    names, titles = spark.createDataFrame([("b",), ("a",)], "doc string"), spark.createDataFrame([("a", "A"), ("b", None)], "paper string, full_name string")
    assert [tuple(r) for r in extraction.index_rows(names, titles).collect()] == [("a", "A"), ("b", None)]
