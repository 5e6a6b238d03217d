import types

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from dossier.llm import common
from dossier.llm.exchange import chunked


def session(master, **conf):
    return types.SimpleNamespace(sparkContext=types.SimpleNamespace(master=master), conf=types.SimpleNamespace(get=lambda key, default=None: conf.get(key, default)))


def test_shared_folder():
    """The folder that the session names; without one only a session in one process has a place of its own."""
    named = {"spark.checkpoint.dir": "hdfs://x/c/", "spark.sql.warehouse.dir": "/w"}
    assert common.scratch_path(session("yarn", **named), "n").startswith("hdfs://x/c/n-")
    assert common.scratch_path(session("local[8]", **{"spark.sql.warehouse.dir": "/w"}), "n").startswith("/w/scratch/n-")
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://h:7077"):
        with pytest.raises(ValueError, match="checkpoint"):
            common.scratch_path(session(master, **{"spark.sql.warehouse.dir": "/w"}), "n")


def test_slices(monkeypatch):
    """Bounded by bytes, but never less than a row; nothing is lost, nulls and batches without rows included."""
    monkeypatch.setattr(common, "SLICE_BYTES", 10)
    texts = ["aaaa", None, "é" * 3, "b" * 40, "", "c", "d" * 9, "e"]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(len(t))), pa.array(t, pa.string())], ["doc_id", "text"]) for t in (texts, [], texts[:1])]
    parts = [p.column("text").to_pylist() for p in common.sliced(iter(batches))]
    assert [x for p in parts for x in p] == [*texts, "aaaa"]
    assert all(len(p) == 1 or sum(len((t or "").encode()) for t in p) <= 10 for p in parts) and len(parts) == 5


def test_equal_rows_are_dealt_to_many_chunks(spark, tmp_path):
    """However many rows are equal, they don't meet in one chunk, and every reading deals them alike."""
    rows = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("the same text").alias("text"))
    rows.write.parquet(str(tmp_path / "same"))
    for df in (rows, spark.read.parquet(str(tmp_path / "same"))):
        counts = chunked(df, 16).groupBy("chunk").count().collect()
        assert len(counts) == 16 and max(r["count"] for r in counts) < 400
    held = spark.read.parquet(str(tmp_path / "same"))
    assert {(r.chunk, r["count"]) for r in chunked(held, 16).groupBy("chunk").count().collect()} == {(r.chunk, r["count"]) for r in counts}


def test_session_options_stay(spark):
    before = {r.key: r.value for r in spark.sql("SET").collect()}
    from dossier.llm.simhash import near_duplicates
    from dossier.llm.substring_dedup import substring_dedup

    from .fixtures import docs

    for df in (substring_dedup(docs(spark)), near_duplicates(docs(spark))):
        df.count()
    assert {r.key: r.value for r in spark.sql("SET").collect()} == before
