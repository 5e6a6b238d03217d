"""Every registered query against its SQL, on the smallest tables."""

import datetime
import math
import os
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F

from dossier.functions.text import compare_form, nfkc
from dossier.plans import catalog

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    yield con
    con.close()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    return float(x) if isinstance(x, Decimal) else x.isoformat() if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_rows(spark, sql, name):
    got = catalog.queries()[name](spark, DATA)
    want = sql.sql(catalog.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    mine = sorted((tuple(plain(x) for x in r) for r in got.select(*columns).collect()), key=repr)
    theirs = sorted((tuple(plain(x) for x in r) for r in want.project(quoted).fetchall()), key=repr)
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs_without_sql(spark, name):
    assert catalog.queries()[name](spark, DATA).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_similar_passages_against_all_pairs(spark, sql):
    """Every pair of a line and an item whose ratio reaches the threshold, by comparing them all."""
    import re
    from difflib import SequenceMatcher

    got = {(r.doc_id, r.item_id): r.similarity for r in catalog.queries()["similar_passages"](spark, DATA).collect()}
    forms = dict(spark.createDataFrame([(t,) for t in sorted({t for (t,) in sql.sql("SELECT text FROM benchmark").fetchall()})], "t string").select("t", compare_form(nfkc(F.regexp_replace("t", "\n", " ")))).collect())
    items = [(i, forms[t], re.sub(r"^\S+", "Another", t.replace("\n", " "))) for i, t in sql.sql("SELECT item_id, text FROM benchmark").fetchall()]
    changed = dict(spark.createDataFrame([(t,) for _, _, t in items], "t string").select("t", compare_form(nfkc("t"))).collect())
    lines = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", F.explode(F.split("text", "\n")).alias("t")).where("t <> ''").distinct().select("doc_id", compare_form(nfkc("t")).alias("f")).collect()
    lines = [(r.doc_id, r.f) for r in lines] + [(-1 - i, changed[t]) for i, _, t in items]
    want = {}
    for item, form, _ in items:
        for doc, line in lines:
            m, n = len(line), len(form)
            if m and n and abs(m - n) <= 0.25 * max(m, n) and 2 * min(m, n) / (m + n) >= 0.92:
                ratio = SequenceMatcher(None, line, form).ratio()
                if ratio >= 0.92:
                    want[doc, item] = max(want.get((doc, item), 0), round(ratio, 6))
    assert got.keys() == want.keys() and len(want) >= len(items) / 2
