"""Small documents with copies, near copies, shared passages, nulls, empty and long texts, repeated rows and clashing columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("chunk", T.StringType()),  # names that operators use inside
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("bucket", T.LongType()),
        T.StructField("payload", T.StringType()),
    ]
)


def prose(rng: random.Random, n: int, words: int = 400) -> str:
    pick = [f"w{rng.randrange(words)}{rng.choice('abcdefé')}" for _ in range(n)]
    return " ".join(w + ("\n" if rng.random() < 0.05 else "") for w in pick)


def texts(seed: int = 1) -> list[tuple[int | None, str | None]]:
    rng = random.Random(seed)
    rows: list[tuple[int | None, str | None]] = [(900, None), (901, ""), (902, " \n\t "), (903, "one"), (904, "one two three"), (905, "one two three"), (None, "no id " * 30)]
    passage, base = prose(rng, 90), prose(rng, 200)
    for i in range(20):
        rows.append((i, prose(rng, rng.randrange(5, 260))))
    for i in range(20, 30):
        rows.append((i, f"{prose(rng, 30)} {passage} {prose(rng, 30)}"))
    for i in range(30, 36):  # exact copies and copies with one word changed
        words = base.split(" ")
        if i % 2:
            words[rng.randrange(len(words))] = f"changed{i}"
        rows.append((i, " ".join(words)))
    rows.append((40, "again and again " * 120))
    rows.append((41, "ab" * 700))
    rows.append((42, prose(rng, 9000)))
    rows.append((43, f"long {rows[-1][1][5000:20000]} end"))
    rows += [rows[8], rows[8], (44, rows[9][1])]
    return rows


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([("x", i, t, "en", "s", None if t is None else len(t), 7, "y") for i, t in rows], SCHEMA).repartition(5)
