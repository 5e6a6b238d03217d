import random
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
import zstandard
from tokenizers import Tokenizer

from dossier.llm.quality_rules import Bands, quality_rules

from .fixtures import docs, prose, texts
from .test_decontamination import brute as brute_hits
from .test_dedup import brute_groups
from .test_rules_and_license import brute_rules


def kept_by_bands(text):
    """The whole verdict of the quality rules, by their default bands."""
    bands, squeeze = Bands(), zstandard.ZstdCompressor(level=3).compress
    if text is None or brute_rules(text)[5]:
        return False
    raw = text.encode()
    low, high = bands.of(len(raw))
    # the last chunk ends with the text
    chunks = [raw[k : k + 4096] if k + 4096 <= len(raw) else raw[-4096:] for k in range(0, len(raw), 4096)] if len(raw) > 4096 else []
    lo, hi = bands.of(4096)
    bad = sum(not lo <= 4096 / len(squeeze(c)) <= hi for c in chunks)
    return low <= len(raw) / len(squeeze(raw)) <= high and bad <= 0.5 * len(chunks)


def expected(rows, bench):
    """(doc_id, text) after the first four stages, by hand."""
    rows, best = [(i, t) for i, t in rows if kept_by_bands(t)], {}
    for k, ((i, _), g) in enumerate(zip(rows, brute_groups(rows, 2), strict=True)):
        best[g] = min(best.get(g, (True, 1 << 70, k)), (i is None, i or 0, k))
    rows = [rows[k] for _, _, k in best.values()]
    owner, out = {}, []
    for i, t in rows:
        w = t.split()
        for k in range(len(w) - 12):
            g = tuple(w[k : k + 13])
            owner[g] = min(owner.get(g, 1 << 80), 1 << 70 if i is None else i)
    for i, t in rows:
        w = t.split()
        gone = set()
        for k in range(len(w) - 12):
            if owner[tuple(w[k : k + 13])] < (1 << 70 if i is None else i):
                gone |= set(range(k, k + 13))
        if not gone:
            out.append((i, t))
        elif len(gone) < len(w):
            out.append((i, " ".join(x for k, x in enumerate(w) if k not in gone)))
    hits = defaultdict(int)
    for i, _, n, _ in brute_hits(out, bench):
        hits[i] += n
    return sorted(((i, t) for i, t in out if not hits[i]), key=repr)


def test_pipeline(spark, tmp_path):
    rng, rows = random.Random(9), [r for r in texts() if r[0] != 42]
    rows += [(i, f"{prose(rng, 200)} {rows[10][1]} {prose(rng, 150)}") for i in range(200, 206)]
    bench = [(1, " ".join(rows[-1][1].split()[20:35])), (2, None)]
    docs(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    want = expected(rows, bench)
    assert len(want) > 15
    reader = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    lengths, total = defaultdict(int), defaultdict(int)
    for i, t in want:
        lengths[i] += len(reader.encode(t, add_special_tokens=False).ids) + 1
    for r in got:
        total[r.doc_id] += r.length
    assert total == lengths
    stage = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == list(corpus_pipeline.COLUMNS)
    assert sorted(((r.doc_id, r.text) for r in stage.collect()), key=repr) == want


def test_default_bands(spark):
    """`kept` of the registered query's bands, on texts of many lengths."""
    rng = random.Random(15)
    noise = "".join(chr(rng.randrange(33, 127)) if rng.random() < 0.8 else " " for _ in range(30_000))
    rows = [(i, prose(rng, n, 5000)) for i, n in enumerate((60, 200, 700, 2500, 9000))] + [(i + 10, noise[:n]) for i, n in enumerate((400, 5000, 30_000))]
    rows += [(i + 20, " ".join(f"{w} {k % 7}" for k in range(n) for w in ("alpha", "beta", "gamma", f"d{k}"))) for i, n in enumerate((30, 300, 3000))]
    rows += [(30, rows[3][1] + noise[:9000]), (31, noise[:3000] + rows[3][1]), (32, rows[2][1] + "\n" + "same line again\n" * 40), *texts()]
    got = {(r.doc_id, r.n_words): r.kept for r in quality_rules(docs(spark, rows)).collect()}
    assert got == {(i, len((t or "").split())): kept_by_bands(t) for i, t in rows}
    assert {got[i, len(t.split())] for i, t in rows[:14]} == {True, False}


def test_names():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert [n for n in names if n.startswith("op")] == sorted((n for n in names if n.startswith("op")), key=lambda n: int(n[2:].split("_")[0]))
    assert {f"op{k}_" for k in range(1, 14)} <= {n.split("_")[0] + "_" for n in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= set(names)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and got.columns[:3] == ["doc_id", "piece", "start"]


def test_stages_with_other_columns_and_a_long_text(spark, tmp_path):
    """Names that operators use inside, a text of some MB, rows without an id or a text: a stage returns the columns of documents."""
    rng = random.Random(17)
    long = prose(rng, 300_000, 90_000)
    rows = [(1, long), (2, prose(rng, 300, 5000)), (3, None), (None, prose(rng, 200, 5000)), (4, ""), (2, None)]
    names = ["row", "chunk", "bucket", "payload", "rest", "fp", "root", "first", "least", "u", "text0", "place", "item", "keep", "n", "spans"]
    frame = docs(spark, rows).drop("chunk", "bucket", "payload")
    for name in names:
        frame = frame.selectExpr("*", f"'x' as `{name}`")
    spark.createDataFrame([(1, " ".join(long.split()[-30:-5]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    counts = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, frame, str(tmp_path))
        assert got.columns == list(corpus_pipeline.COLUMNS)
        counts.append(sorted((r.doc_id for r in got.collect()), key=repr))
    assert [i for i in counts[0] if i != 1] == sorted((i for i, t in rows[1:] if kept_by_bands(t)), key=repr)
    # the rows without words are one group of near-duplicates, of which the smallest id stays
    assert counts[1] == [1, 2, 2, None] and counts[2] == [1, 2, 2, 3, 4, None] and counts[3] == [2, 2, 3, 4, None]
    packed = corpus_pipeline.STAGES[-1][1](spark, frame, str(tmp_path))
    assert packed.groupBy("doc_id").sum("length").count() == 5
