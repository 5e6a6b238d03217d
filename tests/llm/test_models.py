import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from dossier.llm.exchange import mixed
from dossier.llm.language_id import Centroids, gram_counts, identify, vectors
from dossier.llm.quality import Additive, NonNegative, prior_of, quality, risk_gradient
from dossier.llm.toxicity import Ftrl, toxicity
from dossier.llm.toxicity import fit as fit_ftrl

from .fixtures import docs, prose, texts


def learned():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


def split(rows, got):
    import zlib

    return {i: s for i, s in got.items() if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}


def test_quality_learns_from_positives_and_unlabelled(spark):
    rng, rows, labels = random.Random(6), [], []
    for i in range(600):
        good = rng.random() < 0.8
        body = prose(rng, rng.randrange(60, 200), 5000)
        rows.append((i, body if good else " ".join(w.upper() + "!!***" for w in body.split())))
        if rng.random() < 0.5:
            labels.append((i, int(good), 0))
    rows += [(9000, None), (9001, "")]
    table = spark.createDataFrame([*labels, (1, None, None), (777_777, 1, 0)], "doc_id long, quality int, toxic int")
    how = NonNegative(positives=300, unlabelled=500, steps=400)
    got = {r.doc_id: r for r in quality(docs(spark, rows), table, learned(), how=how).collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    held = split(rows, got)
    right = sum(r.predicted == int("!!" not in rows[i][1]) for i, r in held.items() if i < 600)
    assert right / sum(i < 600 for i in held) > 0.95
    # labels of bad documents are not read
    only = quality(docs(spark, rows), table.where("quality = 1"), learned(), how=how).collect()
    assert {r.doc_id: r.score for r in only} == {i: r.score for i, r in got.items()}


def test_prior_from_positives_and_unlabelled():
    rng = np.random.default_rng(3)
    for prior in (0.3, 0.6, 0.85):
        positive, n = rng.normal(0, 1, (4000, 3)), 8000
        mixed = np.where(rng.random((n, 1)) < prior, rng.normal(0, 1, (n, 3)), rng.normal(2.5, 1, (n, 3)))
        assert abs(prior_of(positive, mixed, NonNegative()) - prior) < 0.06


def plain_risk(weights, p, u, prior):
    """The two parts of the non-negative risk, row by row."""
    loss = lambda rows, sign: sum(math.log1p(math.exp(-sign * sum(weights[k] for k in row))) for row in rows) / len(rows)
    return prior * loss(p, 1), loss(u, -1) - prior * loss(p, -1)


def test_steps_of_the_non_negative_risk():
    """A step follows the risk's slope, and the other way where the negative part is below zero."""
    rng = np.random.default_rng(5)
    model = Additive(rng.normal(size=(60, 2)), 3)
    p, u = model.active(rng.normal(1, 1, (15, 2))), model.active(rng.normal(0, 1, (25, 2)))
    below = 0
    for prior in (0.2, 0.9):
        for scale in (0.1, 6):
            model.weights = rng.normal(0, scale, len(model.weights))
            own, negative = plain_risk(model.weights, p.tolist(), u.tolist(), prior)
            whole, below = (lambda parts: -parts[1]) if negative < 0 else sum, below + (negative < 0)
            slope = risk_gradient(model, p, u, prior)
            for k in range(len(model.weights)):
                up, down = model.weights.copy(), model.weights.copy()
                up[k], down[k] = up[k] + 1e-5, down[k] - 1e-5
                want = (whole(plain_risk(up, p.tolist(), u.tolist(), prior)) - whole(plain_risk(down, p.tolist(), u.tolist(), prior))) / 2e-5
                assert abs(slope[k] - want) < 1e-5
    assert below


def test_toxicity(spark):
    rng, rows, labels = random.Random(7), [], []
    for i in range(900):
        bad = rng.random() < 0.2
        words = prose(rng, rng.randrange(20, 80), 3000).split()
        if bad:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["vileword", "nastyword", "awfulword"]))
        rows.append((i, " ".join(words)))
        labels.append((i, None, int(bad)))
    rows += [(9000, None), (9001, ""), rows[5]]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity(docs(spark, rows), table, learned(), how=Ftrl(bits=16, l1=1.0)).collect()
    assert len(got) == len(rows)
    held = split(rows, {r.doc_id: r for r in got})
    wrong = [i for i, r in held.items() if i < 900 and r.predicted != labels[i][2]]
    assert len(wrong) / len(held) < 0.03
    assert {r.score for r in got if r.doc_id in (9000, 9001)} == {next(r.score for r in got if r.doc_id == 9000)}


def test_ftrl_against_a_plain_version():
    rng = random.Random(4)
    how = Ftrl(bits=6, alpha=0.5, beta=1.0, l1=0.4, l2=0.1, epochs=3)
    samples = [(np.array(sorted(rng.sample(range(64), rng.randrange(0, 9))), np.uint32), rng.randrange(2)) for _ in range(40)]
    z, n, order = [0.0] * 65, [0.0] * 65, np.random.default_rng(7)

    def weight(i):
        l1 = 0 if i == 64 else how.l1
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((how.beta + math.sqrt(n[i])) / how.alpha + how.l2)

    for _ in range(how.epochs):
        for k in order.permutation(40):
            features, label = samples[k]
            at = [*map(int, features), 64]
            w = [weight(i) for i in at]
            g = 1 / (1 + math.exp(-sum(w))) - label
            for i, own in zip(at, w, strict=True):
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / how.alpha * own
                n[i] += g * g
    kept, weights, bias = fit_ftrl(samples, how)
    want = {i: weight(i) for i in range(64) if weight(i)}
    assert kept.tolist() == sorted(want) and np.allclose(weights, [want[i] for i in sorted(want)]) and math.isclose(bias, weight(64))
    assert 0 < len(want) < 64


def plain_grams(text, dims):
    """Runs of one to three characters, other characters than letters as spaces; a run's middle stays a letter."""
    out, line = [0] * dims, [" ", *(c if c.isalpha() or ord(c) >= 0x3000 else " " for c in text.lower()), " "]
    for size, salt in ((1, 1), (2, 2), (3, 3)):
        for k in range(len(line) - size + 1):
            own = line[k : k + size]
            if (own[0] != " ") if size == 1 else (own[0] != " " or own[1] != " ") if size == 2 else (own[1] != " " and (own[0] != " " or own[2] != " ")):
                code = 0
                for c in own:
                    code = code * 0x110000 + ord(c)
                out[int(mixed(np.array([(code + (salt << 60)) % 2**64], np.uint64))[0]) % dims] += 1
    return out


def test_vectors_and_nearest_centroid():
    """Counts in blocks of any size, TF-IDF and cosines against plain loops."""
    rng = random.Random(6)
    texts_ = ["".join(rng.choice("abcé 日Z1.") for _ in range(rng.randrange(0, 50))) for _ in range(12)]
    for block in (1_000_000, 17):
        joined = gram_counts(texts_, 256, block=block)
        if block > 50:
            assert joined.astype(int).tolist() == [plain_grams(t, 256) for t in texts_]
    idf = np.array([rng.random() + 0.1 for _ in range(256)], np.float32)
    x = vectors(gram_counts(texts_, 256), idf)
    for t, row in zip(texts_, x, strict=True):
        weighted = [c * float(w) for c, w in zip(plain_grams(t, 256), idf, strict=True)]
        norm = math.sqrt(sum(v * v for v in weighted))
        assert np.allclose(row, [v / norm if norm else 0 for v in weighted], atol=1e-5)


@pytest.mark.parametrize("extra", ["x", "score", "label", "lang", "count", "place", "predicted"])
def test_long_texts_and_other_columns(spark, extra):
    """Models read whole texts, and columns named as theirs don't get in the way."""
    rng = random.Random(11)
    long = " ".join(prose(rng, 50, 3000) for _ in range(1500))
    rows = [(i, prose(rng, 60, 3000), "aa") for i in range(40)] + [(77, long, "aa"), (78, None, None), (79, "", "bb")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn(extra, F.lit("aa"))
    table = spark.createDataFrame([(i, i % 2, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    small = NonNegative(positives=20, unlabelled=40, steps=20)
    for got in (quality(frame, table, how=small), toxicity(frame, table, how=Ftrl(bits=12)), identify(frame, how=Centroids(dims=256, clusters=2))):
        assert sorted(r.doc_id for r in got.collect()) == sorted(i for i, *_ in rows)


def test_language(spark):
    rng = random.Random(8)
    parts = {"aa": ("ka", "lo", "mi", "tu"), "bb": ("schr", "eng", "ung", "heit"), "cc": ("ção", "nho", "lhe", "qua")}
    rows = []
    for i in range(400):
        lang = rng.choice(list(parts))
        rows.append((i, " ".join("".join(rng.choices(parts[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(5, 60))), lang))
    frame = spark.createDataFrame([*rows, (900, None, "aa"), (901, "", "aa"), (902, "12 34 !?", None), (903, "kalomitu kami", None), rows[3]], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(frame, learned(), Centroids(dims=1024, per_language=60, clusters=2)).collect()}
    held = split(rows, got)
    assert all(r.lang_pred == rows[i][2] for i, r in held.items() if i < 400)
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"] and got[900].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_nothing_to_learn_from(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = texts()
    assert {r.score for r in quality(docs(spark, rows), none).collect()} == {0.5}
    assert {r.score for r in toxicity(docs(spark, rows), none).collect()} == {0.0}
    assert {r.lang_pred for r in identify(docs(spark, rows).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    for df in (quality(docs(spark, []), none), toxicity(docs(spark, []), none), identify(docs(spark, []))):
        assert df.count() == 0


def test_an_id_is_learned_from_once(spark):
    """However often a document or a label occurs, one row of it comes to the driver, and the model stays the same."""
    from dossier.llm.quality import sampled
    from dossier.llm.toxicity import packed_features, training_sample

    rng = random.Random(12)
    rows = [(i, prose(rng, 60, 3000)) for i in range(60)]
    table = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(60)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    once = docs(spark, rows)
    hot = once.union(once.where("doc_id = 6").crossJoin(spark.range(10_000)).select(*once.columns))
    labels = table.union(table.where("doc_id = 6").crossJoin(spark.range(10_000)).select(*table.columns))
    assert len(sampled(hot.select("doc_id", "text"), table.select("doc_id"))) == 60
    assert len(packed_features(training_sample(hot, labels, "toxic", F.lit(True), 40), 12)) == 40
    small = NonNegative(positives=20, unlabelled=40, steps=20)
    for fitted in (lambda d, t: quality(d, t, how=small), lambda d, t: toxicity(d, t, how=Ftrl(bits=12))):
        many = {r.doc_id: r.score for r in fitted(hot, labels).collect()}
        assert many == {r.doc_id: r.score for r in fitted(once, table).collect()}


def test_nearest_ids_are_those_with_the_smallest_hashes(spark):
    from dossier.llm.common import nearest_ids

    df = spark.range(50_000).selectExpr("case when id % 3 = 0 then null else id % 20000 end as doc_id").repartition(3)
    want = df.where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id")).limit(300).collect()
    assert nearest_ids(df, 300).collect() == want
    assert nearest_ids(df, 10**6).count() == df.where("doc_id is not null").distinct().count()


@pytest.mark.parametrize("block", [2_048, 3])
def test_every_language_is_learned(spark, block):
    """Hundreds of values of lang, most of them with one document, in one block of centroids or in many."""
    rng = random.Random(9)
    letters = [chr(c) for c in range(0x4E00, 0x9000)]
    rows = [(i, "".join(rng.sample(letters, 40)), f"l{i % 120}" if i < 240 else f"rare{i}") for i in range(260)]
    rows += [(1000 + i, t, None) for i, t, _ in rows] + [rows[3], (2000, None, "l1"), (2001, "1 2", "l1"), (None, rows[0][1], None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = identify(frame, how=Centroids(dims=512, clusters=2, block=block)).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[1000 + i].lang_pred == lang for i, _, lang in rows[:260])
    assert by_id[2000].lang_pred == by_id[2001].lang_pred == "und" and by_id[None].lang_pred == "l0"


def test_counts_of_long_texts_keep_their_direction(spark):
    """A letter that occurs 200,000 times in a learned text counts as often."""
    rows = [(1, "a " * 200_000 + "b " * 60_000, "aa"), (2, "b " * 100, "bb"), (3, "a a a b", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in identify(frame, how=Centroids(dims=256)).collect()}
    assert got[1].lang_pred == "aa" and got[1].score > 0.99999
