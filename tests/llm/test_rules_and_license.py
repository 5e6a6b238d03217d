import random

import pytest

from dossier.llm import license_scan as license_module
from dossier.llm.license_scan import NOTICES, chance, held, license_scan, signed_size, window_size
from dossier.llm.quality_rules import Bands, filtered, quality_rules

from .fixtures import docs, prose, texts


def brute_rules(text):
    words = (text or "").encode().split()
    raw = (text or "").encode()
    grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    cover = set()
    for k, g in enumerate(grams):
        if grams.count(g) > 1:
            cover |= {k, k + 1, k + 2}
    lines = [x for x in raw.split(b"\n") if x.split()]
    n = len(words)
    dup = sum(1 for k, x in enumerate(lines) if x in lines[:k])
    return n, sum(len(w.decode()) for w in words), sum(raw.count(bytes([c])) for c in b"#*$%&|<>"), dup, len(cover), n < 50 or 100 * len(cover) > 50 * n


def test_quality_rules(spark):
    rows = [r for r in texts() if r[0] != 42] + [(70, "a b c\na b c\n\n \nx #*$%&|<> é"), (71, "line one\nline one\n" * 40)]
    got = quality_rules(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = {i: brute_rules(t) for i, t in rows}
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_bands(spark):
    rng = random.Random(3)
    noise = " ".join("".join(chr(rng.randrange(33, 127)) for _ in range(9)) for _ in range(900))
    loop = " ".join(f"{w} {k % 7}" for k in range(900) for w in ("alpha", "beta", "gamma", f"d{k}"))
    rows = [(1, prose(rng, 400)), (2, noise), (3, loop)]
    got = {r.doc_id: r for r in quality_rules(docs(spark, rows), Bands(limits=((None, 1.4, 4.0),))).collect()}
    assert got[1].kept and got[2].reason == "incompressible" and got[3].reason in ("repetitive", "repeated_words")
    kept = filtered(docs(spark, rows), Bands(limits=((None, 1.4, 4.0),)))
    assert [r.doc_id for r in kept.collect()] == [1] and kept.columns == docs(spark, rows).columns
    assert quality_rules(docs(spark, [])).count() == 0 and filtered(docs(spark, [])).count() == 0


def test_chunks_reach_the_end(spark):
    """Bytes behind the last whole chunk are judged, too, and the order of a text's halves doesn't matter."""
    rng = random.Random(6)
    good = lambda n: prose(rng, n).encode("ascii", "replace").decode()[:n].ljust(n, "a")
    junk = lambda n: "".join(chr(rng.randrange(33, 127)) if k % 9 else " " for k in range(n))
    g, j, tail = good(4095), junk(4096), junk(4008)
    rows = [(1, g + j), (2, j + g), (3, good(4096) + j + tail), (4, good(4096)), (5, j + "a"), (6, good(4096) + j), (7, good(8192) + good(100))]
    bands = Bands(limits=((None, 1.3, 6.0),))
    got = {r.doc_id: r for r in quality_rules(docs(spark, rows), bands).collect()}
    assert {i: (r.n_chunks, r.n_bad_chunks) for i, r in got.items()} == {1: (2, 1), 2: (2, 1), 3: (3, 2), 4: (0, 0), 5: (2, 2), 6: (2, 1), 7: (3, 0)}
    only = Bands(limits=((4097, 1.3, 6.0), (None, 0.1, 9.0)))
    texts_ = {1: True, 2: True, 3: False, 5: False}
    got = {r.doc_id: r for r in quality_rules(docs(spark, rows), only).collect()}
    assert {i: got[i].reason != "bad_chunks" for i in texts_} == texts_
    kept = {r.doc_id for r in filtered(docs(spark, rows), only).collect()}
    assert kept == {i for i, r in got.items() if r.kept} and 3 not in kept


def words(text):
    out, w = [], ""
    for c in (text or "").lower() + " ":
        if c.isalpha() or c.isnumeric():
            w += c
        elif w:
            out.append(w)
            w = ""
    return out


def test_license_scan(spark):
    rng = random.Random(4)
    rows = [(i, f"{prose(rng, rng.randrange(0, 40))} {notice} {prose(rng, 20)}") for i, notice in enumerate(NOTICES.values())]
    rows += [(50, NOTICES["mit-grant"].replace("software", "program")), (51, None), (52, ""), (53, "released under the"), (54, prose(rng, 3000) + " " + NOTICES["mit"]), (54, "x"), (55, NOTICES["mit"] + " " + NOTICES["mit"])]
    for k, name in enumerate(("mit-text", "bsd-2-clause-text", "isc-text")):  # some words of a whole text changed
        changed = NOTICES[name].split(" ")
        for at in range(20, len(changed), 60):
            changed[at] = f"x{at}"
        rows.append((60 + k, f"{prose(rng, 77)} {' '.join(changed)} {prose(rng, 9)}"))
    rows.append((70, prose(rng, 30_000) + NOTICES["isc-text"] + prose(rng, 30_000)))
    got = {(r.doc_id, r.license): r.containment for r in license_scan(docs(spark, rows)).collect()}
    want = {}
    own = {k: {tuple(words(t)[j : j + 5]) for j in range(len(words(t)) - 4)} for k, t in NOTICES.items()}
    for i, t in rows:
        w = words(t)
        grams = [tuple(w[j : j + 5]) for j in range(len(w) - 4)]
        for k, g in own.items():
            size = window_size(len(g))
            best = max((len(g & set(grams[s : s + size])) / len(g) for s in range(0, len(grams), max(1, size // 4))), default=0)
            if best >= 0.8:
                want[i, k] = max(best, want.get((i, k), 0))
    assert got == want and len(want) > 15 and {i for i, _ in want} >= {54, 55, 60, 61, 62, 70}
    assert license_scan(docs(spark, [])).count() == 0 and license_scan(docs(spark, rows), templates={}).count() == 0


def test_bands_retrieve(spark, monkeypatch):
    """What no band finds is not found: with band values that no text has, there is nothing to verify."""
    rows = [(i, notice) for i, notice in enumerate(NOTICES.values())]
    assert license_scan(docs(spark, rows)).count() >= len(NOTICES)
    monkeypatch.setattr(license_module, "template_values", lambda *_: [1])
    assert license_scan(docs(spark, rows)).count() == 0


def test_short_templates_are_refused(spark):
    with pytest.raises(ValueError, match="short"):
        license_scan(docs(spark), templates={"short": "MIT License", "long": NOTICES["mit"]})


def test_chance_to_share_a_band():
    """Measured with random hashes, no less than the bound says, and high from eight shingles on."""
    rng = random.Random(9)
    for n in (5, 8, 13, 30, 60, 200):
        size, own = signed_size(n), min(n, held(signed_size(n)))
        left, met = -(-4 * own // 5), 0
        for _ in range(3000):
            both = [rng.getrandbits(64) for _ in range(left)]
            a, b = ([*both, *(rng.getrandbits(64) for _ in range(k - left))] for k in (own, size))
            least = [{h >> 60: h for h in sorted(x, reverse=True)} for x in (a, b)]
            met += any(least[1].get(k) == h for k, h in least[0].items())
        assert met / 3000 >= chance(n, 0.8, 16) - 0.002 and (n < 8 or chance(n, 0.8, 16) > 0.996)


def test_windows_hold_whole_templates():
    for n in range(1, 200):
        size = window_size(n)
        assert size - max(1, size // 4) + 1 >= n and (n <= 4 or n >= 3 * size / 8 - 1)
