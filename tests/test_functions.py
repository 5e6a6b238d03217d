import random
import re
import unicodedata

import pandas as pd
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from dossier.functions import arrays, geometry, jsonx, numbers, text
from dossier.operators import blocks, context, figures, ids, similar, tei, validation


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()[0]


@pytest.mark.parametrize("raw,want", [("  a \n b  c ", "a b c"), (None, ""), ("\x1c a\x1f", "a"), ("", "")])
def test_squeeze(spark, raw, want):
    assert one(spark, raw, "string", text.squeeze) == want


@pytest.mark.parametrize("raw,want", [("It's a  Test!", "its-a-test"), ("--", "fb"), (None, "fb"), ("É b", "b"), ("a’b", "ab")])
def test_slug(spark, raw, want):
    assert one(spark, raw, "string", lambda c: text.slug(c, F.lit("fb"))) == want


def test_compare_form(spark):
    raw = "ﬁne ​te—xt − ①"
    want = unicodedata.normalize("NFKC", raw).replace("​", "").replace("—", "-").replace("−", "-")
    assert one(spark, raw, "string", lambda c: text.compare_form(text.nfkc(c))) == want


@pytest.mark.parametrize(
    "caption,number,start,flags",
    [
        ("Fig. 3: a long enough caption", 3, 0, []),
        ("see FIGURE 3. text that is long", 3, 4, ["caption_prefix_unexpected"]),
        ("Figure 2: with another number", 3, None, ["caption_number_mismatch"]),
        ("figure 3: x fig. 3: y", 3, 12, ["caption_too_short"][:0]),
        ("", 3, None, ["empty_caption"]),
        ("Fig. 3: Introduction", 3, 0, ["caption_contains_body_text"]),
        ("Fig 3: x", None, None, ["caption_too_short"]),
    ],
)
def test_captions(spark, caption, number, start, flags):
    df = spark.createDataFrame([(caption, number)], "c string, n long")
    r = df.select(text.caption_start("c", "n").alias("s"), text.caption_flags("c", "n").alias("f")).first()
    assert r.s == start and r.f == flags


@pytest.mark.parametrize("own,number,other,want", [("see Fig. 2: x", 2, "", "Fig. 2: x"), ("bad", 2, "Fig. 2: good caption here", "Fig. 2: good caption here"), ("", None, "Fig. 1: x", ""), ("", 2, "none", "none"), ("plain text here, long", 2, "other text, also long", "plain text here, long")])
def test_backfill(spark, own, number, other, want):
    df = spark.createDataFrame([(own, number, other)], "c string, n long, o string")
    assert df.select(text.backfilled("c", "n", "o")).first()[0] == want


def test_merge(spark):
    assert one(spark, ["Fig. 1: A b", "Fig. 1: A b", "a B", "c", "", "C d"], "array<string>", text.merged_captions) == "Fig. 1: A b c C d"
    assert one(spark, [], "array<string>", text.merged_captions) == ""


def test_abstract(spark):
    body = "Title\n\nAbstract — We study things of some length here.\nMore of it.\n\n\n\nKeywords: a, b\nIntroduction"
    assert one(spark, body, "string", text.abstract) == "We study things of some length here. More of it."
    assert one(spark, "Abstract: short", "string", text.abstract) is None and one(spark, "nothing", "string", text.abstract) is None
    # the list's order decides, not the place: 'introduction' stands behind 'related work' in the list's favour
    assert one(spark, "abstract: text of enough length\nRelated work\nthen more\nIntroduction\nx", "string", text.abstract) == "text of enough length Related work then more"


ENDS = (
    r"\bkeywords?\b", r"\bkey\s*words?\b", r"\bindex\b", r"\bindex\s*terms?\b", r"\bindexing\s*terms?\b", r"\bintroduction\b", r"\bbackground\b",
    r"\brelated\s+work\b", r"^\s*1\s*[\.\)]\s*", r"^\s*i\s*[\.\)]\s*", r"^\s*section\s+1\b", r"^\s*chapter\s+1\b",
)


def brute_abstract(raw):
    """The rule line by line, as the reference has it."""
    tidy = re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+", " ", raw.replace("\r\n", "\n").replace("\r", "\n"))).strip()
    lines = tidy.split("\n")
    start = next((k for k, x in enumerate(lines) if re.search(r"\babstract\b", x.strip(), re.I)), None)
    if start is None:
        return None
    rest = re.sub(r"^\s*(abstract|摘要)\s*[:：\-—]*\s*", "", "\n".join(lines[start:]), flags=re.I)
    found = next((m for p in ENDS if (m := re.search(rf"(?m)^\s*{p}\b", rest, re.I))), None)
    out = re.sub(r"\s*\n\s*", " ", rest[: found.start()].strip() if found else rest.strip()).strip()
    return out if len(out) >= 20 else None


def test_abstract_queries_over_all_documents(spark, tmp_path):
    """Documents with words of the rule in their own text get rows, too, and the right ones."""
    from dossier.plans import catalog

    rng = random.Random(8)
    heads = ["Keywords: a", "key  words b", "Index", "index terms: x", "Indexing terms", "INTRODUCTION", " Background", "Related  work", "Related", "1. Start", " 1 ) Start", "i. one", "I) one", "1 . x"]
    heads += ["Section 1", "section 10", "Chapter 1 of", "keywordsy", "introductions", "a", "1.5 m", "in 1.", "sectioned", "", "\t", "\r\nIndex", "\r1.x", "Abstract", "abstract: again", "Abstractly", "x-abstract y"]
    heads += ["\u00a0index", "\u3000Introduction", "1.é", "keywordsé", "éabstract", "abstractß", "x\u2028index", "x\x85background", "x\x0bindex"]
    texts = [None, "", "abstract", "摘要：abstract of a text that is long enough", "Abstract"]
    for _ in range(600):
        body = ["Some words of a text.", rng.choice(["ABSTRACT — ", "Abstract:", " abstract\t-- of", "The abstract of", "摘要 abstract", ""]) + " what we did, at length, é 世界"]
        body += [rng.choice([*heads, "more of the text in a line"]) for _ in range(rng.randrange(6))] + ["The end of it"]
        texts.append("\n".join(body))
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def made(i, t):
        ends = ["", "\nIntroduction follows", "\n KEY  words: a", "\n1 . First\nIndex", "\ni) First\nBackground", "\nRelated\nwork", "\nSection 1 x"]
        return None if t is None else (t if i % 3 == 0 else f"Some title\nAbstract: {t}") + ends[i % 7]

    for name, own in (("abstract_finder", made), ("document_abstracts", lambda _, t: t)):
        got = {r.doc_id: r.abstract for r in catalog.queries()[name](spark, str(tmp_path)).collect()}
        want = {i: None if own(i, t) is None else brute_abstract(own(i, t)) for i, t in enumerate(texts)}
        assert {i: (texts[i], got.get(i, "no row"), w) for i, w in want.items() if got.get(i, "no row") != w} == {}
        assert len({w for w in want.values() if w}) > 200


def test_small_texts(spark):
    assert one(spark, " a |b|| ", "string", text.pipe_list) == ["a", "b"] and one(spark, None, "string", text.pipe_list) == []
    assert one(spark, " 12 ", "string", text.view_id) == "view-12" and one(spark, " v1\t", "string", text.view_id) == "v1"
    assert one(spark, "a b/é.x", "string", text.safe_name) == "a_b_é_x"
    assert one(spark, "ab-cd.ef", "string", text.initials) == "ace" and one(spark, "--", "string", text.initials) == "x"
    assert one(spark, '"view"： 1.7', "string", lambda c: text.labelled_score(c, "view")) == 1.0
    assert one(spark, "view 1", "string", lambda c: text.labelled_score(c, "view")) is None
    assert one(spark, bytearray(b"ab"), "binary", lambda c: text.data_url(c, F.lit(None).cast("string"))) == "data:image/png;base64,YWI="


def test_lists(spark):
    own = [" a", "A", "", None, "b ", "a"]
    assert one(spark, own, "array<string>", arrays.distinct_stripped) == ["a", "A", "b"] and one(spark, None, "array<string>", arrays.distinct_stripped) == []
    assert one(spark, own, "array<string>", arrays.distinct_ignoring_case) == ["a", "b"] and one(spark, [" "], "array<string>", arrays.distinct_ignoring_case) is None
    assert one(spark, [1, 2, 3], "array<int>", arrays.contiguous) and not one(spark, [1, 3], "array<int>", arrays.contiguous) and one(spark, [], "array<int>", arrays.contiguous)
    df = spark.createDataFrame([(["b", "a"], ["a", "c"])], "a array<string>, b array<string>")
    r = df.select(arrays.with_missing("a", "b").alias("x"), arrays.with_missing("a", "b", False).alias("y"), arrays.same_set("a", "b").alias("z")).first()
    assert (r.x, r.y, r.z) == (["b", "a", "c"], ["a", "b", "c"], False)


@pytest.mark.parametrize("p,g,m,want", [(0, 0, 0.0, (1, 1, 1)), (2, 0, 0.0, (0, 0, 0)), (2, 4, 2.0, (1, 0.5, 2 / 3)), (2, 2, 0.0, (0, 0, 0))])
def test_rates(spark, p, g, m, want):
    df = spark.createDataFrame([(p, g, m)], "p long, g long, m double").select(numbers.precision_of("m", "p", "g").alias("a"), numbers.recall_of("m", "p", "g").alias("b"))
    assert tuple(df.select("a", "b", numbers.f1("a", "b")).first()) == pytest.approx(want)


def test_nulls_in_rates(spark):
    df = spark.createDataFrame([(1, 0, None)], "a long, b long, n double")
    r = df.select(numbers.ratio("a", "b").alias("r"), numbers.share("a", "b").alias("s"), numbers.unit("n").alias("u"), numbers.next_move_score(F.lit(1.0), F.lit(1.0), "n").alias("m")).first()
    assert (r.r, r.s, r.u, r.m) == (None, 0.0, None, None)


# ---------------------------------------------------------------- JSON


@given(st.recursive(st.none() | st.booleans() | st.text(max_size=5) | st.integers(), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=6), st.text(st.sampled_from("ab\"' \\n"), max_size=8))
def test_balanced_finds_objects(value, before):
    import json

    whole = json.dumps({"k": value})
    assert jsonx.balanced(before + whole + " }{") == whole
    assert jsonx.balanced(whole[:-1]) is None


@pytest.mark.parametrize("raw,want", [('{"a": 1}', 1), ('"{\\"a\\": 2}"', 2), ("[1]", None), ("null", None), ('"x"', None), ("broken", None)])
def test_payload(spark, raw, want):
    assert one(spark, raw, "string", lambda c: F.try_variant_get(jsonx.payload(jsonx.parsed(c)), "$.a", "int")) == want


def test_json_keeps_nulls_and_characters(spark):
    assert one(spark, ("é", None), "struct<a: string, b: string>", jsonx.as_json) == '{"a":"é","b":null}'
    assert one(spark, [("a",), ("",), (None,), ("b",)], "array<struct<text: string>>", jsonx.text_parts) == "a\nb"


# ---------------------------------------------------------------- geometry and figures


def test_boxes_round_half_to_even(spark):
    box = spark.range(1).select(geometry.rect(F.lit(500), F.lit(250), F.lit(510), F.lit(750)).alias("b"))
    assert tuple(box.select(geometry.pixel_box(F.col("b"), F.lit(61).cast("long"), F.lit(202).cast("long"))).first()[0]) == (30, 50, 54, 152)


def brute_clusters(page, tolerance=14.0, least=600.0):
    made = []
    for kind, *r in sorted(page, key=lambda p: (p[2], p[1], p[3], p[4], p[0])):
        near = [k for k, (c, _) in enumerate(made) if min(c[2] + tolerance, r[2]) > max(c[0] - tolerance, r[0]) and min(c[3] + tolerance, r[3]) > max(c[1] - tolerance, r[1])]
        if not near:
            made.append(([*r], {kind}))
            continue
        group = [made[k] for k in near] + [([*r], {kind})]
        one_box = [min(g[0][0] for g in group), min(g[0][1] for g in group), max(g[0][2] for g in group), max(g[0][3] for g in group)]
        made[near[0]] = (one_box, set().union(*(g[1] for g in group)))
        made = [c for k, c in enumerate(made) if k not in near[1:]]
    return [(*c, ",".join(sorted(k))) for c, k in made if (c[2] - c[0]) * (c[3] - c[1]) >= least]


def test_clusters(spark):
    rng = random.Random(5)
    rows = [(p, rng.choice(["image", "text", "drawing"]), x := rng.uniform(0, 500), y := rng.uniform(0, 700), x + rng.uniform(5, 60), y + rng.uniform(5, 60)) for p in range(12) for _ in range(rng.randrange(1, 25))]
    got = figures.clusters(spark.createDataFrame(rows, "page long, kind string, x0 double, y0 double, x1 double, y1 double")).collect()
    for p in range(12):
        mine = [(r.x0, r.y0, r.x1, r.y1, r.kinds) for r in sorted(got, key=lambda r: r.cluster) if r.page == p]
        assert mine == brute_clusters([r[1:] for r in rows if r[0] == p])


def test_best_caption_fold(spark):
    """Against the fold in order: later captions win ties, other texts only if better."""
    rng, rows = random.Random(6), []
    for doc in range(40):
        for order in range(rng.randrange(1, 8)):
            rows.append((doc, order, rng.choice(["caption", "paragraph"]), rng.choice(["Fig. 1: ok text, long enough", "Fig. 1: Introduction and more", "Fig. 1: x", "Figure 1: another long enough text", "none"])))
    got = {r.doc: r.caption for r in figures.best_captions(spark.createDataFrame(rows, "doc long, order long, type string, text string")).collect()}

    def score(t):
        return ("Introduction" in t, ("Introduction" in t) + (len(t) < 15))

    want = {}
    for doc, _, kind, t in rows:
        if t != "none" and (doc not in want or score(t) < score(want[doc]) or (kind == "caption" and score(t) <= score(want[doc]))):
            want[doc] = t
    assert got == want


def test_manifests(spark):
    rows = [("a", 0, "f0", 0.9, "interface"), ("a", 1, "f1", 0.9, "interface"), ("b", 0, "f0", 0.3, "view"), ("c", 0, "f0", 0.2, "interface"), ("d", 0, "f0", 0.8, "interface"), ("d", 1, "f1", 0.4, "view")]
    df = spark.createDataFrame(rows, "doc string, pos long, fig_id string, interface double, primary_role string")
    got = {r.doc: (r.interface_figure, r.needs_manual_review) for r in figures.manifests(df).collect()}
    assert got == {"a": ("f0", True), "b": (None, True), "c": ("f0", False), "d": ("f0", False)}
    marked = df.withColumn("is_interface_figure", F.col("interface") > 0.85)
    assert {r.doc for r in figures.one_interface(marked, figures.manifests(df)).collect()} == {"a", "c", "d"}


def test_captions_below(spark):
    blocks_ = [(1, "Body text", 50.0, 210.0, 200.0, 220.0), (1, "Fig. 2: The label", 50.0, 230.0, 200.0, 240.0), (1, "and its rest", 50.0, 245.0, 200.0, 255.0), (1, "far away", 50.0, 330.0, 200.0, 335.0)]
    regions = [(1, 2, 40.0, 100.0, 220.0, 200.0, 792.0, 612.0)]
    got = figures.captions_below(spark.createDataFrame(blocks_, "page long, text string, x0 double, y0 double, x1 double, y1 double"), spark.createDataFrame(regions, "page long, number long, rx0 double, ry0 double, rx1 double, ry1 double, height double, width double"))
    assert got.first().caption == "Fig. 2: The label and its rest"


# ---------------------------------------------------------------- ids and validation


def test_unique_ids_avoid_taken_ones(spark):
    rows = [("s", "x", 1), ("s", "x", 2), ("s", "x-2", 3), ("s", "x", 4), ("t", "y", 1), ("t", "y", 2), ("u", "z-1", 1), ("u", "z-1", 2)]
    got = {(r.scope, r.pos): r.id for r in ids.unique_ids(spark.createDataFrame(rows, "scope string, base string, pos long")).collect()}
    want = {}
    for scope in "stu":
        seen = set()
        for s, base, pos in rows:
            if s == scope:
                name, k = base, 1
                while name in seen:
                    k += 1
                    name = f"{base}-{k}"
                seen.add(name)
                want[s, pos] = name
    assert got == want


@pytest.mark.parametrize("seed", range(6))
def test_unique_ids_in_turn(spark, seed):
    """Any order of bases that look like each other with one, two or three suffixes, against row by row."""
    rng = random.Random(seed)
    names = ["a", "a", "a", "a-2", "a-3", "a-2-2", "a-5", "a-12", "a-02", "a-1", "a-2-2-2", "b", "b-2", "-2", "", f"a-{10 ** 20}"]
    rows = [(scope, rng.choice(names[: rng.choice([4, 8, len(names)])]), pos) for scope in ("s", "t", "u") for pos in range(60)]
    got = {(r.scope, r.pos): r.id for r in ids.unique_ids(spark.createDataFrame(rows, "scope string, base string, pos long").repartition(3)).collect()}
    want, seen = {}, set()
    for scope, base, pos in rows:
        name, k = base, 1
        while (scope, name) in seen:
            k += 1
            name = f"{base}-{k}"
        seen.add((scope, name))
        want[scope, pos] = name
    assert got == want


def test_coordination_id(spark):
    import hashlib

    target = F.array(F.struct(F.lit("t-v").alias("view_id"), F.lit(None).cast("string").alias("subview_id")))
    got = spark.range(1).select(ids.coordination_id(F.lit("main-view"), F.lit("main-view.sub-a"), F.lit("brush-link"), target)).first()[0]
    assert got == "coord-mv-sa-bl-" + hashlib.md5(b"main-view|main-view.sub-a|brush-link|t-v:").hexdigest()[:6]


def test_registered_events(spark):
    q, h = "question", "hypothesis"
    rows = [("c", 0, q, None, "What now?", None), ("c", 1, q, "c.known", None, None), ("c", 2, q, "c.what-now", "again", None), ("c", 3, q, "other", None, None), ("c", 4, q, "other", "text", None), ("c", 5, q, "c.other", None, None), ("c", 6, q, None, "…", None)]
    rows += [("c", 7, h, None, "It grows", ["c.known", "c.other"]), ("c", 8, h, "c.it-grows", None, None), ("c", 9, h, None, "no", ["nobody"]), ("c", 10, h, "c.what-now", None, None), ("c", 11, h, "c.h0", None, None)]
    df = spark.createDataFrame(rows, "case_id string, pos long, kind string, ref string, text string, related array<string>")
    df = df.withColumn("known_questions", F.array(F.lit("c.known"))).withColumn("known_hypotheses", F.array(F.lit("c.h0")))
    got = validation.registered_events(df).orderBy("pos").collect()
    want = [("c.what-now", "created"), ("c.known", "known"), ("c.what-now", "known"), ("other", "violation"), ("c.other", "created"), ("c.other", "known"), ("c.question-4", "created")]
    want += [("c.it-grows", "created"), ("c.it-grows", "known"), (None, "violation"), ("c.what-now", "violation"), ("c.h0", "known")]
    assert [(r.item_id, r.outcome) for r in got] == want
    assert (got[0].status, got[7].status, got[7].inference_type, got[7].related_question_ids, got[1].status) == ("Open", "Proposed", "StrongInference", ["c.known", "c.other"], None)


def test_rules(spark):
    df = spark.createDataFrame([(1, "Introduce", None, ""), (2, "Refine", "q", None), (3, "Refine", None, None)], "id long, action string, ref string, text string")
    got = {(r.entity_id, r.rule) for r in validation.violations(df, F.col("id"), validation.event_rules()).collect()}
    assert got == {("1", "id_or_text"), ("1", "introduced_text"), ("3", "id_or_text")}


# ---------------------------------------------------------------- blocks and contexts


@pytest.mark.parametrize(
    "html,want",
    [
        ("<p>First <b>bold</b> and the rest of it</p>", [("paragraph", "First bold and the rest of it")]),
        ("<h2 class=x>A <em>t</em>itle</h2><ul><li>one<br/>two</li><li><p>inner</p></li></ul>tail", [("title", "A title"), ("paragraph", "one two"), ("paragraph", "inner")]),
        ("<p>unclosed <i>one<p>next <span>x</span></div>outside", [("paragraph", "unclosed one"), ("paragraph", "next x")]),
        ("<nav><li>no</li></nav><pre>no</pre><p>yes", [("paragraph", "yes")]),
        (None, []),
    ],
)
def test_blocks_hold_their_whole_text(spark, html, want):
    got = blocks.html_blocks(spark.createDataFrame([(1, html)], "id long, html string"), "id", "html").orderBy("pos").collect()
    assert [(r.type, r.text) for r in got] == want

TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><abstract><p>In the header</p></abstract></teiHeader><text><body><div><head>One <hi>title</hi></head><p>First.</p>
<figure><head>no</head><figDesc>Fig. 1: D</figDesc></figure><figure><head>Fig. 2</head> bare</figure></div><div><p>First.</p></div></body><back><p>gone</p></back></text></TEI>"""


def random_tei(rng, depth=4, in_p=False, in_abstract=False):
    """Any nesting but a paragraph in a paragraph and an abstract in an abstract, which count as a part there."""
    name = rng.choice(["div", "div", "head", "figure", "figDesc", "ref", "back", "list"] + ([] if in_p else ["p", "p", "t:p"]))
    attr = rng.choice(['' if in_abstract else ' type="abstract"', ' n="a>b"', "", ""]) if name == "div" else ""
    if rng.random() < 0.1:
        return f"<{name}{attr}/>"
    inside = in_p or name.endswith("p"), in_abstract or "abstract" in attr
    one = lambda: rng.choice([f" t{rng.randrange(99)} ", "&amp;x&#65;", "&lt;q&gt;", "<![CDATA[<p>]]>", "<!-- <p>no</p> -->", random_tei(rng, depth - 1, *inside) if depth else "e"])
    return f"<{name}{attr}>{''.join(one() for _ in range(rng.randrange(6)))}</{name}>"


def walked(xml):
    from xml.etree import ElementTree

    try:
        root = ElementTree.fromstring(xml)
    except ElementTree.ParseError as e:
        return [("error", str(e))]
    name = lambda e: e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""

    def pick(node, wanted, skip=()):
        """Descendants of a name, not inside a skipped one."""
        for child in node:
            if name(child) in skip:
                continue
            if name(child) == wanted:
                yield child
            yield from pick(child, wanted, skip)

    def flat(node, skip=()):
        inner = "".join(("" if name(c) in skip else flat(c, skip)) + (c.tail or "") for c in node)
        return (node.text or "") + inner

    out = []
    body = next((e for e in root.iter() if name(e) == "text"), None)
    fronts = [e for t in root.iter() if name(t) == "text" for e in t.iter() if name(e) == "div" and e.get("type") == "abstract"]
    teasers = []
    for nodes in (fronts, [e for h in root.iter() if name(h) == "teiHeader" for e in h.iter() if name(e) == "abstract"]):
        if not teasers:
            for node in nodes:
                paragraphs = list(pick(node, "p", ("figure",)))
                teasers += [flat(p) for p in paragraphs] if paragraphs else [flat(node, ("figure",))]
            teasers = [t for t in teasers if t.strip()]
    out += [("paragraph", t) for t in teasers]

    def walk(node):
        for child in node:
            kind = name(child)
            if kind == "p":
                out.append(("paragraph", flat(child)))
            elif kind == "figure":
                told = [flat(e) for e in child.iter() if name(e) == "figDesc"]
                out.append(("caption", " ".join(told) if told else flat(child)))
            elif kind != "back":
                if kind == "head":
                    out.append(("title", flat(child)))
                walk(child)

    if body is not None:
        walk(body)
    return out


def test_tei_against_a_tree_walk(spark):
    rng = random.Random(3)
    docs = []
    for i in range(150):
        texts = "".join(f"<text>{''.join(random_tei(rng) for _ in range(4))}</text>" for _ in range(rng.choice([0, 1, 1, 2])))
        docs.append((i, f'<?xml version="1.0"?><TEI xmlns="u" xmlns:t="u"><teiHeader><p>x</p><abstract>{random_tei(rng, 2, in_abstract=True)}</abstract></teiHeader>{texts}</TEI>'))
    got = {}
    for r in tei.tei_blocks(spark.createDataFrame(docs, "id long, xml string"), "id", "xml").orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.type, r.text))
    for i, xml in docs:
        want = [(k, " ".join(t.split())) for k, t in walked(xml)]
        assert got.get(i, []) == [w for w in want if w[1]], xml


def test_tei(spark):
    df = spark.createDataFrame([(1, TEI), (2, "<broken"), (3, None)], "id long, xml string")
    got = tei.tei_blocks(df, "id", "xml")
    own = blocks.numbered(blocks.deduplicated(got.where("id = 1"), "id"), "id").orderBy("order_index").collect()
    assert [(r.type, r.text) for r in own] == [("paragraph", "In the header"), ("title", "One title"), ("paragraph", "First."), ("caption", "Fig. 1: D"), ("caption", "Fig. 2 bare")]
    assert {r.type for r in got.where("id > 1").collect()} == {"error"}


def test_similar_pairs(spark):
    a = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog today"), (2, "something else entirely in here for once")], "i long, a string")
    b = spark.createDataFrame([(7, "the quick brown fox jumps over the lazy dog today!"), (8, "x")], "j long, b string")
    assert [(r.i, r.j) for r in similar.similar_pairs(a, b, "a", "b").collect()] == [(1, 7)]


def test_similar_pairs_are_all_pairs(spark):
    """Short texts, edits in the first words, an edited letter in every word or so, against all pairs by the reference's rule."""
    from difflib import SequenceMatcher

    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(3, 9))) for _ in range(60)]
    items = ["alpha beta gamma delta", "alpha", *(" ".join(rng.choices(words, k=rng.choice([1, 2, 5, 7, 30, 90]))) for _ in range(60))]
    lines = ["alpha beta gamma deltas", "alphas", "", None]
    for t in items:
        for every in (9, 14, 25, 40):
            lines.append("".join(rng.choice("xyz") if k % every == 1 else c for k, c in enumerate(t)))
        lines += [t, t + "!", "x" + t]
    a = spark.createDataFrame(list(enumerate(lines)), "i long, a string").repartition(3)
    b = spark.createDataFrame([*enumerate(items), (900, ""), (901, None)], "j long, b string")
    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    near = lambda x, y: abs(len(x) - len(y)) <= 0.25 * max(len(x), len(y))
    want = {(i, j) for i, x in enumerate(lines) if x for j, y in enumerate(items) if near(x, y) and ratio(x, y) >= 0.92}
    for bits in (26, 8):  # a bitmap that is full keeps nothing back
        got = [(r.i, r.j) for r in similar.similar_pairs(a, b, "a", "b", bits=bits).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert (0, 0) in want and len(want) > 200


@pytest.mark.parametrize("threshold", [0.65, 0.8, 0.92, 0.97])
def test_similar_pairs_at_any_threshold(spark, threshold):
    """Edits in every block of characters, insertions and deletions that shift what follows, texts of 1 to 7 words."""
    from difflib import SequenceMatcher

    rng = random.Random(int(threshold * 100))
    items = ["".join(rng.choice("ab cde") for _ in range(n)).strip() or "a" for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 11, 12, 17, 18, 23, 40, 41, 60, 100, 160) for _ in range(3)]
    lines = []
    for t in items:
        for share in (0.03, 0.08, 0.15, 0.3):
            own = list(t)
            for k in range(max(1, int(share * len(t)))):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.choice([0, 0, 1])] = [rng.choice("abxyz")] * rng.choice([0, 1, 1])
            lines.append("".join(own).strip())
    a, b = spark.createDataFrame(list(enumerate(lines)), "i long, a string"), spark.createDataFrame(list(enumerate(items)), "j long, b string")
    form = lambda t: re.sub(" +", " ", t)
    near = lambda x, y: abs(len(x) - len(y)) <= 0.25 * max(len(x), len(y))
    want = {(i, j) for i, x in enumerate(map(form, lines)) if x for j, y in enumerate(map(form, items)) if near(x, y) and SequenceMatcher(None, x, y).ratio() >= threshold}
    assert {(r.i, r.j) for r in similar.similar_pairs(a, b, "a", "b", threshold).collect()} == want and len(want) > 60


def test_similar_pairs_join_is_an_index(spark):
    """No side goes to all tasks as a whole, and no pair is made without a common key."""
    a = spark.createDataFrame([(1, "the quick brown fox jumps")], "i long, a string")
    plan = similar.similar_pairs(a, a.select(F.col("i").alias("j"), F.col("a").alias("b")), "a", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*key#\d+L = key#", plan) and "Cross" not in plan
    with pytest.raises(ValueError):
        similar.similar_pairs(a, a.withColumnRenamed("a", "b"), "a", "b", threshold=0.5)


def test_prefixes(spark):
    episodes = spark.createDataFrame([("c", 1, "a"), ("c", 2, "b")], "case_id string, episode int, v string")
    ask = lambda p: spark.createDataFrame([("s", "c", p)], "sample_id string, case_id string, prefix array<int>")
    assert [r.v for r in context.prefix_episodes(ask([2, 1]), episodes).orderBy("place").collect()] == ["b", "a"]
    with pytest.raises(Exception, match="no episode for"):
        context.prefix_episodes(ask([3]), episodes).collect()
    assert context.prefix_episodes(ask([3]), episodes, strict=False).count() == 0
    with pytest.raises(Exception, match="no row for"):
        context.first_match(episodes, spark.createDataFrame([("d",)], "case_id string"), ["case_id"], "episode").collect()
    assert one(spark, [5, 6], "array<int>", lambda c: F.array(context.nth(c, F.lit(2)), context.nth(c, F.lit(3)), context.nth(c, F.lit(0)))) == [6, None, None]


def test_alike_is_a_vector_function():
    assert blocks.alike.func(pd.Series(["abcd"]), pd.Series(["abcd"])).tolist() == [1.0]
