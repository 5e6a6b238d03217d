"""Typed text blocks of TEI documents, by a walk through their tags in the engine.

A document becomes a list of events: a tag opens, a tag closes, text. One fold over it collects the blocks of the body, another one
those of abstracts. Their states are what a walk of the tree has on its stack, so the work is one step for each event, and a document never
leaves its row. Whether a text is XML at all is asked of the engine's own XML parser.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import col, let, squeeze

TOKEN = r"""(?s)<!\[CDATA\[.*?\]\]>|<!--.*?-->|<\?.*?\?>|<![^>]*>|<(?:[^>"']|"[^"]*"|'[^']*')*>|[^<]+"""
EVENT = "array<struct<k: int, n: string, x: string>>"
#: Kinds of events: text, a tag opens, a tag closes; an opening tag's text is 'abstract' if its type is.
TEXT, OPEN, CLOSE = 0, 1, 2
EMPTY = "array<string>"
BLOCK = "array<struct<p: int, type: string, text: string>>"
#: Entities of XML itself; those with a number go through the engine's XPath.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"))


def event(kind: int, name: Column, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("k"), name.alias("n"), text.alias("x"))


def plain(text: Column) -> Column:
    """Text with its entities read."""
    own = text
    for entity, char in ENTITIES:
        own = F.replace(own, F.lit(entity), F.lit(char))
    numbered = F.xpath_string(F.concat(F.lit("<x>"), text, F.lit("</x>")), F.lit("/x"))
    return F.when(~F.contains(text, F.lit("&")), text).when(F.contains(text, F.lit("&#")), numbered).otherwise(own)


def events(xml: Column) -> Column:
    name = lambda t: F.regexp_extract(t, r"^</?(?:[^\s/>:]+:)?([^\s/>]+)", 1)
    kind = lambda t: F.when(t.rlike(r"""\stype\s*=\s*["']abstract["']"""), "abstract").otherwise("")
    none = F.lit("")

    def of(token: Column) -> Column:
        return (
            F.when(F.startswith(token, F.lit("<![CDATA[")), F.array(event(TEXT, none, F.substring(token, F.lit(10), F.length(token) - 12))))
            .when(token.rlike("^<[!?]"), F.array().cast(EVENT))
            .when(F.startswith(token, F.lit("</")), F.array(event(CLOSE, name(token), none)))
            .when(token.rlike("(?s)^<.*/>$"), F.array(event(OPEN, name(token), kind(token)), event(CLOSE, name(token), none)))
            .when(F.startswith(token, F.lit("<")), F.array(event(OPEN, name(token), kind(token))))
            .otherwise(F.array(event(TEXT, none, plain(token))))
        )

    return F.flatten(F.transform(F.regexp_extract_all(xml, F.lit(TOKEN), F.lit(0)), of))


class State:
    """A fold's state: named fields, and what a step makes of some of them."""

    def __init__(self, **start: Column) -> None:
        self.names, self.start = list(start), F.struct(*(c.alias(n) for n, c in start.items()))

    def put(self, held: Column, **new: Column) -> Column:
        return F.struct(*(new.get(n, held[n]).alias(n) for n in self.names))

    def chosen(self, held: Column, cases: list[tuple[Column, dict[str, Column]]]) -> Column:
        """What the first case that holds makes of the state."""
        out = held
        for when, new in reversed(cases):
            out = F.when(when, self.put(held, **new)).otherwise(out)
        return out




def body_blocks(own: Column) -> Column:
    """Blocks of the first text element in order: heads are titles, p paragraphs, figures captions (their descriptions, if they have any).
    What stands inside p and figure is their text; a head's blocks follow it; back matter is skipped."""
    zero, none = F.lit(0), F.lit("")
    # depths at which the text, a skipped part, a block and a description have opened, 0 for none; the text is -1 when it is over
    state = State(i=zero, depth=zero, inside=zero, skip=zero, block=zero, kind=none, at=zero, said=none, desc=zero, told=none, all=F.array().cast(EMPTY), heads=F.array().cast("array<struct<d: int, p: int, said: string>>"), out=F.array().cast(BLOCK))

    def step(s: Column, e: Column) -> Column:
        d, is_ = s["depth"] + 1, lambda *names: e["n"].isin(*names)
        walking = (s["inside"] > 0) & (s["skip"] == 0) & (s["block"] == 0)
        begun = {"block": d, "kind": F.when(is_("p"), "paragraph").otherwise("caption"), "at": s["i"], "said": none, "all": F.array().cast(EMPTY)}
        opened = [
            ((s["inside"] == 0) & is_("text"), {"inside": d}),
            (walking & is_("back"), {"skip": d}),
            (walking & is_("p", "figure"), begun),
            (walking & is_("head"), {"heads": F.array_append(s["heads"], F.struct(d.alias("d"), s["i"].alias("p"), none.alias("said")))}),
            ((s["block"] > 0) & (s["kind"] == "caption") & (s["desc"] == 0) & is_("figDesc"), {"desc": d, "told": none}),
            (F.lit(True), {}),
        ]
        more = lambda held, when: F.when(when, F.concat(held, e["x"])).otherwise(held)
        heard = {"said": more(s["said"], s["block"] > 0), "told": more(s["told"], s["desc"] > 0), "heads": F.transform(s["heads"], lambda h: F.struct(h["d"].alias("d"), h["p"].alias("p"), F.concat(h["said"], e["x"]).alias("said")))}
        now, top = s["depth"], F.get(s["heads"], F.size(s["heads"]) - 1)
        block = F.struct(s["at"].alias("p"), s["kind"].alias("type"), F.when(F.size(s["all"]) > 0, F.array_join(s["all"], " ")).otherwise(s["said"]).alias("text"))
        title = F.struct(top["p"].alias("p"), F.lit("title").alias("type"), top["said"].alias("text"))
        closed = [
            (s["desc"] == now, {"desc": zero, "all": F.array_append(s["all"], squeeze(s["told"]))}),
            (s["block"] == now, {"block": zero, "out": F.array_append(s["out"], block)}),
            (F.coalesce(top["d"] == now, F.lit(False)), {"heads": F.slice(s["heads"], 1, F.size(s["heads"]) - 1), "out": F.array_append(s["out"], title)}),
            (s["skip"] == now, {"skip": zero}),
            (s["inside"] == now, {"inside": F.lit(-1)}),
            (F.lit(True), {}),
        ]
        next_ = {"i": s["i"] + 1}
        cases = [((e["k"] == TEXT), heard | next_)]
        cases += [((e["k"] == OPEN) & when, new | next_ | {"depth": d}) for when, new in opened]
        cases += [((e["k"] == CLOSE) & when, new | next_ | {"depth": now - 1}) for when, new in closed]
        return state.chosen(s, cases)

    return F.sort_array(F.aggregate(own, state.start, step, lambda s: s["out"]))


def abstract_texts(own: Column) -> Column:
    """Texts of abstracts, those in the text before those in the header: their paragraphs outside figures, or all that they say outside
    figures. Only if the text has none, those of the header count."""
    zero, none, empty = F.lit(0), F.lit(""), F.array().cast(EMPTY)
    state = State(depth=zero, text=zero, header=zero, node=zero, figure=zero, p=zero, said=none, told=none, all=empty, body=empty, head=empty)

    def step(s: Column, e: Column) -> Column:
        d, is_ = s["depth"] + 1, lambda name: e["n"] == name
        first = lambda field, name: F.when((s[field] == 0) & is_(name), d).otherwise(s[field])
        starts = ((s["text"] > 0) & is_("div") & (e["x"] == "abstract")) | ((s["header"] > 0) & is_("abstract"))
        opened = [
            ((s["node"] == 0) & starts, {"node": d, "said": none, "all": empty}),
            ((s["node"] > 0) & (s["figure"] == 0) & is_("figure"), {"figure": d}),
            ((s["node"] > 0) & (s["figure"] == 0) & (s["p"] == 0) & is_("p"), {"p": d, "told": none}),
            (F.lit(True), {"text": first("text", "text"), "header": first("header", "teiHeader")}),
        ]
        heard = {"said": F.when((s["node"] > 0) & (s["figure"] == 0), F.concat(s["said"], e["x"])).otherwise(s["said"]), "told": F.when(s["p"] > 0, F.concat(s["told"], e["x"])).otherwise(s["told"])}
        now = s["depth"]
        texts = F.filter(F.transform(F.when(F.size(s["all"]) > 0, s["all"]).otherwise(F.array(s["said"])), squeeze), lambda t: t != "")
        closed = [
            (s["p"] == now, {"p": zero, "all": F.array_append(s["all"], s["told"])}),
            (s["figure"] == now, {"figure": zero}),
            (s["node"] == now, {"node": zero, "body": F.when(s["text"] > 0, F.concat(s["body"], texts)).otherwise(s["body"]), "head": F.when(s["text"] > 0, s["head"]).otherwise(F.concat(s["head"], texts))}),
            (F.lit(True), {f: F.when(s[f] == now, 0).otherwise(s[f]) for f in ("text", "header")}),
        ]
        cases = [((e["k"] == TEXT), heard)]
        cases += [((e["k"] == OPEN) & when, new | {"depth": d}) for when, new in opened]
        cases += [((e["k"] == CLOSE) & when, new | {"depth": now - 1}) for when, new in closed]
        return state.chosen(s, cases)

    return F.aggregate(own, state.start, step, lambda s: F.when(F.size(s["body"]) > 0, s["body"]).otherwise(s["head"]))


def tei_blocks(documents: DataFrame, id_col: str, xml_col: str) -> DataFrame:
    """(id, pos, type, text) of TEI documents: abstracts first, as paragraphs, then the text in order. A document that isn't XML gives one
    row of type error, with no more than 200 characters of it. An abstract inside an abstract, and a paragraph inside one of its
    paragraphs, are part of it; so is a description inside a description."""
    xml = F.coalesce(col(xml_col).cast("string"), F.lit(""))
    # the engine's parser, asked for nothing but what it can't read
    broken = F.from_xml(xml, "_broken string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "rowTag": "TEI"})["_broken"]
    error = F.array(F.struct(F.lit("error").alias("type"), F.concat(F.lit("not XML: "), F.substring(xml, 1, 200)).alias("text")))

    def told(own: Column) -> Column:
        abstracts = F.transform(abstract_texts(own), lambda t: F.struct(F.lit("paragraph").alias("type"), t.alias("text")))
        blocks = F.transform(body_blocks(own), lambda b: F.struct(b["type"].alias("type"), squeeze(b["text"]).alias("text")))
        return F.filter(F.concat(abstracts, blocks), lambda b: b["text"] != "")

    rows = documents.select(id_col, F.posexplode(F.when(broken.isNotNull() | (F.trim(xml) == ""), error).otherwise(let(events(xml), told))).alias("pos", "b"))
    return rows.select(id_col, F.col("pos").cast("long").alias("pos"), "b.type", "b.text")
