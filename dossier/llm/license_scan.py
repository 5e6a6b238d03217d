"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

Everything is DataFrame expressions. Texts become words (runs of letters and digits, lower case) and five-word shingles, as
64-bit hashes. Windows of 1, 8, 16 and 64 shingles overlap over the whole of every text (only those sizes that a template needs),
and a template is cut into windows of its own, one at every shingle, so long that a text window holds one whole wherever
it starts.

A window's signature is MinHash by one permutation: hashes fall into `bands` bins, and the least one of each bin is a band.
Two sets of similarity j agree in a band with probability j, so they share one of k filled bands with probability
1 - (1 - j)^k; `chance` gives that bound for the least similar window that a template with `containment` of its shingles
left must have. With 16 bands it is above 99.9 percent from 8 shingles on. Text windows that share a band with a template's
window lead to windows of the template's size around them (four quarters that overlap, so that one holds the template
whole); each is held against the templates of that size: the share of a template's shingles that it has, by exact
comparison, must reach `containment`. Nothing else finds a template: where no band agrees, nothing is verified.

Templates are a parameter: a list in the program, at most `MAX_SHINGLES` in all (checked), broadcast with a few hundred
bytes for each and eight for each of their shingles.

Defined results: null and empty texts, and texts of fewer than five words, match nothing. A template of fewer than five
words is an error. Rows with the same doc_id are taken together: the best match counts. Ties of containment go to the first
place. Very long texts are scanned whole. Other columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_rows

#: Public license notices and texts.
NOTICES = {
    "mit": "Released under the MIT License.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.",
    "apache-2.0-header": "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "mit-text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER "
        "LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS "
        "IN THE SOFTWARE."
    ),
    "isc-text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD "
        "TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
        "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE "
        "OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "bsd-2-clause-text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
        "and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE "
        "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE "
        "LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE "
        "GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT "
        "LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
        "DAMAGE."
    ),
}
SHINGLE = 5
MAX_SHINGLES = 4_000_000


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def shingles(w: Column) -> Column:
    """Hashes of all runs of five words; none if there are fewer."""
    n = F.size(w) - F.lit(SHINGLE)
    own = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
    return F.when(n >= 0, own)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row: a generator between, as expressions in lambdas are repeated otherwise."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def window_size(n_shingles: int) -> int:
    """The least power of two (or the number itself up to four) in which a template lies whole wherever it starts, given
    windows every quarter of it."""
    size = 8
    while size - stride(size) + 1 < n_shingles:
        size *= 2
    return n_shingles if n_shingles <= 4 else size


def stride(size: int) -> int:
    return max(1, size // 4)


#: Sizes of signed text windows and how far apart they start.
SIGNED = {1: 1, 8: 2, 16: 8, 64: 32}


def held(signed: int) -> int:
    """The longest window of a template that some text window holds whole."""
    return signed - SIGNED[signed] + 1


def signed_size(n_shingles: int) -> int:
    """The text windows that retrieve a template: about its size, or less than half of it."""
    return 1 if n_shingles < 5 else 8 if n_shingles < 8 else 16 if n_shingles < 50 else 64


def chance(n_shingles: int, containment: float, bands: int) -> float:
    """A lower estimate of the chance that a window holding `containment` of a template's window shares a band with it."""
    size = signed_size(n_shingles)
    own = min(n_shingles, held(size))
    left = ceil(containment * own - 1e-9)
    union = size + own - left
    filled = bands * (1 - (1 - 1 / bands) ** union)
    return 1.0 if size == 1 else 1 - (1 - left / union) ** filled


def signature(window: Column, bands: int) -> Column:
    """The least hash of each bin that has one; bins are ranges of the hash, so the first of each in rising order."""
    bits = bands.bit_length() - 1

    def of_bin(h: Column) -> Column:
        return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0)

    return F.flatten(F.transform(F.array(F.sort_array(window)), lambda s: F.filter(s, lambda h, i: (i == 0) | (of_bin(h) != of_bin(F.get(s, i - 1))))))


def agreeing(shingle: Column, size: int, bands: int, wanted: list[int]) -> Column:
    """(at, values) of the text windows of this size that have some of the wanted values in their bands."""
    step = SIGNED[size]
    if size == 1:
        each = F.transform(shingle, lambda h, i: F.when(h.isin(wanted), F.struct(i.alias("at"), F.array(h).alias("values"))))
        return F.filter(each, lambda x: x.isNotNull())
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.size(shingle) - 1) / F.lit(step)).cast("int"), F.lit(0)))
    signed = F.transform(starts, lambda k: F.struct((k * step).alias("at"), F.filter(signature(F.slice(shingle, k * step + 1, size), bands), lambda h: h.isin(wanted)).alias("values")))
    return F.filter(signed, lambda x: F.size(x["values"]) > 0)


def having(found: Column, wanted: list[int]) -> Column:
    """Where those windows start that have one of the wanted values."""
    return F.transform(F.filter(found, lambda x: F.exists(x["values"], lambda h: h.isin(wanted))), lambda x: x["at"])


def around(starts: Column, signed: int, size: int) -> Column:
    """(size, start, window) of all windows of a template's size that overlap one of the signed windows."""
    step = stride(size)
    near = F.transform(starts, lambda p: F.sequence(F.greatest(F.ceil((p - size + 1) / F.lit(step)).cast("int"), F.lit(0)), F.floor((p + signed - 1) / F.lit(step)).cast("int")))
    return F.transform(F.array_distinct(F.flatten(near)), lambda k: F.struct(F.lit(size).alias("size"), (k * step).alias("start"), F.slice(F.col("all"), k * step + 1, size).alias("window")))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license, own, size, signed, in_order): the different shingles of each template, the sizes of its windows, and its shingles in order."""
    rows = spark.createDataFrame(list(templates.items()), "license string, notice string")
    made = once(rows, "w", words(F.col("notice"))).select("license", shingles(F.col("w")).alias("all")).select("license", "all", F.array_distinct("all").alias("own")).collect()
    if short := [r.license for r in made if r.own is None]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {', '.join(short)}")
    if sum(len(r.all) for r in made) > MAX_SHINGLES:
        raise ValueError(f"templates have more than {MAX_SHINGLES} shingles")
    return spark.createDataFrame([(r.license, r.own, window_size(len(r.own)), signed_size(len(r.own)), r.all) for r in made], "license string, own array<long>, size int, signed int, in_order array<long>")


def template_values(known: DataFrame, signed: int, size: int, bands: int) -> list[int]:
    """The band values of all windows of the templates of these sizes."""
    own = known.where((F.col("signed") == signed) & (F.col("size") == size))
    length = F.least(F.size("in_order"), F.lit(held(signed)))
    windows = own.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("in_order") - length), lambda i: F.slice(F.col("in_order"), i + 1, length))).alias("window"))
    values = windows.select(F.explode(signature(F.array_distinct("window"), bands)).alias("value")).distinct()
    return sorted(r.value for r in values.collect())


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, containment: float = 0.8, bands: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, containment, shingle_start) of each template that a document has, with the best window's start.

    `bands` is a power of two. Texts don't leave their task: what is shuffled are verified matches.
    """
    spark = docs.sparkSession
    templates = NOTICES if templates is None else templates
    if not templates:
        return spark.createDataFrame([], "doc_id long, license string, containment double, shingle_start long")
    known = template_table(spark, templates)
    values: dict[int, dict[int, list[int]]] = {}
    for signed, size in sorted(tuple(r) for r in known.select("signed", "size").distinct().collect()):
        values.setdefault(signed, {})[size] = template_values(known, signed, size, bands)

    scanned = once(text_rows(docs, id_col, text_col).where("text is not null"), "w", words(F.col("text"))).select("doc_id", "w")
    scanned = once(scanned, "all", shingles(F.col("w"))).select("doc_id", "all").where("all is not null")
    near = []
    for signed, of_size in values.items():
        scanned = once(scanned, f"found_{signed}", agreeing(F.col("all"), signed, bands, sorted({v for own in of_size.values() for v in own})))
        for size, wanted in of_size.items():
            near.append(around(having(F.col(f"found_{signed}"), wanted), signed, size))
    windows = scanned.select("doc_id", F.explode(F.concat(*near)).alias("near")).select("doc_id", "near.*")
    met = windows.join(F.broadcast(known.select("license", "own", "size")), "size")
    share = F.size(F.array_intersect("own", "window")) / F.size("own")
    verified = met.select("doc_id", "license", "start", share.alias("containment")).where(F.col("containment") >= containment)
    best = F.max(F.struct("containment", (-F.col("start")).alias("back")))
    return verified.groupBy("doc_id", "license").agg(best.alias("best")).select("doc_id", "license", "best.containment", (-F.col("best.back")).cast("long").alias("shingle_start"))


def oracle(templates: dict[str, str] | None = None, containment: float = 0.8) -> str:
    """DuckDB SQL for the same rows, by looking at all windows exactly."""
    notices = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in (NOTICES if templates is None else templates).items())
    return f"""
    WITH RECURSIVE notices(license, notice) AS (VALUES {notices}),
    spelled AS (SELECT license, list_filter(regexp_split_to_array(lower(notice), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM notices),
    tokens AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '') AS w FROM documents WHERE text IS NOT NULL),
    template AS (SELECT DISTINCT license, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS i FROM spelled)),
    needed AS (SELECT license, count(*) AS n, CASE WHEN count(*) <= 4 THEN count(*) WHEN count(*) <= 7 THEN 8 ELSE (2 ** ceil(log2((count(*) - 1) / 0.75)))::BIGINT END AS size FROM template GROUP BY license),
    placed AS (SELECT doc_id, i - 1 AS p, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM tokens)),
    hits AS (SELECT DISTINCT doc_id, p, s, license, n, size, greatest(size // 4, 1) AS step FROM placed JOIN template USING (s) JOIN needed USING (license)),
    covered AS (SELECT doc_id, license, n, s, k * step AS start FROM (SELECT *, unnest(range(greatest(0, (p - size + step) // step), p // step + 1)) AS k FROM hits)),
    shares AS (SELECT doc_id, license, start, count(DISTINCT s)::DOUBLE / any_value(n) AS containment FROM covered GROUP BY doc_id, license, start)
    SELECT doc_id, license, max(containment) AS containment, arg_max(start, (containment, -start))::BIGINT AS shingle_start
    FROM shares WHERE containment >= {containment} GROUP BY doc_id, license
    """
