"""The registered queries of this subpackage: thin calls of the operators with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(mod: int):
    """The fold of a document: crc32 of its id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % mod


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    scored = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), allowed=fold(3) != 1)
    return scored.select("doc_id", (fold(3) == 1).alias("held_out"), "score", "predicted")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents"), least=400, with_text=False).drop("spans", "kept_text")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"), containment=0.8)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), radius=2, shingle=3, seed=42).drop("fp")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), capacity=2048, end_id=0)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    found = identify(table(spark, sf_dir, "documents"), allowed=fold(4) != 2)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "rejected")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents"), window=13, with_text=False).drop("kept_text")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), allowed=fold(4) != 2, threshold=0.3)
    return scored.select("doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted")


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ranked_search import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


def op12_online_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .online_packing import pack_online

    return pack_online(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), capacity=2048, end_id=1)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .filter_audit import filter_audit

    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Query]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


SUBSTRINGS = r"""
WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i : i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM t)),
owner AS (SELECT s, min(doc_id) AS d FROM win GROUP BY s),
late AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN owner USING (s) WHERE d < doc_id),
run AS (SELECT doc_id, count(*) AS n_removed, count_if(p <> coalesce(before, -1) + 1) AS n_spans FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS before FROM late) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM t),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS k FROM word ANTI JOIN late USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN run USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

HITS = r"""
WITH word AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL) WHERE len(w) > 0),
asked AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT item_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM item)),
win AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM word, (SELECT DISTINCT n FROM item))),
met AS (SELECT doc_id, n, i, item_id FROM win JOIN asked USING (n, s)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM met) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM word LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""


RANKED = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
d AS (SELECT doc_id, w, len(w)::BIGINT AS n FROM t WHERE len(w) > 0),
g AS (SELECT count(*) AS n_all, sum(n)::BIGINT AS l_all FROM d),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS x FROM benchmark),
p AS (SELECT doc_id, n, x, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS x FROM d) WHERE x IN (SELECT x FROM q) GROUP BY ALL),
f AS (SELECT x, floor(1000 * ln((2 * any_value(n_all) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY x),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_all) // l_all))))::BIGINT AS score FROM q JOIN f USING (x) JOIN p USING (x), g GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= 50
"""

AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS w FROM documents),
e AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
v AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), doc_id > first_id] AS fails
  FROM d JOIN e USING (text) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, count_if(good) AS n_good, count_if(toxic) AS n_toxic FROM v GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a JOIN x b ON a.x <> b.x JOIN x c ON c.x NOT IN (a.x, b.x) JOIN x d ON d.x NOT IN (a.x, b.x, c.x) JOIN x e ON e.x NOT IN (a.x, b.x, c.x, d.x)),
s AS (SELECT filter_order, step, list_transform(string_split(filter_order, ''), lambda y: ascii(y) - 64) AS f FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, f[step] AS own, fails[f[step]] AS failed, list_bool_or(list_transform(f[1 : step - 1], lambda i: fails[i])) AS gone,
  len(list_filter(fails, lambda y: y)) = 1 AS alone, n, n_good, n_toxic FROM s, c),
m AS (SELECT part, filter_order, step, any_value(own) AS own,
  coalesce(sum(n) FILTER (WHERE NOT coalesce(gone, false) AND NOT failed), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (WHERE NOT coalesce(gone, false) AND failed), 0)::BIGINT AS removed,
  coalesce(sum(n) FILTER (WHERE coalesce(gone, false) AND failed), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (WHERE failed AND alone), 0)::BIGINT AS unique_fails,
  coalesce(sum(n_good) FILTER (WHERE NOT coalesce(gone, false) AND failed), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (WHERE NOT coalesce(gone, false) AND failed), 0)::BIGINT AS toxic_lost
  FROM r GROUP BY part, filter_order, step)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM m
"""


def oracle_sql() -> dict[str, str]:
    from .license_scan import oracle

    return {"op3_license_scan": oracle(), "op7_substring_dedup": SUBSTRINGS, "op9_benchmark_decontamination": HITS, "op11_ranked_search": RANKED, "op13_filter_audit": AUDIT}
