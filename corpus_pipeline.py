"""Training-data pipeline: quality rules, SimHash near-dedup, substring dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of `documents`; `run` writes each stage to the folder that all executors share and reads it again, so that a
lost executor costs one stage at most. What a stage has read goes when the next one is written.

Defined results, for every stage: rows without an id are documents of their own and are judged like others; other columns
than those of `documents`, whatever their names, don't matter and aren't returned; very long texts are read whole; an empty table gives
no rows. What null and empty texts, ties and repeated rows become is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.llm.common import remove_path, scratch_path
from dossier.llm.decontamination import clean
from dossier.llm.packing import pack
from dossier.llm.quality_rules import filtered
from dossier.llm.simhash import one_of_each
from dossier.llm.substring_dedup import substring_dedup_rows

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: SQL can neither compress, nor hash with XXH64, nor tokenize; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the compression bands go; null and empty texts have too few words and go, too.
    Repeated rows have one verdict."""
    return filtered(docs).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: that with the smallest doc_id (null is larger than every id), of repeated
    rows one. Null and empty texts, should there be any, are one group."""
    return one_of_each(docs, radius=2, shingle=3, seed=42).select(*COLUMNS)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in windows that a smaller document has go; a document that had words and has none left goes, too. Null and empty texts
    stay as they are. Rows of one id never remove each other's words; a null id counts as larger than every id."""
    return substring_dedup_rows(docs, window=13).select(*COLUMNS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go. Null and empty texts have none and stay, as does everything if there are no
    items; items without words match nothing."""
    return clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), window=10).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the remaining documents with their sequence and place. A null or empty text is the closing id alone; repeated
    rows are packed each by itself; pieces of one length are interchangeable."""
    return pack(docs, str(public_tokenizers.path("word_bpe_49k.json")), capacity=2048, end_id=0, max_words=250_000)


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substrings),
    ("benchmark_decontamination", decontaminated),
    ("best_fit_packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of the last stage, for the `documents` and `benchmark` of a folder; of an empty table none."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet").select(*COLUMNS), ""
    for name, stage in STAGES[:-1]:
        path, made = scratch_path(spark, name), stage(spark, docs, sf_dir).withColumn("n_chars", F.col("n_chars").cast("long"))
        made.write.parquet(path)
        docs = spark.read.schema(made.schema).parquet(path)
        if before:
            remove_path(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
