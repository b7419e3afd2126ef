"""A training-corpus pipeline over ``documents``: five stages, each on all that the one before kept.

Rows that repeat a doc_id are told apart by their text. All stages but the
last return the columns of ``documents``; the last returns token ids. Mixing
repeats rows: a document that is taken twice is two rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.llm import bpe, jaccard, lines, mixing, quality
from marginalia.llm.common import documents, written


def _sized(docs: DataFrame, columns: list[str]) -> DataFrame:
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("bigint"))
    return docs.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the base rules fail or that lie far from their language."""
    # Written first: a filter on the verdict would be pushed into the expressions it is made of and repeat them.
    verdicts = written(quality.judged(docs).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "kept"), "verdicts")
    rejected = verdicts.where(~F.col("kept")).select("_d", "_h").distinct()
    return docs.join(rejected, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_h")), "left_anti")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out lines that stand at many sources, all but the first of each."""
    return _sized(lines.without_boilerplate(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at 0.8 or more."""
    return jaccard.representatives(docs, 5, 80)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources meet their targets of words."""
    mixed = mixing.mixture(docs).where("copies > 0")
    return mixed.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and what they decode to as a digest."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    return bpe.token_digests(docs, path, [c for c in ("doc_id", "lang", "source") if c in docs.columns], with_ids=True)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mixing),
    ("BPE encoding and decoding", bpe_encoding),
]

#: Sketched language references, graph components and subword merges are beyond SQL: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"stage{i}")
    return docs
