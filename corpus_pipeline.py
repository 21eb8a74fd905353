"""The corpus pipeline: language ID, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each as
Parquet in the shared folder and gives the reread table to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lamina.llm import langid, mixing, packing, secrets, similar
from lamina.llm.common import read, remove, scratch


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language (operator 3): no letters, or no nearer to any prototype than by chance."""
    return langid.keep_known(docs, train=langid.training_rows(read(spark, sf_dir, "documents")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that with the smallest doc_id, of each group of near-duplicates (operator 5).

    Texts are near-duplicates at a similarity of 0.8 or more in five-word shingles.
    """
    return similar.keep_first(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces the secrets in texts (operator 6); every document stays."""
    return secrets.redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and leaves out documents so that sources reach their targets (operator 9)."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the mixed documents into length buckets and batches (operator 1)."""
    return packing.pack(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mix", source_mix),
    ("pack", pack),
]

#: Language profiles, SimHash and token efficiency have no SQL: tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over ``documents``; each stage reads what its predecessor wrote."""
    docs = read(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    return STAGES[-1][1](spark, docs, sf_dir)
