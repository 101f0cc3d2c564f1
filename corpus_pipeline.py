"""The corpus pipeline: quality rules, near duplicates, decontamination, personal data, mixing.

Each stage takes what the one before kept, written as Parquet and read again,
so a stage's work is never repeated and a lost executor costs its tasks only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm import decontaminate, mixing, pii, quality, simhash
from sparkfolio.llm.common import quoted, scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the log-likelihood ratio reject go.

    Null, blank and short texts go; null ids are judged by their text; repeated
    rows and ties get equal verdicts; long texts are judged as a whole; extra
    columns stay, whatever their names; an empty table stays empty.
    """
    packed = docs.select(F.struct(*map(quoted, docs.columns)).alias("document"), docs["doc_id"], docs["text"])
    judged = quality.judge_quality(packed, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged.where("kept").select("document.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays.

    Null and blank texts are alike; of repeated rows one stays; rows without
    doc_id go if their group has one, else one of each text stays; long texts
    are compared as a whole; extra columns stay; an empty table stays empty.
    """
    return simhash.keep_one(docs, words=5)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go.

    Null and blank texts hold none and stay, as do null ids; repeated rows stay
    or go together; long texts are read as a whole; extra columns stay; an
    empty table stays empty, without items all rows stay.
    """
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and disclosing terms in texts are generalised; every document stays.

    Null texts stay null, n_chars follows the text; null ids, repeated rows and
    extra columns stay; long texts are scanned as a whole; an empty table stays
    empty.
    """
    return pii.sanitise(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for every stretch of a text that the schedule takes, with slot, epoch, place and n_words; see ``mixing.mixed_stream``.

    Null sources are one source; null and blank texts have no stretch; repeated
    rows and null ids take places of their own; long texts are many stretches;
    extra columns stay, but for those four names; an empty table gives no rows.
    """
    return mixing.mixed_stream(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("PII", personal_data),
    ("mixing sources to target weights", source_mixing),
]

#: The hashed log-likelihood ratio and SimHash have no SQL form; tests/llm/test_pipeline.py compares every stage and run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        kept = scratch(spark, f"pipeline-{n}")
        stage(spark, docs, sf_dir).write.parquet(kept)
        docs = spark.read.parquet(kept)
    return docs
