"""A training-corpus pipeline: five stages, each written as Parquet and read again by the next.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame.
All but the last return the columns of ``documents``:

1. quality rules: rejected documents go, boilerplate lines of the kept ones are removed;
2. SimHash near-dedup: one document of each component stays;
3. benchmark decontamination: documents that hold a test item go;
4. PII: personal data and disclosing terms in the text are generalised or removed;
5. mixing: every document's words taken by the mix and how often it is repeated.

Nulls, repeated rows, empty tables and extra columns are handled as the operators' docstrings say.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from loopgrade.functions.session import ensure_checkpoint_dir
from loopgrade.llm import decontamination, mixing, quality_rules, sanitise, simhash


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.deduplicate(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sanitise.sanitise(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [("quality rules", quality), ("simhash near-dedup", near_dedup), ("decontamination", decontaminate), ("pii", pii), ("mixing", mix)]

#: XXH64 fingerprints and alignments have no SQL form; the pipeline is tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage returns is written to the session's shared folder."""
    ensure_checkpoint_dir(spark)
    shared = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{shared}/{k}")
        docs = spark.read.parquet(f"{shared}/{k}")
    return docs
