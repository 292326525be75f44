"""A training-corpus pipeline: language ID, near-dedup, decontamination, PII, BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's ``docs``.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heliograph.llm import bpe, decontaminate, language, minhash, pii
from heliograph.llm.common import fresh, shared_folder, table


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars follows a rewritten text."""
    return docs.withColumn("n_chars", F.length("text").cast("long"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go; ``lang`` becomes the predicted language."""
    return language.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return minhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go; shorter benchmark passages are cut out of the others."""
    return _counted(decontaminate.clean(docs, table(spark, sf_dir, "benchmark")))


def pii_surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes surrogates."""
    found = fresh("pii", docs.columns)
    return _counted(pii.redact(docs, into=found).drop(found))


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the number of tokens, and the digests of ids and decoded text."""
    return bpe.encode(docs)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii_surrogates", pii_surrogates), ("bpe_tokens", bpe_tokens)]

#: Learned models and a tokenizer take part, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; between stages the rows lie in the shared checkpoint folder."""
    run_id = uuid.uuid4().hex
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/pipeline-{run_id}/{name}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
