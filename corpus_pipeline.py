"""Corpus preparation: ``STAGES`` run one after the other over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and reread as the next stage's ``docs``. All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pricewise.llm import decontaminate, near_dup, quality_rules, secrets, sentencepiece_codec
from pricewise.llm.common import read, written

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality_rules.keep(docs)


def near_dup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of every group of near-duplicates."""
    return near_dup.keep_one(docs, k=SHINGLE)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark; ``n_chars`` follows the text."""
    return secrets.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as token ids, with the round trip and parity of each; a column
    of the input that has the name of one of these results gives way to it."""
    done = sentencepiece_codec.encoded(docs)
    made = {"__tokens", *(n.lower() for n in done.schema["__tokens"].dataType.names)}
    return done.select(*[F.col(f"`{c}`") for c in done.columns if c.lower() not in made], "__tokens.*")


STAGES = [
    ("quality_rules", quality_stage),
    ("near_dup", near_dup_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("sentencepiece", tokens_stage),
]

#: The last stages use a trained network and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
