"""Corpus pipeline: quality rules, quality classifier, near-duplicate removal, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows that its
predecessor kept; all but the last return the columns of ``docs``. ``run``
writes every stage's rows as Parquet in the shared checkpoint folder and reads
them again for the next one, so a failed stage restarts from files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from perkflow.llm import quality_model, repetition
from perkflow.llm.common import private_name, save, table
from perkflow.llm.minhash import NearDup, without_near_duplicates
from perkflow.llm.queries import KEPT_SCORE, packed, quality_trees


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the repetition limits; a null text has no words and goes."""
    verdict = private_name(docs, "_repetition")
    judged = repetition.with_verdict(docs, into=verdict)
    return judged.where(F.col(verdict)["kept"]).drop(verdict)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the limit. The trees are those of the whole ``documents`` table's labels."""
    return docs.where(quality_model.score_column(quality_trees(spark, sf_dir), "text") >= KEPT_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similarity 0.8 or more on five-word shingles."""
    return without_near_duplicates(docs, how=NearDup(shingle=5, percent=80))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 4096 tokens."""
    return packed(docs)


STAGES = [("quality_rules", quality_rules), ("quality_classifier", quality_classifier),
          ("near_dedup", near_dedup), ("packing", packing)]

#: SQL expresses neither the trees nor the packing; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs
