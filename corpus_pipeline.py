"""A corpus pipeline over `documents`: each stage calls one operator and its decisions take effect.

All stages keep all columns of their input; the last adds those of the mix. Null, empty and blank texts go at
language ID, which calls them undetermined. Rows that repeat an id and a text lose no lines to each other and
become one row at near-dedup, as do ties: of equal texts the row of the smallest doc_id stays, a null one last.
Rows that share an id but not a text are rows of their own up to decontamination, where they go together. An
empty table stays empty. Columns that clash with those of the mix are replaced by them. Long texts are read
whole; a document must fit a task several times over.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattika.llm import decontaminate, langid, line_dedup, mixing, near_dedup
from lattika.llm.common import ensure_checkpoint_dir, remove_folder, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is unknown or unsure go."""
    return langid.keep_known(docs, langid.train(docs))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later similar lines go; documents without a word left go with them."""
    return line_dedup.dedup_lines(docs).where(F.col("text").rlike(line_dedup.WORD))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (SimHash tries, Jaccard similarity 0.8 of 5-word shingles) stays: the one with the smallest doc_id."""
    return near_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with `taken` words, copies, and the shards that draw them."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", line_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination),
    ("mixing", mixing_stage),
]

ORACLE_SQL = None  # SQL can't express language ID; tests/llm/test_pipeline.py compares every stage of run() with a plain form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written as Parquet to the shared folder and read again, and goes when the next one is written."""
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, f"{folder}/{before}")
        before = name
    return docs
