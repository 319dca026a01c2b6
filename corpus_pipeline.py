"""A training-data pipeline over ``documents``: each stage is one operator, works on all that
its predecessor kept, and is written before the next one starts.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return
the columns of ``documents``. Rows without a ``doc_id`` pass through the filters that need
one. An empty table passes through every stage.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from supplypanel.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from supplypanel.llm.common import drop_folder, table, without, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; it is trained on the labelled ones
    among ``docs``."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model, docs.columns, ("_toxicity", "_toxic"))
    return scored.where("_toxic = 0").select(*docs.columns)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier one is similar to. A document of which no
    line is left goes."""
    deduped = line_dedup.dedup_lines(docs, names=("_lines_before", "_lines_gone"))
    kept = deduped.where("_lines_gone < _lines_before or _lines_before = 0")
    changed = F.col("_lines_gone") > 0
    return kept.withColumn(
        "n_chars", F.when(changed, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    ).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of n-gram near-duplicates, the one with the smallest id.
    Rows of one id are one document."""
    classes = ngram_join.near_duplicates(docs, n=5, threshold=80)
    later, _ = written(
        classes.where("component_id != doc_id").select("doc_id").distinct(), "later-copies"
    )
    return without(docs, later, "doc_id")


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark."""
    found = decontamination.overlaps(docs, table(spark, sf_dir, "benchmark"))
    leaked, _ = written(found.select("doc_id").distinct(), "leaked")
    return without(docs, leaked, "doc_id")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents left, in training sequences."""
    return packing.pack(docs, packing.vocabulary_paths())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

# Training and tokenizing have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs, folder = written(stage(spark, docs, sf_dir), f"stage-{name}")
        if before:
            drop_folder(spark, before)
        before = folder
    return docs
