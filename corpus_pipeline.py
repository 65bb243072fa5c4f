"""Raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the one before it kept, and returns a
DataFrame; all but the last return the columns of `documents`.  ``run`` writes each stage's rows
as Parquet to the cluster's shared folder and reads them again, so a lost executor costs the work
of one stage at most.  Documents without a doc_id cannot be named and leave at the second stage; of
rows that share one, a stage judges each by its text, but for decontamination, which takes all rows
of an id that holds a benchmark item.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, langid, neardup, packing, state, substring

#: A list of ids up to this long is broadcast (8 bytes each); a longer one is joined by shuffle.
BROADCAST_IDS = 100_000


def _listed(ids: DataFrame) -> DataFrame:
    """Distinct ids, to be broadcast if there are few."""
    ids = state.cut(ids.distinct())
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages learned from the labelled ones; texts in others and texts without a letter go."""
    learned = langid.prototypes(docs.where(~langid.held_out("doc_id")), "text", "lang")
    return langid.keep_identified(docs, learned, "text")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id."""
    return neardup.keep_one(docs).select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that occur earlier; n_chars follows the text."""
    out = substring.remove_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no copy of a benchmark item, edited ones included."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(_listed(found.select("doc_id")), "doc_id", "left_anti").select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in training sequences."""
    return packing.pack(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]

#: SQL cannot state the first, second and last stage; tests/llm/test_pipeline.py compares every stage with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{state.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
