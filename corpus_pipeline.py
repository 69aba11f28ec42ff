"""Corpus pipeline: quality rules, exact and near de-duplication, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again before the next stage starts, so a lost executor never
costs more than the running stage.  All stages but the last return the columns of
``documents``.

Every stage works on all rows its predecessor kept, and defines the edge cases
(nulls, empty and very long texts, ties, repeated rows, empty tables, clashing
column names) as its operator does; see the operators' docstrings.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ordersight.llm import bpe, exact_dedup, mixing, ngram_join, quality_rules
from ordersight.llm.common import checkpoint_dir, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines too frequent on their host are taken out of the others."""
    return quality_rules.clean_documents(docs)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays."""
    return exact_dedup.kept_rows(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word Jaccard of 0.8 or more the smallest id stays."""
    return ngram_join.representatives(docs, n=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, ordered by the mix of their sources (weights: square root of the sizes)."""
    return mixing.mixed_rows(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, place in the mix (slot, in_block), n_tokens and token ids.

    Neither reading files nor encoding keeps rows in order, so the schedule comes back
    as columns: the mix is deterministic and numbered again over the same rows.
    """
    # the input row stays one struct, so that none of its columns can clash with the place
    placed = mixing.placed_rows(docs).select(
        F.struct("row.doc_id", "row.source", "slot", "in_block").alias("place"), F.col("row.text").alias("text")
    )
    encoded = bpe.encode(placed.checkpoint(), carry=("place",))
    return encoded.select("place.*", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality_rules", quality_stage),
    ("exact_dedup", exact_stage),
    ("ngram_join", near_stage),
    ("source_mixing", mixing_stage),
    ("byte_bpe", encoding_stage),
]

#: SQL expresses neither the similarity join's components at scale nor byte-level BPE; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the stages' tables go to the shared checkpoint folder."""
    checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
