"""The corpus pipeline: quality, line dedup, near-dedup, decontamination, mixing.

Every stage takes (spark, docs, sf_dir) and works on all rows that its
predecessor kept; ``run`` writes each result as Parquet in the shared
checkpoint folder and reads it back as the next stage's documents.  All stages
but the last return the columns of ``documents``; the last returns the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.llm import cgk_decontam, line_windows, minmax_dedup, mix_budget, quality_ftrl
from flowlens.llm.common import documents, materialise

#: Four words are the contract of the query op6_minmax alone.
NEAR = minmax_dedup.MinMaxParams(shingle=5)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (fitted on the labelled ones) does not reject."""
    weights = quality_ftrl.fit(docs, documents(spark, sf_dir, "labels"))
    return quality_ftrl.keep_good(docs, weights)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later occurrences of three-line windows; documents that lose all their lines go."""
    out = line_windows.drop_repeated_windows(docs)
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("row.n_chars"))
    columns = [changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    return out.filter("n_removed = 0 OR n_removed < n_lines").select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five-word sets, 0.8): the one with the smallest doc_id."""
    return minmax_dedup.one_of_each_group(docs, NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return cgk_decontam.drop_contaminated(docs, documents(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of what is left: words taken of every document, by source targets."""
    return mix_budget.mix(docs)


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mixing", mixing),
]

#: Training, hashing and the knapsack have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
