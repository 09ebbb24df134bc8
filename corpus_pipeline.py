"""A corpus pipeline of five stages: each works on what the one before kept, written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronolake.llm import jaccard, language, mixing, packing, toxicity
from chronolake.llm.common import written

STAGES = [
    ("language_id", language.stage),
    ("toxicity", toxicity.stage),
    ("near_duplicates", jaccard.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Trained models and hash permutations have no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, applied to documents in turn: rows of the last."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
