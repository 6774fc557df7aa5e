"""From raw documents to packed sequences in five stages.

Toxic documents go, then poor ones, then all but one of each group of near duplicates by SimHash; personal data
in the rest is masked, and the texts are packed into sequences of token ids. Each stage reads what
its predecessor wrote and returns the columns of ``documents``, but for the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crowdtide.llm import packing, pii, quality, simhash, toxicity
from crowdtide.scratch import materialize

STAGES = [
    ("toxicity", toxicity.drop_toxic),
    ("quality", quality.drop_poor),
    ("near_duplicates", simhash.one_of_each_group),
    ("pii", pii.mask_documents),
    ("packing", packing.packed),
]

#: Fitted classifiers and tokens are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents of a folder; every stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
