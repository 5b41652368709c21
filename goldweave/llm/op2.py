"""Query op2: low quality, then toxicity, of every document by a classifier chain learned from `labels`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.llm.base import documents, table
from goldweave.llm.toxicity import Chain, fit, score

CATEGORIES = ["low_quality", "toxic"]


def learn(docs: DataFrame, labels: DataFrame) -> Chain:
    """From the documents that have labels; the labels give two categories, of which low quality comes first."""
    return fit(docs, labels.select("doc_id", (F.lit(1) - F.col("quality")).alias("low_quality"), "toxic"), CATEGORIES)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score(docs, learn(docs, table(spark, sf_dir, "labels")), ["doc_id"])
