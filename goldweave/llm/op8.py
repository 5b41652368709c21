"""Query op8: near-duplicate groups of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from goldweave.llm.base import documents
from goldweave.llm.neardup import groups


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(documents(spark, sf_dir)).drop("text_hash").withColumnRenamed("key", "doc_id")
