"""Query op7: licence phrases and notices in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.llm.base import documents
from goldweave.llm.licenses import scan


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir), "doc_id", "text").drop("nr").withColumnRenamed("key", "doc_id").withColumn("score", F.col("score").cast("double"))
