"""What the operators here share: reading tables, ids on their way through Python, paths of tokenizers.

Arrow batches are bounded by Spark itself (64 MB or 10,000 rows); within one, texts are worked on in chunks of about a MB.
"""

from __future__ import annotations

import importlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def tokenizer_path(name: str) -> str:
    """Where the public tokenizer files are installed; callers may pass any other path."""
    return importlib.import_module("public_tokenizers").path(name)


def whole_id(key: str) -> list[Column]:
    """id, no_id: a nullable id as a long and a flag.  pandas would turn longs beside a null into doubles, which round beyond 2**53."""
    id_ = F.col(key).cast("bigint")
    return [F.coalesce(id_, F.lit(0)).alias("id"), id_.isNull().alias("no_id")]


def id_again() -> Column:
    """The nullable id of whole_id()'s columns."""
    return F.when(~F.col("no_id"), F.col("id"))
