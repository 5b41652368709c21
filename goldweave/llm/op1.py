"""Query op1: the language of every document, learned from those not held out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.llm.base import documents
from goldweave.llm.langid import fit, identify


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held out: crc32 of doc_id's digits, modulo 4, is 2 (a null doc_id is not).  lang is read for learning only."""
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = fit(docs.filter(~held_out))
    return identify(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
