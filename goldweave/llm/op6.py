"""Query op6: all documents mixed to target weights of their sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from goldweave.llm.base import documents
from goldweave.llm.mixing import ALPHA, SEED, mix_sources

SQL = f"""
WITH by_source AS (
  SELECT source, coalesce(sum(length(text)), 0) AS mass FROM documents GROUP BY source
), weighted AS (
  SELECT source, mass, power(CAST(mass AS DOUBLE), {ALPHA}) AS w FROM by_source
), rated AS (
  SELECT source, coalesce(CASE WHEN mass > 0 THEN round(1.0 * w / (SELECT sum(w) FROM weighted) * (SELECT sum(mass) FROM weighted) / mass, 9) ELSE 1.0 END, 1.0) AS rate FROM weighted
), drawn AS (
  SELECT d.doc_id, d.source, r.rate,
         CAST(('0x' || substr(md5(concat_ws('|', '{SEED}', coalesce('=' || CAST(d.doc_id AS VARCHAR), '-'), coalesce('=' || d.text, '-'))), 1, 13)) AS BIGINT) / 4503599627370496.0 AS u
  FROM documents d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source
), terms AS (
  SELECT rate, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM (SELECT rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 40) AS BIGINT))) AS k FROM (SELECT DISTINCT rate FROM rated))
), cdf AS (
  SELECT rate, k, sum(p) OVER (PARTITION BY rate ORDER BY k) AS c FROM terms
), counted AS (
  SELECT doc_id, source, rate, u, (SELECT count(*) FROM cdf WHERE cdf.rate = drawn.rate AND cdf.c <= drawn.u) AS n FROM drawn
)
SELECT doc_id, source, round(rate, 6) AS rate, CAST(unnest(range(0, n)) AS INTEGER) AS copy_nr FROM counted WHERE n > 0
"""


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares proportional to each source's characters to the power 0.7; rows in the order of the shuffle."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mix_sources(docs).selectExpr("doc_id", "source", "round(__rate, 6) AS rate", "__copy AS copy_nr")
