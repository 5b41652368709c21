"""Incremental survivorship: an extension beyond batch, on Structured Streaming.

The winner's order is total and its aggregate mergeable, so the stream keeps one struct per (entity, field) and needs no
Python state.  Output mode "update" gives each changed winner once per trigger; with a watermark on `ts`,
"append" windows give the winners of closed windows and late claims are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.operators.survivorship import rank


def streaming_winners(claims: DataFrame, entity: str, field: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """claims: a stream of entity, value, priority, confidence, ts and seq -> the winner of each key so far."""
    by = [entity] if field is None else [entity, field]
    kept = ["value", *(carry or [])]
    return claims.groupBy(*by).agg(F.max_by(F.struct(*kept), rank()).alias("w")).select(*by, *(F.col(f"w.{c}").alias(c) for c in kept))


def windowed_winners(claims: DataFrame, entity: str, window: str, late: str, carry: list[str] | None = None) -> DataFrame:
    """The winner of each entity in each window of event time, final once the watermark `late` has passed it."""
    kept = ["value", *(carry or [])]
    top = claims.withWatermark("ts", late).groupBy(F.window("ts", window), entity).agg(F.max_by(F.struct(*kept), rank()).alias("w"))
    return top.select(F.col("window.start").alias("from_ts"), entity, *(F.col(f"w.{c}").alias(c) for c in kept))
