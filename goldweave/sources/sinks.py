"""Sinks: projected records and reports as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_json(df: DataFrame, path: str, omit_missing: bool = False, mode: str = "overwrite") -> None:
    """A JSON object per line; missing values are null, or left out with omit_missing."""
    df.write.mode(mode).option("ignoreNullFields", omit_missing).json(path)
