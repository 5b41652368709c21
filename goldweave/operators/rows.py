"""Rows of sorted partitions by key, for rules that run in Python: groups of a few rows, many thousands of them a task."""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string


def runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """The rows of one key after another; a run may go on in the next batch."""
    rows = (r for b in batches for r in b.to_pylist())
    for _, own in itertools.groupby(rows, lambda r: r[key]):
        yield list(own)


@dataclass
class Shape:
    schema: pa.Schema

    def batches(self, rows: Iterable[dict], most: int = 4096) -> Iterator[pa.RecordBatch]:
        rows = iter(rows)
        while some := list(itertools.islice(rows, most)):
            yield pa.RecordBatch.from_pylist(some, self.schema)


def told_as(schema: str) -> Shape:
    """A schema as Arrow has it, made on the driver."""
    return Shape(to_arrow_schema(_parse_datatype_string(schema)))
