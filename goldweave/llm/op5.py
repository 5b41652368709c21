"""Query op5: all documents as pieces of at most 4096 tokens, packed into few sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.llm.base import documents, id_again, tokenizer_path, whole_id
from goldweave.llm.packing import pack_pieces
from goldweave.llm.textvec import relieved
from goldweave.llm.tokens import encoder
from goldweave.plans.staging import staged

CAPACITY = 4096
PIECES = "id bigint, no_id boolean, nr bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


def token_pieces(df: DataFrame, key: str, column: str, tokenizer: str, kind: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of each document's ids with `end_id` at the end: id, no_id (see whole_id), nr (the row's own number), piece, start, length, ids_crc32.

    A null text is an empty one, so that every row has a piece.  Null and repeated keys are kept; extra columns are not read.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(tokenizer, kind)
        for b in relieved(batches):
            ids, n = enc.encode(b["text"].tolist())
            whole = np.empty(len(ids) + len(n), "<u4")
            last = np.cumsum(n + 1) - 1
            place = np.ones(len(whole), bool)
            place[last] = False
            whole[place], whole[last] = ids, end_id
            raw = memoryview(whole).cast("B")
            count = -(-(n + 1) // capacity)
            row = np.repeat(np.arange(len(n)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, (n + 1)[row] - start)
            at = (last - n)[row] + start
            crc = [zlib.crc32(raw[4 * a : 4 * (a + m)]) for a, m in zip(at.tolist(), length.tolist())]
            yield pd.DataFrame({"id": b["id"].to_numpy()[row], "no_id": b["no_id"].to_numpy()[row], "nr": b["nr"].to_numpy()[row], "piece": piece, "start": start, "length": length, "ids_crc32": crc})

    rows = df.select(*whole_id(key), F.monotonically_increasing_id().alias("nr"), F.col(column).alias("text"))
    return rows.mapInPandas(cut, PIECES)


def pack_documents(df: DataFrame, tokenizer: str, kind: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of doc_id, text with their sequence and offset: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = staged(token_pieces(df, "doc_id", "text", tokenizer, kind, end_id, capacity), "pieces")
    packed = pack_pieces(pieces, capacity).select("nr", "piece", F.col("bin").alias("sequence_id"), F.col("place").alias("offset"))
    return pieces.join(packed, ["nr", "piece"]).select(id_again().alias("doc_id"), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts are read and encoded once; only lengths and checksums go on."""
    return pack_documents(documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"), "word", 1)
