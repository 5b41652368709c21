"""Query op3: every text stored as a TIFF, read back page by page, and digested.

A checksum of the text chooses how it is stored, so that equal texts have equal files: strips or tiles, each compression,
either predictor and byte order, all occur.  Texts of more than PAGE_ROWS rows of 192 bytes are chains of pages.  Repeated
rows are results of their own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from goldweave.llm.base import documents, id_again, whole_id
from goldweave.llm.tiff import page_batches, text_batches

PAGE_ROWS = 64
#: By the checksum's remainder; what isn't named is write_tiff()'s default, deflate strips with predictor 2.
FORMS = [{"compression": "lzw"}, {"compression": "packbits", "predictor": 1}, {"tile": (96, 64)}, {"compression": "packbits", "predictor": 1, "tile": (64, 16), "order": ">"}, {"order": ">", "rows": 16}, {"predictor": 1}, {}, {}]
SCHEMA = "id bigint, no_id boolean, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, pages int"


class _Digest:
    """What the pages of one file add up to; they come in order, so nothing but sums is kept."""

    def __init__(self, own: tuple):
        self.own, self.sha, self.size, self.tail = own, hashlib.sha256(), 0, b""
        self.counts, self.rows, self.pages = np.zeros(256, np.int64), 0, 0

    def add(self, pixels: bytes, height: int) -> None:
        self.sha.update(pixels)
        self.size += len(pixels)
        self.tail = (self.tail + pixels[-16:])[-16:]
        self.counts += np.bincount(np.frombuffer(pixels, np.uint8), minlength=256)
        self.rows += height
        self.pages += 1

    def row(self) -> tuple:
        id_, no_id, n_bytes, _, media, sha = self.own
        n = max(self.size, 1)
        mean = int((self.counts * np.arange(256)).sum()) / n
        p = self.counts[self.counts > 0] / n
        feature = f"rows={self.rows};mean={mean:.3f};levels={len(p)};entropy={-(p * np.log2(p)).sum():.3f}"
        return id_, no_id, n_bytes, self.size, self.sha.hexdigest(), zlib.crc32(self.tail), media, sha, feature, self.pages


def form(text: str) -> dict:
    return FORMS[zlib.crc32(text.encode("utf-8", "surrogatepass")) % len(FORMS)]


def _stored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    seen = 0
    for b in text_batches(batches, "text", ["id", "no_id"], form, PAGE_ROWS):
        seen += len(b)
        yield b.assign(nr=np.arange(seen - len(b), seen), media=b["tiff"].map(len), sha=b["tiff"].map(lambda x: hashlib.sha256(x).hexdigest()))


def _digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    keep = ["id", "no_id", "n_bytes", "nr", "media", "sha"]
    now: _Digest | None = None
    for b in page_batches(_stored(batches), "tiff", keep):
        if b["error"].notna().any():
            raise ValueError(f"a stored text can't be read back: {b['error'].dropna().iloc[0]}")
        out = []
        for own, height, pixels in zip(b[keep].astype(object).itertuples(index=False, name=None), b["height"], b["pixels"]):
            if now is None or now.own[3] != own[3]:
                if now:
                    out.append(now.row())
                now = _Digest(own)
            now.add(pixels, int(height))
        yield pd.DataFrame(out, columns=names)
    if now:
        yield pd.DataFrame([now.row()], columns=names)


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store, read back and digest in one pass over the rows: no shuffle, one page in memory at a time."""
    found = documents(spark, sf_dir).select(*whole_id("doc_id"), "text").mapInPandas(_digests, SCHEMA)
    return found.select(id_again().alias("doc_id"), *(c for c in found.columns if c not in ("id", "no_id")))
