"""Token-id output: documents in ascending doc_id order in shard files, and their digest read back."""

from __future__ import annotations

import io
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from goldweave.llm.base import documents, id_again, tokenizer_path, whole_id
from goldweave.llm.idfile import blocks, encode_block
from goldweave.llm.tokens import encoder
from goldweave.plans.staging import new_folder

MANIFEST = "shard int, path string, docs bigint, tokens bigint, bytes bigint"
#: Tokens after which a block of a file is closed, at the end of a document.
BLOCK = 2_000_000


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")


def write_token_files(df: DataFrame, key: str, column: str, folder: str, tokenizer: str, kind: str, end_id: int) -> DataFrame:
    """Encode `column` (null: empty), end each document with `end_id`, write shards sorted by `key`; returns the manifest.

    Rows are range-partitioned by key, ties and nulls (which come first) in the order of the input, so
    that even one key with most rows is spread.  A shard holds its keys beside the ids: the .keys file.
    A shard is written under a name of its attempt and then renamed; attempts write the same bytes, so a
    lost executor costs its shards only.  The manifest has a row per shard; an empty table gives none.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get()
        shard, store = task.partitionId(), None
        enc, docs, tokens, size = encoder(tokenizer, kind), 0, 0, 0
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        keys: list[pd.DataFrame] = []

        def close() -> None:
            nonlocal size, ids, lengths, keys
            data = encode_block(np.concatenate(ids), np.concatenate(lengths))
            out.write(data)
            named = pd.concat(keys)
            own.write(named["id"].to_numpy(np.int64).tobytes() + named["no_id"].to_numpy(bool).tobytes())
            size += len(data)
            ids, lengths, keys = [], [], []

        held = 0
        for b in batches:
            if not len(b):
                continue
            if store is None:
                store, root = _filesystem(folder)
                store.create_dir(root, recursive=True)
                name = f"{root}/shard-{shard:06d}"
                mine = f"{root}/.shard-{shard:06d}-{task.taskAttemptId()}"
                out, own = store.open_output_stream(mine + ".ids"), store.open_output_stream(mine + ".keys")
            got, n = enc.encode(b["__text"].tolist())
            whole = np.empty(len(got) + len(n), np.uint32)
            last = np.cumsum(n + 1) - 1
            place = np.ones(len(whole), bool)
            place[last] = False
            whole[place], whole[last] = got, end_id
            a, d = 0, 0
            while d < len(n):  # a block ends with a document
                room = BLOCK - held
                e = max(d + 1 if not held else d, int(np.searchsorted(last + 1, a + room, "right")))
                if e > d:
                    z = int(last[e - 1]) + 1
                    ids.append(whole[a:z])
                    lengths.append(n[d:e] + 1)
                    keys.append(b[["id", "no_id"]].iloc[d:e])
                    held, a, d = held + z - a, z, e
                if d < len(n) or held >= BLOCK:
                    close()
                    held = 0
            docs, tokens = docs + len(n), tokens + len(whole)
        if store is not None:
            if held:
                close()
            out.close()
            own.close()
            for end in (".keys", ".ids"):
                store.move(mine + end, name + end)
            yield pd.DataFrame([(shard, f"{folder}/{os.path.basename(name)}", docs, tokens, size)], columns=[c.split()[0] for c in MANIFEST.split(", ")])

    rows = df.select(F.col(key).cast("bigint").alias("__key"), *whole_id(key), F.col(column).alias("__text"), F.monotonically_increasing_id().alias("__nr"))
    return rows.repartitionByRange("__key", "__nr").sortWithinPartitions("__key", "__nr").select("id", "no_id", "__text").mapInPandas(write, MANIFEST)


def read_token_files(spark: SparkSession, shards: list[tuple[str, int]], make, schema: str) -> DataFrame:
    """`make(keys, none, ids, lengths, start)` -> rows (none: the key is null), for every block of every shard (path, ids before it), a task per shard."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, start in zip(b["path"], b["start"].tolist()):
                store, root = _filesystem(path)
                with store.open_input_stream(root + ".ids") as raw, store.open_input_stream(root + ".keys") as own:
                    for ids, lengths in blocks(io.BufferedReader(raw)):
                        n = len(lengths)
                        keys = np.frombuffer(own.read(8 * n), np.int64)
                        yield make(keys, np.frombuffer(own.read(n), bool), ids, lengths, start)
                        start += len(ids)

    where = spark.createDataFrame(shards, "path string, start bigint")
    return where.repartition(max(1, len(shards)), "path").mapInPandas(read, schema)


SCHEMA = "id bigint, no_id boolean, start bigint, n_tokens bigint, ids_crc32 bigint"


def _digest(keys: np.ndarray, none: np.ndarray, ids: np.ndarray, lengths: np.ndarray, start: int) -> pd.DataFrame:
    ends = np.cumsum(lengths)
    raw = memoryview(ids.astype("<u4")).cast("B")
    crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
    return pd.DataFrame({"id": keys, "no_id": none, "start": start + ends - lengths, "n_tokens": lengths, "ids_crc32": crc})


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files' documents, digested from what the files hold; the driver keeps a path and a count per shard."""
    folder = new_folder(spark, "ids")
    manifest = write_token_files(documents(spark, sf_dir), "doc_id", "text", folder, tokenizer_path("byte_bpe_50k.json"), "byte", 0)
    shards, start = [], 0
    for row in sorted(manifest.select("shard", "path", "tokens").collect()):
        shards.append((row.path, start))
        start += row.tokens
    return read_token_files(spark, shards, _digest, SCHEMA).select(id_again().alias("doc_id"), "start", "n_tokens", "ids_crc32")
