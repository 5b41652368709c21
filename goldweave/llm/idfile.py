"""Files of token ids: frequency-ranked, byte-aligned codes with control bytes apart.

A file is a run of blocks, each complete in itself.  A block of whole documents holds the
ids that occur in it ordered by falling frequency (ties: smaller id); a token is written as
its place in that order in 1 to 4 bytes, and the four lengths of four tokens share one control
byte, two bits each.  Common tokens thus take one byte, and decoding is a table lookup per
control byte and one gather, all in numpy.

Layout, little-endian: magic, documents, tokens, ids in the order (3 x uint32 after 4 bytes);
then the order (uint32 each), documents' lengths (uint32 each), control bytes, data bytes.
"""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np

MAGIC = b"GWT1"
_HEAD = struct.Struct("<4s3I")
#: Of every control byte: the lengths of its four codes.
_LENGTHS = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)], np.int64)


def encode_block(ids: np.ndarray, lengths: np.ndarray) -> bytes:
    """ids of whole documents, whose lengths add up to len(ids)."""
    if len(ids) >= 1 << 32:
        raise ValueError("a block holds fewer than 2**32 tokens")
    used, place, counts = np.unique(ids, return_inverse=True, return_counts=True)
    order = np.lexsort((used, -counts))
    rank = np.empty(len(used), np.uint32)
    rank[order] = np.arange(len(used), dtype=np.uint32)
    codes = rank[place]
    n = (codes > 0xFF).astype(np.uint8) + (codes > 0xFFFF) + (codes > 0xFFFFFF)
    four = np.zeros(-(-len(codes) // 4) * 4, np.uint8)
    four[: len(n)] = n
    control = four[0::4] | four[1::4] << 2 | four[2::4] << 4 | four[3::4] << 6
    size = n.astype(np.int64) + 1
    at = np.cumsum(size) - size
    data = np.empty(int(size.sum()), np.uint8)
    data[at] = codes & 0xFF
    for k in range(1, 4):
        if not len(wide := np.flatnonzero(n >= k)):
            break
        data[at[wide] + k] = codes[wide] >> 8 * k & 0xFF
    return b"".join((_HEAD.pack(MAGIC, len(lengths), len(ids), len(used)), used[order].astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), control.tobytes(), data.tobytes()))


def decode_block(read: io.BufferedIOBase) -> tuple[np.ndarray, np.ndarray] | None:
    """The next block's (ids uint32, lengths), or None at the end."""
    head = read.read(_HEAD.size)
    if not head:
        return None
    magic, docs, tokens, used = _HEAD.unpack(head)
    if magic != MAGIC:
        raise ValueError("not a file of token ids")
    order = np.frombuffer(read.read(4 * used), "<u4")
    lengths = np.frombuffer(read.read(4 * docs), "<u4").astype(np.int64)
    control = np.frombuffer(read.read(-(-tokens // 4)), np.uint8)
    size = _LENGTHS[control].ravel()[:tokens]
    ends = np.cumsum(size)
    data = np.frombuffer(read.read(int(ends[-1]) if tokens else 0), np.uint8)
    at = ends - size
    codes = data[at].astype(np.uint32)
    for k in range(1, 4):
        if not len(wide := np.flatnonzero(size > k)):
            break
        codes[wide] |= data[at[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return order[codes], lengths


def blocks(read: io.BufferedIOBase) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    while (got := decode_block(read)) is not None:
        yield got
