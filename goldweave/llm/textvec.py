"""Vectorised byte-level views of many texts at once: words, their 64-bit hashes and k-grams.

Everything works on the joined UTF-8 bytes of a batch.  A span's hash is a difference of
prefix sums of byte * P**position, brought to position 0 by the inverse power, and then mixed
with the span's length; equal bytes get equal hashes wherever they stand.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
_power: tuple[np.ndarray, np.ndarray] = (np.ones(1, U), np.ones(1, U))

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Bytes of words: digits, lower-cased letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words between ASCII white space.
NONSPACE = np.ones(256, bool)
NONSPACE[9:14] = NONSPACE[32] = False


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i for i < n, modulo 2**64; the tables grow to the longest batch seen."""
    global _power
    if len(_power[0]) < n:
        size = max(n, 1 << 20)
        made = []
        for base in (_P, _INV):
            t = np.full(size, base, U)
            t[0] = 1
            made.append(np.cumprod(t, dtype=U))
        _power = tuple(made)
    return _power


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of splitmix64)."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def pack(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Joined UTF-8 bytes, each text followed by a newline, and the n + 1 starts."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    starts = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=starts[1:])
    return np.frombuffer(b"\n".join(raw) + b"\n", np.uint8) if raw else np.empty(0, np.uint8), starts


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
    return edge[::2], edge[1::2]


def span_hash(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    p, inv = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, U)
    np.cumsum((buf.astype(U) + U(1)) * p[: len(buf)], dtype=U, out=total[1:])
    return mix((total[e] - total[s]) * inv[s] + (e - s).astype(U))


def words(texts: list[str | None], inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, n + 1 starts of each text's words); A-Z is lower-cased."""
    buf, starts = pack(texts)
    if not len(buf):
        return np.empty(0, U), np.zeros(len(texts) + 1, np.int64)
    buf = LOWER[buf]
    s, e = spans(inside[buf])
    return span_hash(buf, s, e), np.searchsorted(s, starts)


def kgrams(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive hashes of each k consecutive words of one sequence of word hashes."""
    if len(h) < k:
        return np.empty(0, U)
    out = np.zeros(len(h) - k + 1, U)
    for i in range(k):
        out = out * U(_P) + h[i : len(h) - k + 1 + i]
    return mix(out)


def kgrams_of(h: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-grams that stay within a text: (hashes, n + 1 starts)."""
    n = np.diff(starts)
    counts = np.maximum(n - k + 1, 0)
    at = np.zeros(len(n) + 1, np.int64)
    np.cumsum(counts, out=at[1:])
    everywhere = kgrams(h, k)
    if not len(everywhere):
        return everywhere, np.zeros(len(n) + 1, np.int64)
    take = np.repeat(starts[:-1] - at[:-1], counts) + np.arange(at[-1])
    return everywhere[take], at


def give_back() -> None:
    """Returns freed memory to the system: a worker lives on beside later steps, and its allocators would keep the most that each step has used."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def relieved(batches: Iterable) -> Iterator:
    """The batches; what working on them took is given back after the last one."""
    yield from batches
    give_back()


def chunks(texts: list[str | None], most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `most` characters, each of one text at least; what they took is given back after the last one."""
    a, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and size + n > most:
            yield a, i
            a, size = i, 0
        size += n
    if a < len(texts):
        yield a, len(texts)
        give_back()
