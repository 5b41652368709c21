"""SetSketch registers: exponentially spaced, truncated minima of exponential variables.

Register i of a set is clamp(floor(1 - log_b(x_i)), 0, q + 1), x_i the minimum over the set's elements of
exponentially distributed values with rate a that depend on (i, element) only.  Registers of a union
are the larger ones of its parts.  With b close to 1 two registers are equal almost as often as the
Jaccard similarity says; the joint likelihood of greater, smaller and equal registers, given the
sizes, estimates that similarity.
"""

from __future__ import annotations

import math

import numpy as np

M, ROWS, BASE, RATE, LIMIT = 160, 4, 1.0005, 20.0, 65534
#: See likely().
SLACK = 14.0
_rng = np.random.default_rng(20240229)
_XOR = _rng.integers(0, 1 << 32, 4096, dtype=np.uint64).astype(np.uint32)
_MUL = _rng.integers(0, 1 << 32, 4096, dtype=np.uint64).astype(np.uint32) | np.uint32(1)


def registers(hashes: np.ndarray, starts: np.ndarray, m: int = M) -> np.ndarray:
    """(sets, m) uint16: of the 64-bit element hashes from starts[i] to starts[i + 1]; empty sets have zeros."""
    n = np.diff(starts)
    out = np.zeros((len(n), m), np.uint16)
    full = np.flatnonzero(n > 0)
    if not len(full):
        return out
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    cuts = starts[:-1][full]
    least = np.empty((m, len(full)), np.uint32)
    for i in range(m):
        x = (h ^ _XOR[i]) * _MUL[i]
        x ^= x >> np.uint32(15)
        np.minimum.reduceat(x, cuts, out=least[i])
    u = (least.astype(np.float64) + 0.5) / 2.0**32
    x = -np.log1p(-u) / RATE
    k = np.floor(1 - np.log(x) / math.log(BASE))
    out[full] = np.clip(k, 0, LIMIT + 1).astype(np.uint16).T
    return out


def bands(regs: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(sets, m / rows) 64-bit keys, each of a band's number and its registers' values."""
    from goldweave.llm import textvec as V

    sets, m = regs.shape
    parts = regs[:, : m // rows * rows].reshape(sets, m // rows, rows).astype(np.uint64)
    key = np.broadcast_to(np.arange(m // rows, dtype=np.uint64), parts.shape[:2]).copy()
    for j in range(rows):
        key = V.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return key.view(np.int64)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)


_GRID = np.linspace(0.0, 1.0, 41)


def likely(more: np.ndarray, less: np.ndarray, equal: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, least: float, slack: float = SLACK) -> tuple[np.ndarray, np.ndarray]:
    """(estimated similarity, whether `least` or more can't be ruled out).

    more, less: registers greater in a, in b.  Ruled out: the log-likelihood at every similarity from `least` on is
    lower than the best one by over `slack` (14: of pairs right at `least`, less than one in ten million is, by Wilks' approximation).
    """
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    top = np.minimum(u / v, v / u)  # the largest similarity that these sizes allow
    j = np.concatenate([_GRID[None, :] * top, np.minimum(least, top)], axis=1)  # the bound itself is looked at, too
    up, down = np.maximum(_p(u - v * j), 1e-12), np.maximum(_p(v - u * j), 1e-12)
    log = more[:, None] * np.log(up) + less[:, None] * np.log(down) + equal[:, None] * np.log(np.maximum(1 - up - down, 1e-12))
    best = log.argmax(axis=1)
    far = np.where(j >= np.minimum(least, top) - 1e-9, log, -np.inf).max(axis=1)
    return j[np.arange(len(j)), best], far >= log.max(axis=1) - slack
