"""String similarities and the match score."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldweave.functions import fixed as X


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length of the lower-cased strings; 0 where one is null or empty."""
    x, y = F.lower(a), F.lower(b)
    longer = F.greatest(F.length(x), F.length(y))
    return F.when((F.length(x) > 0) & (F.length(y) > 0), 1 - F.levenshtein(x, y) / longer).otherwise(0.0)


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro's similarity; over 0.7 it is raised by a tenth of the rest for each of up to four common first letters."""
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    left: list[str] = []
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == ch), None)
        if j is not None:
            free[j] = False
            left.append(ch)
    m = len(left)
    if not m:
        return 0.0
    right = [ch for ch, f in zip(b, free) if not f]
    moved = sum(x != y for x, y in zip(left, right)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((k for k in range(4) if k >= len(a) or k >= len(b) or a[k] != b[k]), 4)
    return jaro + 0.1 * prefix * (1 - jaro) if jaro > 0.7 else jaro


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text in a row, 0 beyond its end, and the lengths."""
    n = np.array([len(t) for t in texts])
    joined = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.zeros((len(texts), int(n.max(initial=0))), np.uint32)
    out[np.arange(out.shape[1]) < n[:, None]] = joined
    return out, n


def jaro_winkler_many(a: list[str], b: list[str]) -> np.ndarray:
    """jaro_winkler_of() of pairs of texts that aren't empty, all pairs at a time."""
    (x, n), (y, m) = _codes(a), _codes(b)
    reach = np.maximum(np.maximum(n, m) // 2 - 1, 0)
    at = np.arange(y.shape[1])
    free = at < m[:, None]
    hit = np.zeros(x.shape, bool)
    rows = np.arange(len(x))
    for i in range(x.shape[1]):
        near = free & (y == x[:, i : i + 1]) & (np.abs(at - i) <= reach[:, None]) & (i < n)[:, None]
        j = near.argmax(axis=1)
        hit[:, i] = near[rows, j]
        free[rows[hit[:, i]], j[hit[:, i]]] = False
    used = (at < m[:, None]) & ~free
    common = hit.sum(axis=1)
    # matched letters of both sides in their order, side by side
    width = int(common.max(initial=0))
    side = lambda codes, mask: np.take_along_axis(codes, np.argsort(~mask, axis=1, kind="stable"), axis=1)[:, :width]
    differ = (side(x, hit) != side(y, used)) & (np.arange(width) < common[:, None])
    k = np.maximum(common, 1)
    jaro = np.where(common > 0, (common / n + common / m + (k - differ.sum(axis=1) // 2) / k) / 3, 0.0)
    first = min(4, x.shape[1], y.shape[1])
    alike = (x[:, :first] == y[:, :first]) & (x[:, :first] > 0)
    prefix = np.cumprod(alike, axis=1).sum(axis=1)
    return np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)


@F.pandas_udf(T.DoubleType())
def _jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = pd.DataFrame({"a": a.to_numpy(), "b": b.to_numpy()}, dtype=object)
    out = np.zeros(len(pairs))
    some = np.flatnonzero(pairs.notna().all(axis=1).to_numpy())
    some = some[[bool(x) and bool(y) for x, y in zip(pairs["a"].iloc[some], pairs["b"].iloc[some])]] if len(some) else some
    if len(some):  # pairs repeat within a batch; long texts are taken by themselves
        place, kinds = pd.factorize(pd.MultiIndex.from_frame(pairs.iloc[some]))
        sizes = np.array([max(map(len, p)) for p in kinds])
        scores = np.empty(len(kinds))
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            end = at + 1
            while end < len(order) and (end - at + 1) * int(sizes[order[end]]) <= 1 << 21:
                end += 1
            part = order[at:end]
            scores[part] = jaro_winkler_many([kinds[i][0] for i in part], [kinds[i][1] for i in part])
            at = end
        out[some] = scores[place]
    return pd.Series(out)


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    return _jaro_winkler(F.lower(a), F.lower(b))


def match_score(name_a: Column, name_b: Column, company_a: Column, company_b: Column) -> Column:
    """Weighted names and companies; names alone where a company is missing."""
    names = levenshtein_similarity(name_a, name_b)
    both = (F.length(company_a) > 0) & (F.length(company_b) > 0)
    return F.when(both, names * X.NAME_WEIGHT + jaro_winkler_similarity(company_a, company_b) * X.COMPANY_WEIGHT).otherwise(names)


def match_status(score: Column) -> Column:
    return F.when(score > X.CONFIRMED, "CONFIRMED").when(score >= X.PROBABLE, "PROBABLE_MANUAL_REVIEW").otherwise("NO_MATCH")
