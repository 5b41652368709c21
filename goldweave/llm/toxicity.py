"""Toxicity by a chain of linear models.

Categories are predicted in a fixed order.  Each model is a logistic regression on the presence of chosen
features and on the earlier categories' probabilities.  For training, those are out-of-fold: every fold's
rows get them from models that have not seen the fold, so that later models learn how far earlier ones
can be trusted.  Features are chosen for each fold on the other folds' rows too, so that nothing of a fold has seen its
labels.  A category's threshold is the one with the best F1, at a precision of 0.8 or
more, on out-of-fold probabilities; where no cut is so precise, at twice the category's rate or more.

Features are hashed words and byte 5-grams of the lower-cased letters (so that forms of a stem count
together).  Learned from a bounded sample of labelled rows (`most`, chosen by a hash): rows of rare labels are all drawn
as far as there is room, and weights and the bias put their share right.  Document frequencies by
category are summed in Spark, of the features that surely tell a category those with the highest scores are kept, and the sample's rows come to
the driver as places of kept features only.  Scoring reads each whole text once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.llm import textvec as V
from goldweave.llm.langid import grams
from goldweave.plans.staging import staged

MOST, FEATURES, FOLDS, LEAST_DOCS = 10_000, 2048, 5, 4
#: Features count that a category has more often by so many standard errors; what speaks for the rest is the bias, as
#: long clean texts hold many features that are rarer in a category by chance.
LEAST_Z, L2 = 6.0, 0.1
#: LEAST_Z is that of MOST texts; of fewer it is the like effect (z grows with the root of their number), but beyond chance.
BEYOND_CHANCE = 4.0
#: Of the training texts that a threshold flags, out of fold, so many must belong to the category.
PRECISION = 0.8
#: Where no threshold is so precise: at least so many times the category's rate.
LIFT = 2.0


def occurrences(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed feature, its text) of every word and 5-gram."""
    h, starts = V.words(texts, V.ALNUM)
    g, of = grams(texts)
    key = np.concatenate([V.mix(h), V.mix(g ^ np.uint64(0x5BD1E995))])
    return key, np.concatenate([np.repeat(np.arange(len(texts)), np.diff(starts)), of])


def distinct(key: np.ndarray, own: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct keys of each text, n + 1 starts)."""
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    key, own = key[new], own[new]
    return key, np.searchsorted(own, np.arange(texts + 1))


@dataclass
class Linear:
    weights: np.ndarray
    extra: np.ndarray  # of the earlier categories' probabilities
    bias: float

    def predict(self, at: np.ndarray, starts: np.ndarray, before: np.ndarray) -> np.ndarray:
        z = _row_sums(self.weights[at], starts) + self.bias + (before @ self.extra if before.shape[1] else 0)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _row_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.append(0.0, np.cumsum(values))
    return total[starts[1:]] - total[starts[:-1]]


def train(at: np.ndarray, starts: np.ndarray, before: np.ndarray, y: np.ndarray, size: int, l2: float = L2, steps: int = 60) -> Linear:
    """Ridge logistic regression by L-BFGS; a column without both classes gives a constant model."""
    extra = before.shape[1]
    rate = min(max(y.mean() if len(y) else 0.0, 1e-4), 1 - 1e-4)
    theta = np.zeros(size + extra + 1)
    theta[-1] = np.log(rate / (1 - rate))
    rows = np.repeat(np.arange(len(y)), np.diff(starts))

    def model(t: np.ndarray) -> Linear:
        return Linear(t[:size], t[size:-1], float(t[-1]))

    def loss(t: np.ndarray) -> tuple[float, np.ndarray]:
        p = model(t).predict(at, starts, before)
        r = p - y
        g = np.concatenate([np.bincount(at, r[rows], minlength=size), before.T @ r, [r.sum()]])
        g[:-1] += l2 * t[:-1]
        p = np.clip(p, 1e-12, 1 - 1e-12)
        return -(y * np.log(p) + (1 - y) * np.log(1 - p)).sum() + l2 / 2 * (t[:-1] ** 2).sum(), g

    if not 0 < y.sum() < len(y):
        return model(theta)
    value, g = loss(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        d, kept = g.copy(), []
        for s, z in reversed(past):
            a = s @ d / (s @ z)
            kept.append(a)
            d -= a * z
        if past:
            s, z = past[-1]
            d *= s @ z / (z @ z)
        else:
            d /= max(1.0, np.linalg.norm(d))
        for (s, z), a in zip(past, reversed(kept)):
            d += s * (a - z @ d / (s @ z))
        step = 1.0
        for _ in range(20):  # until the loss falls enough
            new_value, new_g = loss(theta - step * d)
            if new_value <= value - 1e-4 * step * (g @ d):
                break
            step /= 2
        else:
            break
        s, z = -step * d, new_g - g
        theta, g = theta + s, new_g
        if s @ z > 1e-10:
            past = [*past[-9:], (s, z)]
        if value - new_value < 1e-7 * abs(value):
            break
        value = new_value
    return model(theta)


def best_threshold(p: np.ndarray, y: np.ndarray, precision: float = PRECISION, weight: np.ndarray | None = None) -> float:
    """Half-way between the probabilities around the best cut by F1 of those with enough precision, or else with enough lift.

    2 (never) without a positive row, or if no cut has LIFT times the category's rate: everything would otherwise be the
    best guess by F1.
    """
    if not y.sum():
        return 2.0
    w = np.ones(len(y)) if weight is None else weight
    order = np.argsort(-p, kind="stable")
    hits, n = np.cumsum((w * y)[order]), np.cumsum(w[order])
    f1 = 2 * hits / (n + hits[-1])
    f1[:-1][p[order][:-1] == p[order][1:]] = -1  # a cut lies between different probabilities
    for least in (precision, min(precision, LIFT * hits[-1] / n[-1])):
        some = np.where(hits >= least * n, f1, -1.0)
        k = int(np.argmax(some))
        if some[k] > 0:
            return float(p[order][k] + (p[order][k + 1] if k + 1 < len(p) else 0.0)) / 2
    return 2.0


@dataclass
class Chain:
    names: list[str]
    keys: np.ndarray  # kept features, sorted
    models: list[Linear] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)

    def places(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(places of kept features in each text, n + 1 starts); most occurrences are ruled out by their upper 16 bits."""
        key, own = occurrences(texts)
        if not len(self.keys):
            return np.empty(0, np.int64), np.zeros(len(texts) + 1, np.int64)
        upper = np.zeros(1 << 16, bool)
        upper[self.keys >> np.uint64(48)] = True
        some = np.flatnonzero(upper[key >> np.uint64(48)])
        key, own = key[some], own[some]
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        known = self.keys[k] == key
        return distinct(k[known], own[known], len(texts))

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """(texts, categories) probabilities, each category seeing the ones before it."""
        out = np.zeros((len(texts), len(self.names)))
        for a, b in V.chunks(texts):
            at, starts = self.places(texts[a:b])
            for c, m in enumerate(self.models):
                out[a:b, c] = m.predict(at, starts, out[a:b, :c])
        return out


def _part(at: np.ndarray, starts: np.ndarray, use: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, starts) of the rows of `use`, allowed features only."""
    n = np.diff(starts)
    ok = np.repeat(use, n) & allowed[at]
    left = np.bincount(np.repeat(np.arange(len(n)), n)[ok], minlength=len(n))[use]
    return at[ok], np.append(0, np.cumsum(left))


def fit_chain(names: list[str], keys: np.ndarray, at: np.ndarray, starts: np.ndarray, labels: np.ndarray, fold: np.ndarray, weight: np.ndarray | None = None, allowed: np.ndarray | None = None) -> Chain:
    """labels (rows, categories) of 0 and 1; fold: each row's fold; weight: how many rows each stands for.

    allowed (folds + 1, features): the features that each fold's models, and at last the chain itself, may use.
    """
    w = np.ones(len(labels)) if weight is None else weight
    allowed = np.ones((int(fold.max(initial=0)) + 2, len(keys)), bool) if allowed is None else allowed
    own = np.flatnonzero(allowed[-1])
    chain = Chain(names, keys[own])
    place = np.zeros(len(keys), np.int64)
    place[own] = np.arange(len(own))
    everyone = np.ones(len(labels), bool)
    final, final_starts = _part(at, starts, everyone, allowed[-1])
    final = place[final]

    def fitted(part: np.ndarray, at_starts: np.ndarray, before: np.ndarray, y: np.ndarray, own: np.ndarray, size: int) -> Linear:
        """The bias is that of the rows' own share of positives, not of the drawn one."""
        m = train(part, at_starts, before, y, size)
        if 0 < y.sum() < len(y):
            m.bias += float(np.log(own @ y / (own @ (1 - y))) - np.log(y.sum() / (len(y) - y.sum())))
        return m

    out_of_fold = np.zeros(labels.shape)
    for c in range(len(names)):
        before, y = out_of_fold[:, :c], labels[:, c].astype(float)
        for f in np.unique(fold):
            use = fold != f
            m = fitted(*_part(at, starts, use, allowed[f]), before[use], y[use], w[use], len(keys))
            out_of_fold[~use, c] = m.predict(*_part(at, starts, ~use, allowed[f]), before[~use])
        chain.models.append(fitted(final, final_starts, before, y, w, len(own)))
        chain.thresholds.append(best_threshold(out_of_fold[:, c], y, weight=w))
    return chain


def rates(sizes: list[int], most: int) -> list[float]:
    """The share to draw of each kind of rows: the same number of each, or all where there are fewer; about `most` together."""
    out, left = [0.0] * len(sizes), float(most)
    for i, k in enumerate(sorted(range(len(sizes)), key=lambda k: sizes[k])):
        drawn = min(float(sizes[k]), left / (len(sizes) - i))
        out[k], left = drawn / max(1, sizes[k]), left - drawn
    return out


def fit(docs: DataFrame, labels: DataFrame, categories: list[str], key: str = "doc_id", text: str = "text", most: int = MOST, count: int = FEATURES, folds: int = FOLDS, least: int = LEAST_DOCS) -> Chain:
    """labels: key and a 0/1 column for each category, in the order of the chain; the texts are in docs.

    About `most` labelled keys are drawn by a hash, evenly from the combinations of labels, so that side of the join is bounded and sent to the texts.  Rows with a
    null label or key are left out; of several labels the highest counts; null texts count as empty.  Copies of a
    text are one row.  Without rows the chain predicts nothing.
    """
    spark = docs.sparkSession
    ys = [f"y{i}" for i in range(len(categories))]
    known = labels.select(F.col(key).alias("k"), *(F.col(c).cast("int").alias(y) for c, y in zip(categories, ys))).dropna()
    known = known.groupBy("k").agg(*(F.max(y).alias(y) for y in ys))
    kinds = known.groupBy(*ys).count().collect()
    share = F.lit(1.0)
    for r, s in zip(kinds, rates([r["count"] for r in kinds], most)):
        share = F.when(F.struct(*ys) == F.struct(*(F.lit(r[y]).alias(y) for y in ys)), s).otherwise(share)
    drawn = known.withColumn("w", 1 / share).filter(F.pmod(F.xxhash64("k", F.lit(2)), F.lit(1 << 20)) * F.col("w") < (1 << 20))
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(drawn), "k").withColumn("h", F.xxhash64("text"))
    # copies in thousands add nothing to a model
    rows = staged(rows.groupBy("h").agg(F.first("text").alias("text"), F.max("w").alias("w"), *(F.max(y).alias(y) for y in ys)), "labelled")
    if rows.isEmpty():
        return Chain(categories, np.empty(0, np.uint64))

    rows = rows.withColumn("fold", F.pmod(F.shiftright("h", 21), F.lit(folds)).cast("int"))

    def frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """key, fold, n, ys: texts with the feature and of each category, summed within about a MB of texts."""
        for b in batches:
            texts = b["text"].tolist()
            for x, z in V.chunks(texts):
                part = b.iloc[x:z]
                key, starts = distinct(*occurrences(texts[x:z]), z - x)
                row = np.repeat(np.arange(z - x), np.diff(starts))
                kinds, place = np.unique(key, return_inverse=True)
                both, place = np.unique(place * folds + part["fold"].to_numpy()[row], return_inverse=True)
                out = {"key": kinds[both // folds].view(np.int64), "fold": both % folds, "n": np.bincount(place, minlength=len(both))}
                yield pd.DataFrame(out | {y: np.bincount(place, part[y].to_numpy(float)[row], minlength=len(both)).astype(np.int64) for y in ys})

    counts = ["n", *ys]
    by_fold = [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).alias(f"{c}_{f}") for f in range(folds) for c in counts]
    found = rows.mapInPandas(frequencies, "key bigint, fold int, n bigint, " + ", ".join(f"{y} bigint" for y in ys)).groupBy("key").agg(*(F.sum(c).alias(c) for c in counts), *by_fold).filter(F.col("n") >= least)
    sums = {r["fold"]: r for r in rows.groupBy("fold").agg(F.count("*").alias("n"), *(F.sum(y).alias(y) for y in ys)).collect()}
    total = [sum(r[c] for r in sums.values()) for c in counts]

    def chosen(without: int | None) -> F.Column:
        """How surely the feature tells a category, in standard errors beyond the floor; without a fold's rows."""
        size, *pos = [t - (sums[without][c] if without in sums else 0) for t, c in zip(total, counts)]
        n, *with_ = [F.col(c) - (F.col(f"{c}_{without}") if without is not None else 0) for c in counts]
        best = F.lit(0.0)
        for y, k in zip(with_, pos):
            p = k / max(1, size)
            best = F.greatest(best, (y - n * p) / F.sqrt(n * F.lit(p * (1 - p) + 1e-9)))
        floor = max(BEYOND_CHANCE, LEAST_Z * min(1.0, size / MOST) ** 0.5)
        return F.when((n >= least) & (best >= floor), best)

    scores = {f"s{f}": chosen(f if f < folds else None) for f in range(folds + 1)}
    known_features = staged(found.select("key", *(v.alias(k) for k, v in scores.items())).filter(F.coalesce(*scores).isNotNull()), "features")
    tops = [known_features.filter(F.col(k).isNotNull()).orderBy(F.desc(k), "key").limit(count).select(F.lit(i).alias("model"), "key") for i, k in enumerate(scores)]
    kept = functools.reduce(DataFrame.unionByName, tops).toPandas()  # at most (folds + 1) * count rows
    keys = np.unique(kept["key"].to_numpy(np.int64).view(np.uint64))
    allowed = np.zeros((folds + 1, len(keys)), bool)
    allowed[kept["model"], np.searchsorted(keys, kept["key"].to_numpy(np.int64).view(np.uint64))] = True
    sent = spark.sparkContext.broadcast(Chain(categories, keys))

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["text"].tolist()
            for x, z in V.chunks(texts):
                at, starts = sent.value.places(texts[x:z])
                yield b[["h", "w", "fold", *ys]].iloc[x:z].assign(at=[at[i:j].astype(np.int32) for i, j in zip(starts[:-1], starts[1:])])

    got = rows.mapInPandas(project, "h bigint, w double, fold int, " + "".join(f"{y} int, " for y in ys) + "at array<int>").toPandas().sort_values("h", kind="stable")
    at = np.concatenate([np.asarray(a, np.int64) for a in got["at"]]) if len(got) else np.empty(0, np.int64)
    starts = np.append(0, np.cumsum([len(a) for a in got["at"]]))
    return fit_chain(categories, keys, at, starts, got[ys].to_numpy(), got["fold"].to_numpy(), got["w"].to_numpy(), allowed)


def score(df: DataFrame, model: Chain, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of `keep`, then p_<category> and is_<category> of each; a null text counts as empty."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    names = [x for c in model.names for x in (f"p_{c}", f"is_{c}")]

    @F.pandas_udf(", ".join(f"p_{c} double, is_{c} boolean" for c in model.names))
    def scored(texts: pd.Series) -> pd.DataFrame:
        m = sent.value
        p = m.predict(texts.tolist())
        cuts = m.thresholds or [2.0] * len(m.names)
        return pd.DataFrame({k: v for c, name in enumerate(m.names) for k, v in ((f"p_{name}", p[:, c]), (f"is_{name}", p[:, c] >= cuts[c]))})

    return df.select(*keep, scored(F.col(text)).alias("__found")).select(*keep, *(f"__found.{n}" for n in names))


def flags(df: DataFrame, model: Chain, category: str, text: str) -> F.Column:
    """A column: the text belongs to the category."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    c = model.names.index(category)

    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        m = sent.value
        return pd.Series(m.predict(texts.tolist())[:, c] >= m.thresholds[c] if m.thresholds else np.zeros(len(texts), bool))

    return hit(F.col(text))
