"""Language identification with a bit-sliced Bloom filter over letter n-grams.

Slot i of the filter holds a mask with a bit per language: one look-up of an n-gram reads a few slots
and their AND is the set of all languages that contain it.  A document's count for a language is the
number of its n-grams with that bit; as a share p of a language's bits is set, p**hashes of foreign
n-grams hit it by chance, and the count is corrected by that.  The most corrected hits decide.  Languages
beyond the first 64 have further slices of masks, at the same slots.

An n-gram belongs to each language in which its document frequency is at least `share` of its
highest one, over labelled texts, so that some wrong labels don't matter.  The filter is learned
from a bounded sample of labelled rows (`most` documents per language, chosen by a hash); its size
depends on that bound only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.llm import textvec as V

GRAM, HASHES, MOST_PER_LANGUAGE, SHARE, LEAST_DOCS, SLICE = 5, 4, 2_000, 0.25, 3, 64
_FOLD = V.LOWER.copy()
_FOLD[: ord("A")] = _FOLD[91:97] = _FOLD[123:128] = 32


def _letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letters (and all bytes beyond ASCII), each run after one blank, and the texts' starts."""
    buf, starts = V.pack(texts)
    c = _FOLD[buf]
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
    if len(c):
        keep[starts[1:-1]] = True
        keep[starts[1:] - 1] = True  # a text ends with a blank of its own
    at = np.zeros(len(c) + 1, np.int64)
    np.cumsum(keep, out=at[1:])
    return c[keep], at[starts]


def grams(texts: list[str | None], n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """(n bytes of each place as one number, the text of each place); places whose bytes cross into the next text are left out.

    A word shorter than n - 2 bytes counts with its neighbours; texts of one short word are filled with blanks.
    """
    texts = [f" {t or ''}{' ' * (n if len(t or '') < n else 1)}" for t in texts]
    c, starts = _letters(texts)
    short = np.diff(starts) < n
    if short.any():  # blanks were squeezed: give these texts the rest of an n-gram
        parts = [np.concatenate([c[a:b], np.full(max(0, n - (b - a)), 32, np.uint8)]) for a, b in zip(starts[:-1], starts[1:])]
        c, starts = np.concatenate(parts), np.append(0, np.cumsum([len(p) for p in parts]))
    m = len(c) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    key = np.zeros(m, np.uint64)
    for i in range(n):
        key |= c[i : m + i].astype(np.uint64) << np.uint64(8 * i)
    of = np.repeat(np.arange(len(texts)), np.diff(starts))[:m]
    inside = np.ones(m, bool)
    for z in starts[1:-1]:
        inside[max(0, z - n + 1) : z] = False
    return key[inside], of[inside]


def _bit(masks: np.ndarray, k: int) -> np.ndarray:
    """Of each mask, the bit of language k."""
    kind = masks.dtype.type
    return masks[k // SLICE] >> kind(k % SLICE) & kind(1)


@dataclass
class Filter:
    languages: list[str]
    slots: np.ndarray  # (slices, slots) masks
    share: np.ndarray  # of set bits, per language

    def masks(self, keys: np.ndarray) -> np.ndarray:
        """(slices, n-grams): for each n-gram, the languages whose filters hold it."""
        h = V.mix(keys)
        step = (h >> np.uint64(32)) | np.uint64(1)
        size = np.uint64(self.slots.shape[1] - 1)
        got = self.slots[:, h & size]
        for i in range(1, HASHES):
            got &= self.slots[:, (h + np.uint64(i) * step) & size]
        return got

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(corrected hits of each text and language, n-grams of each text)."""
        keys, of = grams(texts)
        masks, n = self.masks(keys), np.bincount(of, minlength=len(texts)).astype(float)
        chance = self.share**HASHES
        hits = np.empty((len(texts), len(self.languages)))
        for k in range(len(self.languages)):
            own = np.bincount(of, _bit(masks, k).astype(float), minlength=len(texts))
            hits[:, k] = np.clip((own - n * chance[k]) / max(1 - chance[k], 1e-9), 0, None)
        return hits, n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language or `und`, score): the score is the corrected share of the text's n-grams that the winner claims, 0 to 1.

        `und` is for null texts and texts without a letter (score 0).  Ties go to the language with more
        documents; a text with no known n-gram gets the commonest one with score 0.
        """
        names: list[str] = []
        scores = np.zeros(len(texts))
        for a, b in V.chunks(texts):
            part = texts[a:b]
            hits, n = self.counts(part)
            best = hits.argmax(axis=1)
            scores[a:b] = np.clip(hits[np.arange(len(part)), best] / np.maximum(n, 1), 0, 1)
            names += [self.languages[k] for k in best]
        for i, t in enumerate(texts):
            if not t or not has_letter(t):
                names[i], scores[i] = "und", 0.0
        return names, scores


def has_letter(text: str) -> bool:
    return text.isalpha() or any(c.isalpha() for c in text)


def build(masks: tuple[np.ndarray, np.ndarray], languages: list[str]) -> Filter:
    """masks: (n-grams, (slices, n-grams) their languages)."""
    keys, of = masks
    kind = np.uint8 if len(languages) <= 8 else np.uint16 if len(languages) <= 16 else np.uint32 if len(languages) <= 32 else np.uint64
    size = 1 << max(12, int(np.ceil(np.log2(max(1, len(keys)) * 8))))
    slots = np.zeros((len(of), size), kind)
    h = V.mix(keys)
    step = (h >> np.uint64(32)) | np.uint64(1)
    for i in range(HASHES):
        at = (h + np.uint64(i) * step) & np.uint64(size - 1)
        for own, masks_ in zip(slots, of):
            np.bitwise_or.at(own, at, masks_.astype(kind))
    share = np.array([_bit(slots, k).mean() for k in range(len(languages))])
    return Filter(languages, slots, share)


def _frequencies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, n-gram, documents: summed within about a MB of texts before anything is shuffled."""
    for b in batches:
        for lang, texts in b.groupby("lang")["text"]:
            texts = texts.tolist()
            for x, y in V.chunks(texts):
                keys, of = grams(texts[x:y])
                order = np.lexsort((keys, of))
                k, f = keys[order], of[order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (f[1:] != f[:-1])
                keys, n = np.unique(k[new], return_counts=True)
                yield pd.DataFrame({"lang": lang, "gram": keys.view(np.int64), "docs": n})


def fit(df: DataFrame, text: str = "text", lang: str = "lang", most: int = MOST_PER_LANGUAGE, share: float = SHARE, least: int = LEAST_DOCS) -> Filter | None:
    """Learn the filter from the rows of df with a language; None if there is none.

    most: about so many documents of each language, chosen by a hash of row and text.  Every language has a bit; those with
    the most documents come first in Filter.languages.
    """
    spark = df.sparkSession
    rows = df.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), *([F.col("doc_id")] if "doc_id" in df.columns else [])).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()}
    if not sizes:
        return None
    languages = list(sizes)  # most documents first: a text without evidence gets the commonest
    kinds = F.broadcast(spark.createDataFrame([(k, i // SLICE, i % SLICE, min(1.0, most / n), float(min(most, n))) for i, (k, n) in enumerate(sizes.items())], "lang string, slice int, bit int, keep double, size double"))
    unit = F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = rows.withColumn("unit", unit).join(kinds.select("lang", "keep"), "lang").filter("unit < keep").select("lang", "text")
    found = sample.mapInPandas(_frequencies, "lang string, gram bigint, docs bigint").groupBy("gram", "lang").agg(F.sum("docs").alias("docs"))
    found = found.join(kinds, "lang").select("gram", "slice", "bit", "docs", (F.col("docs") / F.col("size")).alias("rate"))
    each = found.groupBy("gram").agg(F.max("rate").alias("top"), F.sum("docs").alias("docs"), F.collect_list(F.struct("slice", "bit", "rate")).alias("by"))
    slices = (len(languages) - 1) // SLICE + 1
    masks = [F.expr(f"aggregate(by, 0L, (m, x) -> m | if(x.slice = {i} and x.rate >= top * {share}, shiftleft(1L, x.bit), 0L))").alias(f"m{i}") for i in range(slices)]
    got = each.filter(F.col("docs") >= least).select("gram", *masks).toPandas()
    of = np.stack([got[f"m{i}"].to_numpy(np.int64).view(np.uint64) for i in range(slices)])
    return build((got["gram"].to_numpy(np.int64).view(np.uint64), of), languages)


def identify(df: DataFrame, model: Filter | None, keep: list[str], text: str = "text") -> DataFrame:
    """The columns of `keep`, lang_pred and score of every row.  Without a model all texts are `und`.

    Only the texts go through Python; repeated rows have results of their own.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        names, scores = sent.value.predict(texts.tolist()) if sent.value else (["und"] * len(texts), np.zeros(len(texts)))
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return df.select(*keep, predicted(F.col(text)).alias("__found")).select(*keep, "__found.lang_pred", "__found.score")


def accepts(df: DataFrame, model: Filter | None, text: str, least: float) -> F.Column:
    """A column: the text has a language, with a score of at least `least`."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def ok(texts: pd.Series) -> pd.Series:
        if sent.value is None:
            return pd.Series([t is not None and has_letter(t) for t in texts])
        names, scores = sent.value.predict(texts.tolist())
        return pd.Series((scores >= least) & (np.array(names, object) != "und"))

    return ok(F.col(text))
