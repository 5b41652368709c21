"""Licence scan by diagonal voting.

All rolling word k-gram hashes of all documents are joined with the positions of the templates'
k-grams.  A match of document word p and template word t votes for the diagonal p - t.  A phrase
stands wherever one of its diagonals has all votes.  Of a longer template, neighbouring diagonals (words
put in or left out) are merged to runs, and a run is verified by the share of the template's words
that its best ordered chain of matches covers.  The templates, whose number is checked, are sent to all executors; after the
join only matches and one row per document are shuffled, once, by the document's row.

Null and empty texts have no words; repeated rows are results of their own; words are
runs of digits, letters and characters beyond ASCII after A-Z is lower-cased.  Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from goldweave.llm import textvec as V
from goldweave.llm.base import id_again, whole_id

K, GAP, COVER, MOST_SENT = 3, 3, 0.75, 100_000
#: Phrases with their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Well-known notices and whole licences with their labels.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES = {
    MIT: "mit",
    ISC: "isc",
    BSD_2: "bsd-2",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license": "lgpl",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit",
    "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license": "apache-2",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "all rights reserved": "all-rights-reserved",
}


def template_rows(phrases: dict[str, str], templates: dict[str, str], k: int) -> pd.DataFrame:
    """A row per k-gram of each phrase and template; the row of template -1 finds every document's end mark."""
    rows = [(-1, False, "", 0, _end_mark(), 0)]
    for i, (text, label) in enumerate([*phrases.items(), *templates.items()]):
        h, _ = V.words([text], V.ALNUM)
        if len(h) < k:
            raise ValueError(f"a template has {k} words at least: {text}")
        rows += [(i, i < len(phrases), label, len(h), int(x), t) for t, x in enumerate(V.kgrams(h, k).view(np.int64))]
    return pd.DataFrame(rows, columns=["tid", "phrase", "label", "words", "gram", "t"])


def _end_mark() -> int:
    return int(V.mix(np.array([0xE4D], np.uint64)).view(np.int64)[0])


def document_grams(df: DataFrame, key: str, column: str, k: int) -> DataFrame:
    """nr, id, no_id (see whole_id), n_words, grams: all k-gram hashes in order, then the end mark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for x, y in V.chunks(texts := b["text"].tolist()):
                h, starts = V.words(texts[x:y], V.ALNUM)
                g, at = V.kgrams_of(h, starts, k)
                with_end = np.insert(g.view(np.int64), at[1:], _end_mark())
                at = at + np.arange(len(at))
                yield b[["nr", "id", "no_id"]].iloc[x:y].assign(n_words=np.diff(starts), grams=[with_end[p:q] for p, q in zip(at[:-1], at[1:])])

    rows = df.select(F.monotonically_increasing_id().alias("nr"), *whole_id(key), F.col(column).alias("text"))
    return rows.mapInPandas(run, "nr bigint, id bigint, no_id boolean, n_words bigint, grams array<bigint>")


@F.pandas_udf(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("covered", T.IntegerType())]))
def _best_chain(places: pd.Series, terms: pd.Series, gaps: pd.Series, ks: pd.Series) -> pd.DataFrame:
    """Of the matches of one run: the ordered chain that covers the most words of the template.

    Document and template words both rise along a chain, and two steps of it lie at most `gap` diagonals apart.
    """
    out = []
    for ps, ts, gap, k in zip(places, terms, gaps, ks):
        if ps is None:
            out.append((0, 0, 0))
            continue
        matches = sorted(zip(ps.tolist(), ts.tolist()))
        reach = max(t for _, t in matches) + gap + 1
        best: list[tuple[int, int]] = []  # words covered by the best chain to each match, its first word
        low = 0
        for i, (p, t) in enumerate(matches):
            while matches[low][0] < p - reach:
                low += 1
            own = (k, p)
            for j in range(low, i):
                q, u = matches[j]
                if q < p and u < t and abs(p - t - q + u) <= gap and best[j][0] + min(t - u, k) > own[0]:
                    own = best[j][0] + min(t - u, k), best[j][1]
            best.append(own)
        i = max(range(len(best)), key=lambda i: (best[i][0], -i))
        out.append((best[i][1], matches[i][0] + k - 1, best[i][0]))
    return pd.DataFrame(out, columns=["first", "last", "covered"])


def spans(df: DataFrame, key: str, column: str, phrases: dict[str, str] = PHRASES, templates: dict[str, str] = TEMPLATES, k: int = K, gap: int = GAP, cover: float = COVER) -> DataFrame:
    """nr, key, n_words, label, phrase, first (word), last (word), score: verified spans; and a row with label null per document.

    Phrases: a span per complete diagonal, score 1.  Templates: a span per run of diagonals, each at most `gap` (of short templates a
    sixth of their words) from the next, whose best ordered chain of matches covers at least `cover` of the template's words; that
    share is the score.  Templates are sent to all executors while they have at most MOST_SENT k-grams, and joined by a shuffle beyond.
    """
    spark = df.sparkSession
    known = template_rows(phrases, templates, k)
    rows = spark.createDataFrame(known, "tid int, phrase boolean, label string, words int, gram bigint, t int")
    rows = F.broadcast(rows) if len(known) <= MOST_SENT else rows
    grams = document_grams(df, key, column, k).select("nr", "id", "no_id", "n_words", F.posexplode("grams").alias("p", "gram"))
    votes = grams.join(rows, "gram").repartition("nr")
    own = ["nr", "id", "no_id", "n_words", "tid", "phrase", "label", "words"]
    lines = votes.groupBy(*own, (F.col("p") - F.col("t")).alias("d")).agg(F.collect_list("t").alias("ts"))
    w = W.partitionBy("nr", "tid").orderBy("d")
    alone = F.col("phrase") | (F.col("tid") < 0)
    own_gap = F.least(F.lit(gap), F.floor(F.col("words") / 6)).cast("int")
    new = F.when(alone, 1).otherwise(F.coalesce((F.col("d") - F.lag("d").over(w) > own_gap).cast("int"), F.lit(0)))
    # one chain of steps for phrases, templates and end marks: three filtered branches would read the texts three times
    places = F.transform("ts", lambda t: t + F.col("d"))
    runs = lines.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy(*own, "run").agg(F.flatten(F.collect_list("ts")).alias("ts"), F.flatten(F.collect_list(places)).alias("ps"))
    mark, phrase = F.col("tid") < 0, F.col("phrase")
    # what can't be covered in any order needs no chain
    covered = F.size(F.array_distinct(F.flatten(F.transform("ts", lambda t: F.sequence(t, t + (k - 1))))))
    runs = runs.filter(mark | F.when(phrase, F.size("ts") == F.col("words") - (k - 1)).otherwise(covered >= F.col("words") * cover))
    notice = ~mark & ~phrase
    runs = runs.withColumn("chain", _best_chain(F.when(notice, F.col("ps")), F.when(notice, F.col("ts")), own_gap, F.lit(k)))
    score = F.when(mark, 0.0).when(phrase, 1.0).otherwise(F.col("chain.covered") / F.col("words"))
    first = F.when(phrase, F.array_min("ps")).otherwise(F.col("chain.first"))
    last = F.when(phrase, F.array_max("ps") + (k - 1)).otherwise(F.col("chain.last"))
    at = lambda c: F.when(~mark, c.cast("bigint"))
    found = runs.select("nr", id_again().alias("key"), "n_words", F.when(~mark, F.col("label")).alias("label"), "phrase", at(first).alias("first"), at(last).alias("last"), score.alias("score"))
    return found.filter(F.col("label").isNull() | (F.col("score") >= cover))


def scan(df: DataFrame, key: str, column: str, **how) -> DataFrame:
    """A row per document: see op7's columns; keys may be null or repeated."""
    base = F.col("phrase")
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), ",")
    return spans(df, key, column, **how).groupBy("nr", "key", "n_words").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.max("score").alias("score"),
    )
