"""Exact top-k by inner product: a Voronoi kNN join.

Data and queries are grouped by their nearest pivot.  A cell's summary is its pivot, row count and radius; a
query group's is its pivot, radius and longest query.  For q in a group with pivot s, x in a cell with pivot c:

    |q.x - s.c| <= radius(group) * |c| + longest(group) * radius(cell)

so the cells that surely hold k rows with a score of at least t give each group a threshold t, and only cells
whose upper bound reaches it are replicated to that group.  Within a task the same bounds, per query, skip blocks.
Cells are cut in blocks and the queries of a pivot in groups, both of bounded size by a hash of the row, so neither a vector with
very many copies nor a crowd of queries around one pivot fills one task; blocks and groups are as large as a task's
memory allows, since each row is sent once per group or block that it must meet.
Scores are exact integers: bounds are widened by more than the rounding of doubles.

Vectors are arrays of doubles that are whole numbers; missing trailing components count as 0.  A query's own row is every row of
its id; repeated candidates count one by one; of repeated query ids, the smallest vector counts.  Scores beyond 64 bits
are held at the largest or smallest long and rank as such.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldweave.plans.staging import staged

PIVOTS = 64
#: Bytes of a block of rows or group of queries; rows at least.
BYTES, LEAST_ROWS = 1 << 25, 2048
_SAFE, _LONG = 2.0**52, 2.0**63 * (1 - 1e-9)


def integer_vectors(df: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """key, v array<double>: floor(scale * x) of each component as a double, which holds it exactly if scale is a power of two.

    Rows with a null id, a null vector, or a null or non-finite component take no part.
    """

    def whole(c):
        x = c.cast("double") * scale
        return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(x)  # beyond, every double is whole

    finite = F.forall(F.col(vector), lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < float("inf")))
    return df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & finite).select(F.col(key).cast("bigint").alias("key"), F.transform(F.col(vector), whole).alias("v"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def exact_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole doubles, as int64."""
    with np.errstate(over="ignore"):
        reach = np.linalg.norm(q, axis=1).max(initial=0) * np.linalg.norm(x, axis=1).max(initial=0)
    if reach < _SAFE:
        return (q @ x.T).astype(np.int64)
    if reach < 2.0**62 and max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < 2.0**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    whole = lambda m: np.array([[int(c) for c in r] for r in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(q) @ whole(x).T, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by falling score, then rising id."""
    if len(scores) > 4 * k:
        kth = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= kth)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((ids[some], ~scores[some]))][:k]  # ~ reverses the order of integers and can't overflow


def top_k(data: DataFrame, queries: DataFrame, k: int, pivots: int = PIVOTS, block: int | None = None, per_group: int | None = None) -> DataFrame:
    """data(key, v), queries(key, v) -> query_id, rank, vec_id, score.  block, per_group: rows, by default as many as fit in BYTES."""
    spark = data.sparkSession
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    queries = queries.groupBy("key").agg(F.min("v").alias("v"))
    width, n_data = data.agg(F.max(F.size("v")), F.count("*")).first()
    q_width, n_queries = queries.agg(F.max(F.size("v")), F.count("*")).first()
    width = max(width or 0, q_width or 0)
    if not n_data or not n_queries:
        return spark.createDataFrame([], schema)
    # as large as memory allows, but enough blocks for all cores
    fits = max(LEAST_ROWS, BYTES // (8 * max(1, width)))
    block = block or max(LEAST_ROWS, min(fits, n_data // (4 * spark.sparkContext.defaultParallelism)))
    per_group = per_group or fits
    # pivots: distinct vectors with the smallest hashes, a bounded number
    drawn = data.select("v", F.xxhash64("v").alias("h")).dropDuplicates(["h"]).orderBy("h").limit(pivots).toPandas()
    centre = _matrix(drawn["v"], width)
    square = (centre**2).sum(axis=1)

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                x = _matrix(b["v"], width)
                away = np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ centre.T + square, 0))
                cell = away.argmin(axis=1)
                # from the difference itself: the formula above loses digits of long vectors
                exact = np.linalg.norm(x - centre[cell], axis=1)
                yield pd.DataFrame({"key": b["key"], "cell": cell, "away": exact * (1 + 1e-9) + 1e-9, "long": np.linalg.norm(x, axis=1), "raw": [r.tobytes() for r in x]})

    made = "key bigint, cell int, away double, long double, raw binary"
    rows = staged(data.mapInPandas(cells, made), "cells")
    asks = staged(queries.mapInPandas(cells, made), "asks")
    summary = rows.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).toPandas()  # at most `pivots` rows
    own = np.zeros(len(centre), np.int64)
    radius = np.zeros(len(centre))
    own[summary["cell"]], radius[summary["cell"]] = summary["n"], summary["radius"]
    norm = np.sqrt(square)
    # rows of a query's own id don't count for its threshold
    copies = rows.join(asks.select("key"), "key", "left_semi").groupBy("key").count().agg(F.max("count")).first()[0] or 0
    enough = k + copies
    counts = asks.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("away"), F.max("long").alias("long")).toPandas()

    def bounds(middle: np.ndarray, slack: np.ndarray) -> tuple[np.ndarray, float]:
        """(upper bound of each cell, a score that surely `enough` rows reach)"""
        slack = slack * (1 + 1e-9) + np.abs(middle) * 1e-9 + 1e-6
        low, high = np.nan_to_num(middle - slack, nan=-np.inf, neginf=-np.inf), np.nan_to_num(middle + slack, nan=np.inf, posinf=np.inf)
        order = np.argsort(-low)
        sure = np.flatnonzero(np.cumsum(own[order]) >= enough)
        return high, min(low[order[sure[0]]], _LONG) if len(sure) else -np.inf

    # neighbouring query cells share a group up to per_group queries; a larger cell is parted by a hash
    order = np.argsort(centre[counts["cell"]] @ np.ones(width), kind="stable")
    group_of, parts, room = {}, [], 0
    for c, n in zip(counts["cell"].to_numpy()[order].tolist(), counts["n"].to_numpy()[order].tolist()):
        if n > room:
            parts.append(-(-n // per_group))
            room = max(0, per_group - n)
        else:
            room -= n
        group_of[c] = len(parts) - 1
    # pairs of a group and a data cell that must meet, at most pivots * pivots
    need: set[tuple[int, int]] = set()
    for c, away, long in counts[["cell", "away", "long"]].itertuples(index=False):
        high, bound = bounds(centre[c] @ centre.T, away * norm + long * radius)
        need |= {(group_of[c], int(d)) for d in np.flatnonzero((high >= bound) & (own > 0))}
    pairs = F.broadcast(spark.createDataFrame([(g, d, parts[g], int(max(1, -(-own[d] // block)))) for g, d in sorted(need)], "team int, cell int, groups int, blocks int"))
    teams = F.broadcast(spark.createDataFrame(sorted(group_of.items()), "cell int, team int"))
    some = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("key", "raw", "__nr"), F.col(n)).cast("int")
    numbered = lambda df: df.withColumn("__nr", F.monotonically_increasing_id())  # noqa: E731  parts equal rows
    sent = numbered(rows).join(pairs, "cell").withColumn("block", part("blocks")).withColumn("grp", some("groups"))
    asked = numbered(asks).join(teams, "cell").drop("cell").join(pairs, "team").withColumn("grp", part("groups")).withColumn("block", some("blocks"))

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(q) and len(x):
            ids = x["key"].to_numpy(np.int64)
            values = np.frombuffer(b"".join(x["raw"])).reshape(len(x), width)
            names = q["key"].to_numpy(np.int64)
            wanted = np.frombuffer(b"".join(q["raw"])).reshape(len(q), width)
            cell, lengths = int(x["cell"].iloc[0]), np.linalg.norm(wanted, axis=1)
            may = np.zeros(len(q), bool)
            for i, (middle, long) in enumerate(zip(wanted @ centre.T, lengths)):
                high, bound = bounds(middle, long * radius)
                may[i] = high[cell] >= bound
            names, wanted = names[may], wanted[may]
            some = max(1, (1 << 22) // len(values))  # so that scores take some 32 MB
            for a in range(0, len(names), some):
                scores = exact_scores(wanted[a : a + some], values)
                for name, s in zip(names[a : a + some], scores):
                    other = np.flatnonzero(ids != name)
                    best = other[_best(s[other], ids[other], k)]
                    out.append(pd.DataFrame({"query_id": name, "vec_id": ids[best], "score": s[best]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype=np.int64)

    keys = ["team", "grp", "cell", "block"]
    local = asked.select(*keys, "key", "raw").groupBy(*keys).cogroup(sent.select(*keys, "key", "raw").groupBy(*keys)).applyInPandas(solve, "query_id bigint, vec_id bigint, score bigint")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
