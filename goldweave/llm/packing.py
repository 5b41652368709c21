"""Best-fit packing with certified bin counts.

Pieces of documents go to as few sequences of `capacity` tokens as possible.  The lengths are
packed per partition by best-fit decreasing.  Dual feasible functions give a lower bound of each
partition's bins; a partition that meets its bound is certified: no packing of its pieces has fewer.  A certified
partition keeps its bins but for those with room for others' pieces, the emptiest one and all with more room than a LEAST_ROOM-th of
a bin; one that is not certified gives up all its bins with a gap.  What is given up is dealt to new, fewer partitions and packed
again, until the bins meet the bound of the whole table or one partition holds all that is left; a round that needs
no fewer bins than its pieces had is not kept.

Only (row, piece, length) is shuffled, never ids or texts.  A partition gets at most about `per_partition`
pieces, dealt by a hash, so no group or source gathers in one task.  A round's bins are written in the
shared folder before the next begins; each takes somewhat larger partitions, up to MOST_ROUNDS times the first's.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from goldweave.plans.staging import staged

PER_PARTITION, MOST_ROUNDS, LEAST_ROOM = 20_000, 6, 128


def dual_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """A lower bound of the bins for `counts` items of each length: the best of three families of dual feasible functions.

    Area; rounding to multiples of capacity / k, with items on a multiple kept (u_k); and items over
    capacity - e as whole bins with those under e dropped (U_e).  All in integers.
    """
    use = counts > 0
    x, n = lengths[use].astype(np.int64), counts[use].astype(np.int64)
    if not len(x):
        return 0
    best = -(-int((x * n).sum()) // capacity)
    for k in range(1, 101):  # u_k(x), scaled by k * capacity
        whole = (k + 1) * x % capacity == 0
        f = np.where(whole, x * k, (k + 1) * x // capacity * capacity)
        best = max(best, -(-int((f * n).sum()) // (k * capacity)))
    for e in np.unique(np.minimum(x, capacity - x)):
        if 0 < e <= capacity // 2:
            f = np.where(x > capacity - e, capacity, np.where(x >= e, x, 0))
            best = max(best, -(-int((f * n).sum()) // capacity))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, place in it, filled tokens of each bin); open bins wait by the room they have left."""
    order = np.argsort(-lengths, kind="stable")
    bins, places = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # sorted rooms with a waiting bin
    filled: list[int] = []
    for i, n in zip(order.tolist(), lengths[order].tolist()):
        j = bisect.bisect_left(rooms, n)
        if j == len(rooms):
            b, room = len(filled), capacity
            filled.append(0)
        else:
            room = rooms[j]
            b = waiting[room].pop()
            if not waiting[room]:
                rooms.pop(j)
        bins[i], places[i] = b, filled[b]
        filled[b] += n
        if room > n:
            if not waiting[room - n]:
                bisect.insort(rooms, room - n)
            waiting[room - n].append(b)
    return bins, places, np.array(filled, np.int64)


PACKED = "part bigint, nr bigint, piece int, length bigint, bin bigint, place bigint, certified boolean, again boolean"


def _round(pieces: DataFrame, parts: int, seed: int, capacity: int) -> DataFrame:
    """Every partition packed; again: the piece's bin is offered to the exchange."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "nr", "piece"], ascending=[False, True, True], kind="stable")
        n = pdf["length"].to_numpy(np.int64)
        bins, places, filled = best_fit_decreasing(n, capacity)
        certified = len(filled) == dual_bound(*np.unique(n, return_counts=True), capacity)
        gap = filled < capacity
        if certified:
            gap &= (filled < capacity - capacity // LEAST_ROOM) | (np.arange(len(filled)) == filled.argmin())
        own = int(pdf["part"].iloc[0])
        return pdf[["part", "nr", "piece", "length"]].assign(bin=(seed << 48) + (own << 24) + bins, place=places, certified=certified, again=gap[bins])

    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("nr", "piece", F.lit(seed)), F.lit(parts)))
    return dealt.groupBy("part").applyInPandas(pack, PACKED)


def pack_pieces(pieces: DataFrame, capacity: int = 4096, per_partition: int = PER_PARTITION, log: list[dict] | None = None) -> DataFrame:
    """pieces(nr, piece, length) -> the same with bin and place; a bin's places run from 0 without gaps.

    (nr, piece) names a piece; other columns are not read.  Lengths are 1 to capacity.  Bins are numbered
    with gaps.  An empty table gives an empty result.  log gets a dictionary per round: its partitions, how many
    of them are certified, the bins of the whole table after it, those offered to the exchange, and the whole table's bound.
    """
    pieces = pieces.select("nr", "piece", "length")
    spread = pieces.groupBy("length").count().collect()  # at most `capacity` rows
    if not spread:
        return pieces.select("*", F.lit(0).cast("bigint").alias("bin"), F.lit(0).cast("bigint").alias("place"))
    left = sum(r["count"] for r in spread)
    goal = dual_bound(np.array([r["length"] for r in spread]), np.array([r["count"] for r in spread]), capacity)
    done: list[DataFrame] = []
    best: DataFrame | None = None  # where the pieces that are offered stand so far
    settled = offered = 0
    for r in range(MOST_ROUNDS):
        parts = max(1, -(-left // (per_partition * (r + 1))))
        now = staged(_round(pieces, parts, r, capacity), f"packing{r}")
        bins, open_bins, sure, open_pieces = now.agg(
            F.count(F.when(F.col("place") == 0, 1)), F.count(F.when((F.col("place") == 0) & F.col("again"), 1)), F.count_distinct(F.when(F.col("certified"), F.col("part"))), F.count(F.when(F.col("again"), 1))
        ).first()
        gained = best is None or bins < offered
        last = settled + min(bins, offered if best is not None else bins) <= goal or parts == 1 or r == MOST_ROUNDS - 1
        if log is not None:
            log.append({"partitions": parts, "certified": sure, "bins": settled + (bins if gained else offered), "offered": open_bins, "bound": goal})
        if not gained:  # larger partitions may do better, but what there is stands
            if last:
                done.append(best)
                break
            continue
        if last:
            done.append(now)
            break
        done.append(now.filter(~F.col("again")))
        best = now.filter("again")
        settled, offered, left = settled + bins - open_bins, open_bins, open_pieces
        pieces = best.select("nr", "piece", "length")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("nr", "piece", "length", "bin", "place")
