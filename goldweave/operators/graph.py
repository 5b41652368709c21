"""Connected components: edges contracted within tasks, then alternating large-star and small-star steps.

Edges that are stars already, as those of shared keys often are, are told by one aggregate and need no more.  Else each task reads
a bounded number of edges and replaces them by stars around their smallest nodes.  What one task holds whole is
done by that.  Else the stars are dealt by ranges and contracted again, so that a chain of neighbouring ids
shrinks to a few edges before anything is joined, and star steps do the rest.  Every step is a shuffle of the edges only;
nothing is collected.  A vertex with very many neighbours is the centre of a star, so that its group is two columns of a scan,
never one row.  Each step's edges are written to the shared folder, which cuts the plan; their number and sum come with the
writing.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from goldweave.plans.staging import drop_folder, staged

#: Edges that a task contracts at once: some tens of MB.
MOST = 1 << 20


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node it reaches) of every node but those smallest ones."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while len(apart := np.flatnonzero(label[x] != label[y])):
        p, q = label[x[apart]], label[y[apart]]
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    some = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[some], nodes[label[some]]


def _contract(batches: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """Stars of the task's edges; of more than `most`, stars of stars, which can only be fewer edges than nodes."""
    a, b = np.empty(0, np.int64), np.empty(0, np.int64)
    held, n = [], 0
    for d in itertools.chain(batches, [None]):
        if d is not None:
            held.append(d)
            n += len(d)
        if n >= most or d is None and n:
            a, b = forest(*(np.concatenate([own, *(h[c].to_numpy(np.int64) for h in held)]) for own, c in ((a, "a"), (b, "b"))))
            held, n = [], 0
            if len(a) > 2 * most:  # too many nodes for one task: what it has found goes on as edges
                yield pd.DataFrame({"a": a, "b": b})
                a, b = a[:0], b[:0]
    if len(a):
        yield pd.DataFrame({"a": a, "b": b})


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Links each neighbour above a vertex to the smallest vertex near it."""
    near = _both(edges)
    low = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return near.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a vertex and its smaller neighbours to the smallest of them; edges are (larger a, smaller b)."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(low, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def _written(edges: DataFrame, kept: list[str]) -> tuple[DataFrame, tuple]:
    """The edges, staged, with their number and the sum of their hashes."""
    seen = Observation()
    marked = edges.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum"))
    return staged(marked, "cc", kept), tuple(seen.get.values())


def _labelled(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Every edge (larger a, smaller b) leads to the one smaller neighbour of a, which has no smaller one itself."""
    ends = edges.select(F.col("a").alias("node"), F.col("b").alias("low")).unionByName(edges.select(F.col("b").alias("node"), F.lit(None).cast("bigint").alias("low")))
    nodes = ends.groupBy("node").agg(F.min("low").alias("least"), F.max("low").alias("most"), F.count("*").alias("n"), F.count("low").alias("up"))
    return nodes.filter("least <> most or (up > 0 and up < n)").isEmpty()


def connected_components(edges: DataFrame, keep: list[str] | None = None, most: int = MOST) -> DataFrame:
    """edges(a, b) -> (node, component): every node of an edge with the smallest node it can reach.

    Rows with a null and loops are left out; repeated and reversed edges don't matter.  No edges, no rows.  keep gets the folder
    that holds the result, which otherwise stays until the driver ends.  most: edges that a task contracts.
    """
    spark = edges.sparkSession
    kept: list[str] = []
    clean, found = _written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), kept)
    if _are_stars(clean):
        if keep is not None:
            keep += kept
        return _labelled(clean.distinct())
    tasks = max(1, -(-found[0] // most))
    contract = lambda d: d.mapInPandas(functools.partial(_contract, most=most), "a bigint, b bigint")
    now, marks = _written(contract(clean.coalesce(tasks)), kept)
    drop_folder(spark, kept.pop(0))
    if tasks > 1:
        now, marks = _written(contract(now.repartitionByRange("b", "a")), kept)
        drop_folder(spark, kept.pop(0))
    while tasks > 1:
        now, found = _written(_small_star(_large_star(now)), kept)
        drop_folder(spark, kept.pop(0))
        # a star forest is stable: its edges, summed by a hash, no longer change
        if found == marks:
            break
        marks = found
    if keep is not None:
        keep += kept
    return _labelled(now)
