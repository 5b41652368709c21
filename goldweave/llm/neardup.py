"""Near-duplicate groups: SetSketch banding, joint likelihood, verification on full sets, components.

1. Each document's set of word shingles gives its size, a 128-bit signature and a SetSketch.  Rows with
   one signature have equal sets and go on as one representative, the smallest key.
2. Bands of register values put representatives in buckets.  In each bucket two members, drawn by a hash of
   member and band, are centres: pairs member - centre grow with the bucket, not with its square.
3. Pairs are screened by the registers' joint likelihood; each member's likeliest ones are verified on the full
   sets, and the verified links give components.
4. Buckets with members of different components are compared in full, by registers, in blocks of bounded size.  The members of a
   bucket's largest component are met by the others only, not by each other.  First
   each member's likeliest partner in another component is verified, which joins groups around a common
   original without their many pairs; then, of what is still apart, every pair that the likelihood can't rule out.
   The last step has the texts in its blocks, verifies there, each pair in the first band that it shares, and gives
   links only: copies with many changes are near to thousands of others without being linked to them.
   So a link between components is lost only if no band has both of its ends, which 40 bands of 4 registers
   let happen to fewer than one pair in a million at similarity 0.75, or if the likelihood rules it out, which happens to less
   than one such pair in ten million; `exact` verifies all that meet in a band.
5. Components of all verified links, spread to all rows by signature.

A bucket's centres and sizes are aggregates with partial sums, joined back to its members, so that adaptive execution can
split a hot bucket, group of copies or component.  Nothing is collected on the driver.  Null and empty texts have empty sets
and no links; rows with a null key are not linked and are kept; repeated rows are members of one group; rows of one key with
different texts share the key's links.  Extra columns are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldweave.llm import setsketch as S
from goldweave.llm import textvec as V
from goldweave.llm.base import id_again, whole_id
from goldweave.operators.graph import connected_components
from goldweave.plans.staging import drop_folder, staged

SHINGLE, PERCENT, FIRST = 5, 75, 3
#: A block of a bucket has about so many members, or characters of text, at most.
BLOCK, BLOCK_CHARS = 2000, 16_000_000


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and n + 1 starts."""
    h, starts = V.words(texts, V.NONSPACE)
    g, at = V.kgrams_of(h, starts, k)
    n = np.diff(starts)
    of = np.repeat(np.arange(len(n)), np.diff(at))
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        whole = np.array([V.kgrams(h[starts[i] : starts[i + 1]], n[i])[0] for i in short], np.uint64)
        g, of = np.concatenate([g, whole]), np.concatenate([of, short])
    order = np.lexsort((g, of))
    g, of = g[order], of[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
    g, of = g[new], of[new]
    return g, np.searchsorted(of, np.arange(len(n) + 1))


def _sketches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        texts = b["text"].tolist()
        for x, y in V.chunks(texts):
            g, at = shingle_sets(texts[x:y])
            n = np.diff(at)
            full = np.flatnonzero(n)
            s1, s2 = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            if len(full):
                s1[full] = np.add.reduceat(V.mix(g), at[:-1][full])
                s2[full] = np.add.reduceat(V.mix(g ^ np.uint64(0xA5A5A5A5A5A5A5A5)), at[:-1][full])
            regs = S.registers(g, at)
            chars = [len(t) if t else 0 for t in texts[x:y]]
            yield b[["id", "no_id", "text_hash"]].iloc[x:y].assign(chars=chars, n=n, s1=s1.view(np.int64), s2=s2.view(np.int64), regs=[r.tobytes() for r in regs])


def _band_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in V.relieved(batches):
        if len(b):
            keys = S.bands(_regs(b["regs"]))
            yield pd.DataFrame({"band": keys.ravel(), "node": np.repeat(b["node"].to_numpy(np.int64), keys.shape[1])})


def _regs(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint16).reshape(len(column), -1)


def _likely(ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray, slack: float) -> np.ndarray:
    """Estimated similarities; -1 for pairs that sizes or, but for an endless slack, registers rule out."""
    out = np.full(len(na), -1.0)
    sizes = np.flatnonzero(100 * np.minimum(na, nb) >= PERCENT * np.maximum(na, nb))
    for x in range(0, len(sizes), 4096):
        i = sizes[x : x + 4096]
        up, down = (ra[i] > rb[i]).sum(axis=1), (ra[i] < rb[i]).sum(axis=1)
        guess, may = S.likely(up, down, ra.shape[1] - up - down, na[i].astype(float), nb[i].astype(float), PERCENT / 100, slack)
        out[i] = np.where(may, guess, -1.0)
    return out


def _screened(batches: Iterator[pd.DataFrame], slack: float) -> Iterator[pd.DataFrame]:
    for b in V.relieved(batches):
        if len(b):
            guess = _likely(_regs(b["ra"]), _regs(b["rb"]), b["na"].to_numpy(), b["nb"].to_numpy(), slack)
            yield b.loc[guess >= 0, ["a", "b"]].assign(guess=guess[guess >= 0])


def _linked(p: np.ndarray, q: np.ndarray) -> bool:
    """Two sorted sets are similar enough."""
    both = np.concatenate([p, q])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= PERCENT * (len(both) - common)


def _verified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held: dict[str, np.ndarray] = {}

    def sets(t: str) -> np.ndarray:
        if t not in held:
            if len(held) >= 256:
                held.clear()
            held[t] = shingle_sets([t])[0]
        return held[t]

    for b in V.relieved(batches):
        ok = np.array([_linked(sets(x), sets(y)) for x, y in zip(b["ta"], b["tb"])], bool)
        yield b.loc[ok, ["a", "b"]]


def _block_pairs(batches: Iterator[pd.DataFrame], best: bool, slack: float) -> Iterator[pd.DataFrame]:
    """Pairs across components in each group (band, bi, bj): each member's likeliest (best), or all links by the texts.

    A group's rows come one after another; it is of bounded size and may span batches.
    """
    rest: pd.DataFrame | None = None
    group = ["band", "bi", "bj"]
    for b in V.relieved(batches):
        if not len(b):
            continue
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        last = (b[group] == b[group].iloc[-1]).all(axis=1).to_numpy()
        cut = len(b) - int(last[::-1].cumprod().sum())
        if cut:
            yield _pairs(b.iloc[:cut].reset_index(drop=True), best, slack)
        rest = b.iloc[cut:]
    if rest is not None:
        yield _pairs(rest.reset_index(drop=True), best, slack)


def _pairs(d: pd.DataFrame, best: bool, slack: float) -> pd.DataFrame:
    node, comp, n, own, band = (d[c].to_numpy() for c in ("node", "comp", "n", "own", "band"))
    cross = (d["bi"] != d["bj"]).to_numpy()
    regs, ids = _regs(d["regs"]), d[["band", "bi", "bj"]].to_numpy()
    bands = None if best else S.bands(regs)
    texts = None if best else d["text"].tolist()
    sets: dict[int, np.ndarray] = {}

    def full(i: int) -> np.ndarray:
        if i not in sets:
            sets[i] = shingle_sets([texts[i]])[0]
        return sets[i]

    first = np.flatnonzero(np.append(True, (ids[1:] != ids[:-1]).any(axis=1)))
    out = []
    for s, e in zip(first, np.append(first[1:], len(d))):
        sets.clear()
        place = None if best else int(np.flatnonzero(bands[s] == band[s])[0])
        for i in range(s, e):
            j = np.arange(s if best else i + 1, e)
            j = j[(comp[j] != comp[i]) & (100 * np.minimum(n[i], n[j]) >= PERCENT * np.maximum(n[i], n[j]))]
            if cross[s]:
                j = j[own[j] != own[i]]
            if not best and len(j):  # pairs that share an earlier band are looked at there
                j = j[~(bands[j, :place] == bands[i, :place]).any(axis=1)]
            if not len(j):
                continue
            guess = _likely(np.broadcast_to(regs[i], (len(j), regs.shape[1])), regs[j], np.full(len(j), n[i]), n[j], slack)
            if best:
                j = j[[guess.argmax()]] if guess.max() >= 0 else j[:0]
            else:
                j = np.array([k for k in j[guess >= 0].tolist() if _linked(full(i), full(k))], np.int64)
            out.append(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])]))
    got = np.concatenate(out, axis=1) if out else np.empty((2, 0), np.int64)
    return pd.DataFrame({"a": got[0], "b": got[1]}).drop_duplicates()


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", exact: bool = False, block: int = BLOCK, first: int = FIRST) -> DataFrame:
    """key, text_hash (xxhash64 of the text), n_shingles, component_id, kept: a row for every row of df.

    exact: no pair that meets in a band is ruled out by likelihood.  block: members of a block of a hot bucket.  first: the likeliest
    pairs of each member that are verified before buckets are compared in full; it changes the work, not the result.
    """
    slack = float("inf") if exact else S.SLACK
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # of steps that cost CPU, not bytes
    tmp: list[str] = []
    docs = df.select(*whole_id(key), F.col(text).alias("text"))
    made = docs.withColumn("text_hash", F.xxhash64("text")).mapInPandas(_sketches, "id bigint, no_id boolean, text_hash bigint, chars bigint, n bigint, s1 bigint, s2 bigint, regs binary")
    sk = staged(made.withColumn("key", id_again()).drop("id", "no_id"), "sketches")
    sig = ["n", "s1", "s2"]
    # equal sets have equal registers
    reps = staged(sk.filter("n > 0 and key is not null").groupBy(*sig).agg(F.min("key").alias("node"), F.max("chars").alias("chars"), F.first("regs").alias("regs")), "representatives")
    rows = reps.select("node", "regs").mapInPandas(_band_rows, "band bigint, node bigint")
    drawn = F.col("node").bitwiseXOR(F.col("band"))  # another order of the members in each band, undone by the same step
    centres = rows.groupBy("band").agg(F.min(drawn).alias("lo"), F.max(drawn).alias("hi")).filter("lo <> hi")
    back = lambda c: F.col(c).bitwiseXOR(F.col("band")).alias(c)
    members = staged(rows.join(centres, "band").select("band", "node", back("lo"), back("hi")), "buckets", tmp)
    nodes = members.select("node").distinct()
    own = docs.filter("not no_id").select(F.col("id").alias("node"), "text")
    texts = staged(own.join(nodes, "node", "left_semi").dropDuplicates(["node", "text"]), "texts", tmp)
    sized = reps.select("node", "n", "regs", "chars")

    def verify(pairs: DataFrame) -> DataFrame:
        x = texts.select(F.col("node").alias("a"), F.col("text").alias("ta"))
        y = texts.select(F.col("node").alias("b"), F.col("text").alias("tb"))
        return pairs.join(x, "a").join(y, "b").select("a", "b", "ta", "tb").mapInPandas(_verified, "a bigint, b bigint")

    # a: the member, b: the centre
    stars = members.select(F.col("node").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).filter("a <> b").distinct()
    x = sized.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra"))
    y = sized.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb"))
    both = stars.join(x, "a").join(y, "b").select("a", "b", "na", "nb", "ra", "rb").repartition(tasks, "a", "b")
    screened = both.mapInPandas(functools.partial(_screened, slack=slack), "a bigint, b bigint, guess double")
    top = F.row_number().over(W.partitionBy("a").orderBy(F.desc("guess"), "b"))
    tried = screened.withColumn("nr", top).filter(F.col("nr") <= first).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    tried = staged(tried, "stars", tmp)
    linked = staged(verify(tried), "links", tmp)
    whole = connected_components(linked, tmp)
    buckets = members.select("band", "node")
    for best in (True, False):
        left = buckets.join(whole, "node", "left").select("band", "node", F.coalesce("component", "node").alias("comp")).join(sized.select("node", "chars"), "node")
        by = left.groupBy("band", "comp").agg(F.count("*").alias("k"), F.sum("chars").alias("chars"))
        # big: the bucket's largest component; the rest is compared with everything, it with the rest only
        by = by.groupBy("band").agg(F.count("*").alias("comps"), F.max(F.struct("k", "comp", "chars")).alias("big"), F.sum("k").alias("k"), F.sum("chars").alias("chars")).filter("comps > 1")
        parts = lambda k, c: F.greatest(F.ceil(k / block), F.ceil(c / BLOCK_CHARS), F.lit(1)).cast("int")
        by = by.select("band", F.col("big.comp").alias("big"), parts(F.col("k") - F.col("big.k"), F.col("chars") - F.col("big.chars")).alias("nr"), parts(F.col("big.k"), F.col("big.chars")).alias("nl"))
        left = left.select("band", "node", "comp").join(by, "band")
        large, drawn = F.col("comp") == F.col("big"), F.xxhash64("node")
        mine = F.when(large, F.col("nr") + F.pmod(drawn, F.col("nl"))).otherwise(F.pmod(drawn, F.col("nr"))).cast("int")
        theirs = F.sequence(F.lit(0), F.when(large, F.col("nr")).otherwise(F.col("nr") + F.col("nl")) - 1)
        left = left.withColumn("own", mine).withColumn("other", F.explode(theirs))
        left = left.withColumns({"bi": F.least("own", "other"), "bj": F.greatest("own", "other")})
        group, keep = ["band", "bi", "bj"], ["node", "comp", "own", "n", "regs"]
        dealt = left.join(sized, "node").select(*group, *keep)
        dealt = dealt if best else dealt.join(texts, "node").select(*group, *keep, "text")
        found = dealt.repartition(tasks, *group).sortWithinPartitions(*group, "node").mapInPandas(functools.partial(_block_pairs, best=best, slack=slack), "a bigint, b bigint").distinct()
        if best:
            found = verify(staged(found.join(tried, ["a", "b"], "left_anti"), "pairs", tmp))
        links = whole.select(F.col("node").alias("a"), F.col("component").alias("b")).filter("a <> b").unionByName(found)
        whole = connected_components(links, tmp)
    for path in tmp[:-1]:  # the last one holds the components
        drop_folder(df.sparkSession, path)

    named = reps.join(whole, "node", "left").select(*sig, F.coalesce("component", "node").alias("component"))
    out = sk.select("key", "text_hash", *sig).join(named, sig, "left")
    component = F.when(F.col("key").isNotNull() & F.col("component").isNotNull(), F.col("component")).otherwise(F.col("key"))
    return out.select("key", "text_hash", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """df without all but one row of each group: of the rows with the group's smallest key, the one of the smallest text hash.

    Rows without words or without a key stay.  how: see groups().
    """
    found = staged(groups(df, key, text, **how), "groups")
    linked = found.filter("n_shingles > 0 and key is not null")
    # keys of several texts are few: of each, the rows but for the smallest text hash
    several = linked.filter("kept").groupBy("key").agg(F.min("text_hash").alias("best"), F.max("text_hash").alias("worst"), F.count("*").alias("rows"))
    other = linked.filter("kept").join(several.filter("best <> worst").select("key", "best"), "key").filter("text_hash <> best")
    lost = linked.filter(~F.col("kept")).select("key", "text_hash").unionByName(other.select("key", "text_hash")).distinct().toDF("__k", "__h")
    out = df.join(lost, (F.col(key) == F.col("__k")) & (F.xxhash64(text) == F.col("__h")), "left_anti")
    return out if several.filter("rows > 1").isEmpty() else _once(out, key, text)


def _once(df: DataFrame, key: str, text: str) -> DataFrame:
    """One of the rows of each key and text; rows with a null in either all stay."""
    whole = F.col(key).isNotNull() & F.col(text).isNotNull() & (F.length(F.trim(F.col(text))) > 0)
    return df.filter(whole).dropDuplicates([key, text]).unionByName(df.filter(~whole))
