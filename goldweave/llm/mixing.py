"""Mixing sources to target weights by Poisson replication.

A source with share w of the mix and mass m of the corpus' mass M is repeated w * M / m times on
average (times `scale`).  Each document draws its count from the Poisson distribution of that mean by
inverting it at a uniform number hashed from seed, id and text; the row is exploded by its count, and
copies are shuffled over the whole output by a hash.  Counts differ by less than one from their means on
average only as Poisson's do, need no totals beyond the sources', and don't depend on partitions.

Only DataFrame functions.  The table of sources is joined by broadcast while it has at most MOST_SENT
rows, by a shuffle with AQE's skew handling beyond.  A null source is a source of its own; null texts have
mass 0 and are drawn like others; a source without mass keeps its documents at mean `scale`.  Repeated rows (of equal
id and text) draw the same count each; they are told apart by their places in the input only to be shuffled, so that many of
them fill many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.plans.staging import staged

ALPHA, SEED, MOST_SENT = 0.7, 17, 100_000


def row_hash(*columns: Column | str, seed: int) -> Column:
    """md5 of the seed and the columns, nulls told from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string") if isinstance(c, str) else c), F.lit("-")) for c in columns]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts))


def unit(hashed: Column) -> Column:
    """A uniform number in [0, 1) of the first 52 bits of an md5."""
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def poisson_steps(mean: Column) -> Column:
    """(first, P(X <= first), P(X <= first + 1), ...) for X ~ Poisson(mean), up to mean + 12 * sqrt(mean) + 40.

    Past that nothing is left of a double.  Up to a mean of 500 the sum begins with P(X = 0); beyond, where that leaves the
    range of doubles, 12 standard deviations below the mean, with a term by Stirling's series (to more digits than a double has), and all
    before it is less than 1e-30.  Computed once per source; terms from where the sum no longer grows are cut.
    """
    large = mean > 500
    first = F.when(large, F.floor(mean - 12 * F.sqrt(mean))).otherwise(0).cast("double")
    most = F.ceil(mean + 12 * F.sqrt(mean) + 40)
    stirling = F.exp(first - mean + first * F.log(mean / first) - 0.5 * F.log(2 * F.pi() * first) - 1 / (12 * first) + 1 / (360 * first * first * first))
    p0 = F.when(large, stirling).otherwise(F.exp(-mean))
    start = F.struct(p0.alias("p"), F.array(p0).alias("c"))

    def step(s: Column, i: Column) -> Column:
        p = s["p"] * mean / i
        c = F.element_at(s["c"], -1)
        return F.struct(p.alias("p"), F.when(c + p > c, F.concat(s["c"], F.array(c + p))).otherwise(s["c"]).alias("c"))

    return F.concat(F.array(first), F.aggregate(F.sequence(first.cast("bigint") + 1, most.cast("bigint")), start, step)["c"])


def poisson_count(u: Column, steps: Column) -> Column:
    """The smallest k with P(X <= k) > u, after poisson_steps()."""
    above = F.size(F.filter(steps, lambda c, i: (i > 0) & (c <= u)))
    return (F.get(steps, F.lit(0)) + above).cast("int")


def source_rates(df: DataFrame, source: str, text: str, targets: dict[str, float] | None, alpha: float, scale: float) -> DataFrame:
    """source, n, mass, rate of each source; without targets, shares are proportional to mass ** alpha."""
    by = df.groupBy(F.col(source).alias("__source")).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("mass"))
    if targets is None:
        weight = F.pow(F.col("mass").cast("double"), F.lit(alpha))
    else:
        total = sum(targets.values())
        known = F.create_map(*[x for k, v in targets.items() for x in (F.lit(k), F.lit(v / total))]) if targets else F.create_map()
        weight = F.coalesce(F.try_element_at(known, F.col("__source")), F.lit(0.0))
    by = staged(by.withColumn("__weight", weight), "sources")
    all_mass, all_weight = by.agg(F.sum("mass"), F.sum("__weight")).first()
    rate = F.when((F.col("mass") > 0) & F.lit(bool(all_weight)), F.round(scale * F.col("__weight") / F.lit(all_weight or 1.0) * F.lit(all_mass or 0) / F.col("mass"), 9)).otherwise(F.lit(float(scale)))
    return by.select("__source", "n", "mass", rate.alias("__rate"))


def mix_sources(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", targets: dict[str, float] | None = None, alpha: float = ALPHA, scale: float = 1.0, seed: int = SEED, shuffle: bool = True) -> DataFrame:
    """df's rows, each as often as drawn, with __rate, __copy (from 0) and __order, the hash that they are shuffled by.

    Columns of df with these names are lost.
    """
    df = df.drop("__source", "__rate", "__steps", "__hash", "__n", "__copy", "__order", "__row").withColumn("__row", F.monotonically_increasing_id())
    rates = source_rates(df, source, text, targets, alpha, scale).select("__source", "__rate", poisson_steps(F.col("__rate")).alias("__steps"))
    rates = F.broadcast(rates) if rates.count() <= MOST_SENT else rates
    joined = df.join(rates, F.col(source).eqNullSafe(F.col("__source"))).drop("__source").withColumn("__hash", row_hash(key, text, seed=seed))
    count = poisson_count(unit(F.col("__hash")), F.col("__steps"))
    drawn = joined.withColumn("__n", count).filter("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    drawn = drawn.withColumn("__order", F.xxhash64("__hash", "__copy", "__row")).drop("__n", "__hash", "__steps", "__row")
    # dealt by the hash itself: as random as a range of it, without reading the input once more to find ranges
    return drawn.repartition("__order").sortWithinPartitions("__order", "__copy") if shuffle else drawn
