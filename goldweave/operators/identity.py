"""Identity: which records are the same entity.

The rule is greedy and depends on the order of ingestion.  A record takes the entity of the first of its
keys (addresses, then phones) that is registered, and all its keys then point there; else the first leader (the first
record of an entity) that shares a key; else the first leader with a match score of 0.65 or more; else it begins an
entity.  Records that no chain of shared keys and similar names joins can't influence each other, so the rule runs
exactly inside connected components.  Mode "closure" takes whole components as entities.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldweave.functions import fixed as X
from goldweave.functions.similarity import jaro_winkler_similarity, levenshtein_similarity
from goldweave.operators.graph import connected_components
from goldweave.operators.rows import runs, told_as
from goldweave.plans.staging import staged


def _keys() -> Column:
    some = lambda c, kind: F.transform(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: F.length(v) > 0), lambda v: F.concat(F.lit(f"{kind}:"), v))
    return F.concat(some("emails", "email"), some("phones", "phone"))


def match_keys(records: DataFrame) -> DataFrame:
    """seq, pos, key: `email:` and `phone:` keys of each record in order; empty values are no keys."""
    return records.select("seq", F.posexplode(_keys()).alias("pos", "key"))


def key_edges(keys: DataFrame) -> DataFrame:
    """a, b: each record linked to the first one with the same key; a common key gives a star, not all pairs."""
    first = keys.groupBy("key").agg(F.min("seq").alias("a"), F.count("*").alias("n")).filter("n > 1").select("key", "a")
    return keys.join(first, "key").filter("seq <> a").select("a", F.col("seq").alias("b")).distinct()


def _grams(name: Column) -> Column:
    """The pairs of neighbouring letters, each with how often it has come before, so that repeated ones count."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substring(name, i, F.lit(2)))
    pairs = F.when(F.length(name) > 1, pairs).otherwise(F.array().cast("array<string>"))
    return F.transform(pairs, lambda g, i: F.concat(g, F.lit("#"), F.size(F.filter(F.slice(pairs, F.lit(1), i), lambda h: h == g)).cast("string")))


def similar_names(names: DataFrame, least: float) -> DataFrame:
    """x, y, names: pairs x < y of distinct `name`s with an edit similarity of `least` or more; none is lost.

    Names within d edits of each other, the longer of n letters, share n - 1 - 2 * d pairs of letters at least.  Each name is entered under
    as many of its rarest pairs as it must have one in common with any partner; so common pairs bring nobody together.  Names of
    up to three letters, for which the bound says nothing, and those of four are entered under their letters.
    """
    n = F.length("name")
    # the fewest shared pairs over all lengths that the longer of two such names can have
    bound = lambda m: m - 1 - 2 * F.floor(m * (1 - least) + 1e-9)
    need = F.array_min(F.transform(F.sequence(n, F.greatest(n, F.floor(n / least + 1e-9).cast("int"))), bound))
    letters = F.transform(F.array_distinct(F.filter(F.split("name", ""), lambda c: F.length(c) > 0)), lambda c: F.concat(F.lit("letter "), c))
    own = names.select("name", need.alias("need"), _grams(F.col("name")).alias("grams"), F.when(need <= 0, letters).when(n <= 4, letters).otherwise(F.array().cast("array<string>")).alias("letters"))
    tokens = own.select("name", "need", F.explode("grams").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("often"))
    rare = W.partitionBy("name").orderBy("often", "token")
    kept = F.count("*").over(W.partitionBy("name")) - F.greatest("need", F.lit(1)) + 1
    entered = tokens.join(often, "token").withColumns({"nr": F.row_number().over(rare), "kept": kept}).filter("nr <= kept").select("token", "name")
    entered = entered.unionByName(own.select(F.explode("letters").alias("token"), "name"))
    sized = entered.withColumn("n", F.length("name"))
    x, y = sized.select("token", F.col("name").alias("x"), F.col("n").alias("nx")), sized.select("token", F.col("name").alias("y"), F.col("n").alias("ny"))
    near = x.join(y, "token").filter((F.col("x") < F.col("y")) & (F.least("nx", "ny") >= F.greatest("nx", "ny") * least - 1e-9)).select("x", "y").distinct()
    alike = levenshtein_similarity(F.col("x"), F.col("y"))
    return near.withColumn("names", alike).filter(F.col("names") >= least - 1e-9)


def fuzzy_pairs(records: DataFrame, least: float = X.PROBABLE) -> DataFrame:
    """a, b, score: pairs of distinct (name, company) whose score reaches `least`, by their first records; none is lost.

    The score is 0.6 * names + 0.4 * companies, or names alone where a company is missing.  So either the names have a similarity of
    `least` (all pairs whose companies have no more than that, too), which similar_names() finds without meeting all pairs; or
    the companies have more than `least`, and the names at least what is then missing: these meet by pairs of similar companies.
    """
    heads = records.filter(F.length("name") > 0).groupBy(F.lower("name").alias("name"), F.lower(F.coalesce("company", F.lit(""))).alias("company")).agg(F.min("seq").alias("seq"))
    left = heads.select(F.col("seq").alias("a"), F.col("name").alias("x"), F.col("company").alias("ca"))
    right = heads.select(F.col("seq").alias("b"), F.col("name").alias("y"), F.col("company").alias("cb"))
    names = heads.select("name").distinct()
    alike = similar_names(names, least)
    same = left.join(right.withColumnRenamed("y", "x"), "x").filter("a < b").select("a", "b", "ca", "cb", F.lit(1.0).alias("names"))
    by_name = alike.join(left, "x").join(right, "y").select("a", "b", "ca", "cb", "names").unionByName(same)
    firms = F.when((F.length("ca") > 0) & (F.length("cb") > 0), jaro_winkler_similarity(F.col("ca"), F.col("cb")))
    scored = by_name.withColumn("score", F.coalesce(F.col("names") * X.NAME_WEIGHT + firms * X.COMPANY_WEIGHT, F.col("names")))
    # the rest: similar companies, names below `least`
    known = heads.filter(F.length("company") > 0).select("company").distinct()
    letter = F.explode(F.array_distinct(F.filter(F.split("company", ""), lambda c: F.length(c) > 0))).alias("letter")
    one, two = known.select(F.col("company").alias("ca"), letter), known.select(F.col("company").alias("cb"), letter)
    both = one.join(two, "letter").filter("ca < cb").select("ca", "cb").distinct().withColumn("firms", jaro_winkler_similarity(F.col("ca"), F.col("cb"))).filter(F.col("firms") > least)
    both = both.unionByName(both.select(F.col("cb").alias("ca"), F.col("ca").alias("cb"), "firms")).unionByName(known.select(F.col("company").alias("ca"), F.col("company").alias("cb"), F.lit(1.0).alias("firms")))
    longer, lacking = F.greatest(F.length("x"), F.length("y")), (least - F.col("firms") * X.COMPANY_WEIGHT) / X.NAME_WEIGHT
    met = both.join(left, "ca").join(right, "cb").filter(F.col("a") < F.col("b")).filter(F.least(F.length("x"), F.length("y")) >= longer * lacking - 1e-9)
    met = met.withColumn("names", levenshtein_similarity(F.col("x"), F.col("y"))).filter((F.col("names") < least - 1e-9) & (F.col("names") >= lacking - 1e-9))
    rest = met.withColumn("score", F.col("names") * X.NAME_WEIGHT + F.col("firms") * X.COMPANY_WEIGHT)
    pick = [F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score"]
    return scored.select(*pick).unionByName(rest.select(*pick)).filter(F.col("score") >= least)


def name_edges(records: DataFrame) -> DataFrame:
    """Links of each record to the first one of the same name and company."""
    own = [F.lower("name").alias("n"), F.lower(F.coalesce("company", F.lit(""))).alias("c")]
    named = records.filter(F.length("name") > 0).select("seq", *own)
    first = named.groupBy("n", "c").agg(F.min("seq").alias("a"))
    return named.join(first, ["n", "c"]).filter("seq <> a").select("a", F.col("seq").alias("b"))


def components(records: DataFrame, fuzzy: bool = True, pairs: DataFrame | None = None, keyed: DataFrame | None = None) -> DataFrame:
    """seq, component: records that chains of shared keys and similar names join, by their smallest seq; pairs: see fuzzy_pairs(), keyed: key_edges()."""
    edges = key_edges(match_keys(records)) if keyed is None else keyed
    if fuzzy:
        edges = edges.unionByName(name_edges(records)).unionByName((fuzzy_pairs(records) if pairs is None else pairs).select("a", "b"))
    found = connected_components(edges)
    return records.select("seq").join(found, F.col("seq") == F.col("node"), "left").select("seq", F.coalesce("component", "seq").alias("component"))


LINKS = "seq bigint, entity bigint, match_type string, match_status string, match_score double, matched_seq bigint, matched_name string"
_LINKS = [c.split()[0] for c in LINKS.split(", ")]


def greedy(rows: list[dict], registry: dict[str, int] | None = None) -> list[dict]:
    """The rule on the rows of one component: pairs first, then records by seq, with head (first of the same name and company), named, name, keys.

    pairs: a, b, score of heads.  registry: keys known from before.  A leader is found by its keys and by its head, so a record costs its
    keys and its head's pairs, not the number of leaders.
    """
    known = dict(registry or {})
    near: dict[int, dict[int, float]] = {}
    for r in rows:
        if r["score"] is not None:
            near.setdefault(r["a"], {})[r["b"]] = near.setdefault(r["b"], {})[r["a"]] = r["score"]
    leaders: list[tuple[int, list, str]] = []
    led: set[int] = set()
    by_key: dict[str, int] = {}  # the first leader with a key, with a head
    by_head: dict[int, int] = {}
    out = []
    for r in rows:
        if r["score"] is not None:
            continue
        seq, head, named, name, keys = (r[c] for c in ("seq", "head", "named", "name", "keys"))
        entity, how, status, score, matched = next((known[k] for k in keys if k in known), None), "key", None, None, None
        if entity is None and (shared := [by_key[k] for k in keys if k in by_key]):
            entity, own, _ = leaders[min(shared)]
            known |= dict.fromkeys(own, entity)
        if entity is None and named:
            first = min(((by_head[h], s) for h, s in [(head, 1.0), *near.get(head, {}).items()] if h in by_head), default=None)
            if first:
                entity, how, score = leaders[first[0]][0], "fuzzy", first[1]
                status = "CONFIRMED" if first[1] > X.CONFIRMED else "PROBABLE_MANUAL_REVIEW"
                matched = first[0]
        if entity is None:
            entity, how = seq, "new"
        if entity not in led:
            leaders.append((entity, keys, name))
            led.add(entity)
            for k in keys:
                by_key.setdefault(k, len(leaders) - 1)
            if named:
                by_head.setdefault(head, len(leaders) - 1)
        known |= dict.fromkeys(keys, entity)
        out.append((seq, entity, how, status, score, None if matched is None else leaders[matched][0], None if matched is None else leaders[matched][2]))
    return [dict(zip(_LINKS, r)) for r in out]


def resolve(records: DataFrame, mode: str = "exact", fuzzy: bool = True) -> DataFrame:
    """records(seq, name, company, emails, phones) -> seq, entity, match_type, match_status, match_score, matched_seq, matched_name.

    exact: the greedy rule inside each component (a component is the unit of work: a very large one is one task's);
    closure: a component is an entity, in DataFrame steps only.  matched_seq and matched_name tell the leader of a fuzzy match.
    """
    pairs = staged(fuzzy_pairs(records), "pairs") if fuzzy else None
    keyed = staged(key_edges(match_keys(records)), "keys")
    nothing = [F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in LINKS.split(", ")[3:])]
    found = components(records, fuzzy, pairs, keyed)
    # the smallest seq of a component names it
    first = F.col("seq") == F.col("component")
    if mode == "closure":
        return staged(found, "components").select("seq", F.col("component").alias("entity"), F.when(first, "new").otherwise("closure").alias("match_type"), *nothing)
    # a record that shares a key with an earlier one takes its entity before names count; so where that holds for all but the
    # first of a component, all are one entity, and no rule has to be run
    grouped = staged(found.join(keyed.select(F.col("b").alias("seq"), F.lit(True).alias("shares")).distinct(), "seq", "left"), "components")
    open_ones = grouped.filter(~first & F.col("shares").isNull()).select("component").distinct()
    by_keys = grouped.join(open_ones, "component", "left_anti").select("seq", F.col("component").alias("entity"), F.when(first, "new").otherwise("key").alias("match_type"), *nothing)
    if open_ones.isEmpty():
        return by_keys
    many = grouped.join(open_ones, "component", "left_semi").select("seq", "component")
    own = [F.lower("name").alias("n"), F.lower(F.coalesce("company", F.lit(""))).alias("c")]
    full = records.select("seq", "name", *own, _keys().alias("keys")).join(many, "seq")
    if fuzzy:
        full = full.join(records.filter(F.length("name") > 0).groupBy(*own).agg(F.min("seq").alias("head")), ["n", "c"], "left")
    else:
        full = full.withColumn("head", F.lit(None).cast("bigint"))
    full = full.select("component", "seq", F.coalesce("head", "seq").alias("head"), F.col("head").isNotNull().alias("named"), "name", "keys")
    full = full.select("*", *(F.lit(None).cast(t).alias(c) for c, t in (("a", "bigint"), ("b", "bigint"), ("score", "double"))))
    if fuzzy:
        full = full.unionByName(pairs.join(many.withColumnRenamed("seq", "a"), "a").select("component", "a", "b", "score"), allowMissingColumns=True)
    shape = told_as(LINKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shape.batches(r for rows in runs(batches, "component") for r in greedy(rows))

    # an explicit number: by bytes, of which there are few, tasks would be merged
    tasks = int(grouped.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    together = full.repartition(tasks, "component").sortWithinPartitions("component", "seq").mapInArrow(run, LINKS).withColumn("match_score", F.round("match_score", 2))
    return by_keys.unionByName(together)
