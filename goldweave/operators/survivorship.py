"""Survivorship: which claim of a field wins, why, and what it won against.

A claim is a row with an entity, a field, a value and source, priority, confidence, ts and seq (its
record's place in the order of ingestion).  The claim with the highest (priority, confidence, ts)
wins; a full tie keeps the earlier.  That order is total, so folding records one by one is one aggregate with
partial sums on the map side.  Reasons and conflicts depend on the running winner before each claim, a window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldweave.functions import fixed as X
from goldweave.functions.normalize import said

BEST = ["priority", "confidence", "ts"]


def with_priority(df: DataFrame, source: str = "source", priorities: dict[str, int] | None = None, templates: bool = False) -> DataFrame:
    """Adds `priority`: of the source's name; with templates, else of the first known name with its extension; else 10."""
    table = X.PRIORITIES if priorities is None else priorities
    if not table:
        return df.withColumn("priority", F.lit(X.DEFAULT_PRIORITY))
    pick = lambda t, k: F.try_element_at(F.create_map(*[F.lit(x) for kv in t.items() for x in kv]), k)
    found = [pick(table, F.col(source))]
    if templates:
        by_ending: dict[str, int] = {}
        for name, p in table.items():
            if "." in name:
                by_ending.setdefault(name[name.rindex(".") :].lower(), p)
        if by_ending:
            found.append(pick(by_ending, F.lower(F.regexp_extract(F.col(source), r"(\.[^.]+)$", 1))))
    return df.withColumn("priority", F.coalesce(*found, F.lit(X.DEFAULT_PRIORITY)))


def rank(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + c) for c in BEST], (-F.col(prefix + "seq")).alias("seq"))


def winners(claims: DataFrame, entity: str, field: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """The winning claim of each (entity, field): value and `carry`.  A claim may hold a null value and still win."""
    by = [entity] if field is None else [entity, field]
    kept = ["value", *(carry or [])]
    top = claims.groupBy(*by).agg(F.max_by(F.struct(*kept), rank()).alias("w"))
    return top.select(*by, *(F.col(f"w.{c}").alias(c) for c in kept))


def _before(by: list[str]) -> W:
    return W.partitionBy(*by).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)


def steps(claims: DataFrame, by: list[str], carry: list[str]) -> DataFrame:
    """Each claim beside `w`, the winner of the claims before it (null for the first)."""
    kept = list(dict.fromkeys(["value", "seq", *BEST, *carry]))
    return claims.withColumn("w", F.max_by(F.struct(*kept), rank()).over(_before(by)))


def later_wins() -> Column:
    """The claim beats the running winner."""
    mine, theirs = F.struct(*BEST), F.struct(*[F.col(f"w.{c}") for c in BEST])
    return mine > theirs


def rule() -> Column:
    """What decides between the running winner and the claim."""
    return F.when(F.col("priority") != F.col("w.priority"), "source_priority").when(F.col("confidence") != F.col("w.confidence"), "confidence").otherwise("recency")


def reason(source: str = "source") -> Column:
    """The decision in words; priorities and confidences of the winner first."""
    sides = lambda cols: ([F.col(c) for c in cols], [F.col(f"w.{c}") for c in cols])
    win = later_wins()

    def ordered(template: str, cols: list[str]) -> Column:
        mine, theirs = sides(cols)
        return F.when(win, said(template, *mine, *theirs)).otherwise(said(template, *theirs, *mine))

    return (
        F.when(rule() == "source_priority", ordered(X.REASONS["source_priority"], [source, "priority"]))
        .when(rule() == "confidence", ordered(X.REASONS["confidence"], ["confidence"]))
        .otherwise(F.when(win, X.REASONS["newer"]).otherwise(X.REASONS["older"]))
    )


def decision_reasons(claims: DataFrame, entity: str, field: str | None = None, source: str = "source") -> DataFrame:
    """Why each (entity, field) has its value: the reason of the last record's step.

    Null for entities of one record; "Single source populated" where the last record or all before it have no claim.  Two aggregates
    with partial sums, the last claim and the winner of those before it, so a long history is nobody's window.
    """
    by = [entity] if field is None else [entity, field]
    records = claims.groupBy(entity).agg(F.max("seq").alias("last_seq"), F.min("seq").alias("first_seq"))
    ends = claims.groupBy(*by).agg(F.max("seq").alias("__end"))
    kept = list(dict.fromkeys(["value", "seq", *BEST, source]))
    row, is_last = F.struct(*kept), F.col("seq") == F.col("__end")
    last = claims.join(ends, by).groupBy(*by).agg(F.max_by(F.when(is_last, row), F.when(is_last, rank())).alias("__last"), F.max_by(F.when(~is_last, row), F.when(~is_last, rank())).alias("w"))
    last = last.select(*by, *(F.col(f"__last.{c}").alias(c) for c in kept), "w").join(records, entity)
    text = F.when(F.col("last_seq") == F.col("first_seq"), F.lit(None).cast("string")).when((F.col("seq") < F.col("last_seq")) | F.col("w").isNull(), X.REASONS["single"]).otherwise(reason(source))
    return last.select(*by, text.alias("decision_reason"))


def same_value(a: Column, b: Column) -> Column:
    """Equal but for blanks, hyphens, slashes and case."""
    plain = lambda c: F.regexp_replace(F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))), r"[\s\-/]+", "")
    return plain(a) == plain(b)


def preview(c: Column, most: int = 120) -> Column:
    text = F.coalesce(c.cast("string"), F.lit("(empty)"))
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def conflicts(claims: DataFrame, by: list[str], source: str = "source") -> DataFrame:
    """A row per step at which both sides had different values: both sides, who won, and the rule."""
    told = steps(claims, by, [source]).filter(F.col("w").isNotNull() & ~same_value(F.col("w.value"), F.col("value")))
    win = later_wins()
    side = lambda p, x: [F.col(p + source).alias(f"source_{x}"), preview(F.col(p + "value")).alias(f"value_{x}"), F.col(p + "confidence").alias(f"confidence_{x}"), F.col(p + "priority").alias(f"priority_{x}")]
    return told.select(
        *by,
        "seq",
        *side("w.", "a"),
        *side("", "b"),
        F.when(win, F.col(source)).otherwise(F.col(f"w.{source}")).alias("winner_source"),
        preview(F.when(win, F.col("value")).otherwise(F.col("w.value"))).alias("winning_value"),
        preview(F.when(win, F.col("w.value")).otherwise(F.col("value"))).alias("rejected_value"),
        rule().alias("decision_rule"),
    )


def rejected_links(claims: DataFrame, by: list[str]) -> DataFrame:
    """Values that lost a step against another one: they stay known as other links even if they win later."""
    told = steps(claims, by, []).filter(F.col("w.value").isNotNull() & F.col("value").isNotNull() & (F.col("w.value") != F.col("value")))
    return told.select(*by, F.when(later_wins(), F.col("w.value")).otherwise(F.col("value")).alias("value")).distinct()


def list_union(claims: DataFrame, entity: str, field: str | None = None, carry: list[str] | None = None) -> DataFrame:
    """Distinct non-null values of each (entity, field) with the metadata of their best claim, `first_seq` to order by, and the reason.

    The reason: in earlier records only "Initial profile value", in the last only "Single source populated", in both the
    best one's rule; null for entities of one record.  Claims are shuffled once, as one row per value; an entity's first and last
    record come from those rows, of which null values leave one as well.
    """
    by = [entity] if field is None else [entity, field]
    kept = list(dict.fromkeys([*(carry or []), *BEST, "seq"]))
    items = claims.groupBy(*by, "value").agg(F.max_by(F.struct(*kept), rank()).alias("w"), F.min("seq").alias("first_seq"), F.max("seq").alias("end_seq"))
    whole = W.partitionBy(entity)
    items = items.withColumns({"last_seq": F.max("end_seq").over(whole), "only_seq": F.min("first_seq").over(whole)}).filter(F.col("value").isNotNull())
    text = (
        F.when(F.col("last_seq") == F.col("only_seq"), F.lit(None).cast("string"))
        .when(F.col("end_seq") < F.col("last_seq"), X.REASONS["initial"])
        .when(F.col("first_seq") == F.col("last_seq"), X.REASONS["single"])
        .otherwise(X.REASONS["list"])
    )
    return items.select(*by, "value", *(F.col(f"w.{c}").alias(c) for c in kept), "first_seq", text.alias("list_reason"))


def golden_top(claims: DataFrame, entity: str) -> DataFrame:
    """The one entity with the highest source priority; ties go to the one seen first."""
    tops = claims.groupBy(entity).agg(F.max("priority").alias("max_priority"), F.min("seq").alias("first_seq"))
    return tops.orderBy(F.desc("max_priority"), "first_seq").limit(1)
