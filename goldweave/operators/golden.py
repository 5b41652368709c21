"""Scores and checks of golden records, as Column expressions over their flattened columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.functions import fixed as X
from goldweave.functions.normalize import said

#: Fields whose claims count for the overall confidence: not profile links, dates, summaries or degrees.
CONFIDENT = ["full_name", "headline", "years_experience", "emails", "phones", "other_links", "skills", "city", "region", "country", "experience.company", "experience.title", "education.institution"]


def overall_confidence(claims: DataFrame, entity: str) -> DataFrame:
    """The plain mean of the surviving claims' confidences over CONFIDENT fields, 1.0 where none counts."""
    counted = F.when(F.col("field").isin(CONFIDENT), F.col("confidence"))
    return claims.groupBy(entity).agg(F.round(F.coalesce(F.avg(counted), F.lit(1.0)), 2).alias("overall_confidence"))


def job_ends_before_start(start: Column, end: Column) -> Column:
    """Both are months and the end is earlier; what isn't a month is no fault."""
    month = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM"))
    return F.coalesce(month(start) > month(end), F.lit(False))


def warnings(jobs: Column, years: Column, studies: Column, emails: Column, phones: Column, match_type: Column | None = None, match_score: Column | None = None) -> Column:
    """Texts of all checks that fail, in order; the one of probable matches only where those columns are given."""
    empty = F.array().cast("array<string>")
    dates = F.transform(F.filter(jobs, lambda j: job_ends_before_start(j["start"], j["end"])), lambda j: said(X.WARNINGS["dates"], j["company"], j["end"], j["start"]))
    late = F.transform(F.filter(studies, lambda s: s["end_year"] > 2035), lambda s: said(X.WARNINGS["future"], s["institution"], s["end_year"]))
    one = lambda test, words: F.when(F.coalesce(test, F.lit(False)), F.array(words)).otherwise(empty)
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    parts = [F.coalesce(dates, empty), one(years < 0, F.lit(X.WARNINGS["years"])), F.coalesce(late, empty), one(none(emails) & none(phones), F.lit(X.WARNINGS["contact"]))]
    if match_type is not None:
        unsure = (match_type == "fuzzy") & (F.coalesce(match_score, F.lit(0.0)) < X.CONFIRMED)
        parts.append(one(unsure, said(X.WARNINGS["fuzzy"], match_score)))
    return F.concat(*parts)


def data_quality(name: Column, has_email: Column, has_phone: Column, has_link: Column, has_place: Column, has_job: Column, has_study: Column, n_warnings: Column) -> Column:
    """Weighted presence, less a tenth per warning, not below 0."""
    named = F.coalesce(name != X.UNKNOWN_NAME, F.lit(False)) & (F.length(name) > 0)
    weights = [(named, 0.15), (has_email, 0.25), (has_phone, 0.15), (has_link, 0.10), (has_place, 0.10), (has_job, 0.15), (has_study, 0.10)]
    total = sum((F.when(test, weight).otherwise(0.0) for test, weight in weights), F.lit(0.0))
    return F.round(F.greatest(F.lit(0.0), total - n_warnings * 0.1), 2)


def skill_rollup(claims: DataFrame, entity: str, skill: str = "value") -> DataFrame:
    """Each entity's skills with the highest confidence and their sources."""
    return claims.filter(F.col(skill).isNotNull()).groupBy(entity, F.trim(F.col(skill)).alias("skill")).agg(F.max("confidence").alias("confidence"), F.sort_array(F.collect_set("source")).alias("sources"))


def distinct_provenance(log: DataFrame, order: str = "seq") -> DataFrame:
    """The first row of each (entity, field, source, method, reason)."""
    by = ["entity", "field", "source", "method", "decision_reason"]
    others = [c for c in log.columns if c not in by]
    return log.groupBy(*by).agg(F.min_by(F.struct(*others), order).alias("w")).select(*by, *(F.col(f"w.{c}").alias(c) for c in others))


def range_violations(df: DataFrame, scores: list[str], required: list[str]) -> DataFrame:
    """A row per broken rule: scores lie between 0 and 1, required strings aren't empty."""
    rules = [F.when(~F.col(c).between(0, 1), F.lit(f"{c} must be between 0 and 1")) for c in scores]
    rules += [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{c} is required")) for c in required]
    return df.withColumn("violation", F.explode(F.array_compact(F.array(*rules))))
