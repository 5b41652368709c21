"""Diagnostics of sources and quality of golden records, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.functions import fixed as X
from goldweave.functions.normalize import said, truthy

SECTIONS = ["full_name", "emails", "phones", "skills", "experience", "education", "links", "headline"]


def has_any(df: DataFrame, column: str) -> Column:
    """A list with elements, a struct with a field that isn't null, empty or an empty list, else a value that isn't null or empty."""

    def test(c: Column, kind) -> Column:
        name = kind.typeName()
        if name == "array":
            return F.coalesce(F.size(c) > 0, F.lit(False))
        if name == "struct":
            out = F.lit(False)
            for f in kind.fields:
                out = out | test(c.getField(f.name), f.dataType)
            return out
        return F.coalesce(c != "", F.lit(False)) if name == "string" else c.isNotNull()

    return test(F.col(column), df.schema[column].dataType)


def diagnostics(df: DataFrame, confidence: Column) -> DataFrame:
    """Per source: counts of what was found, which sections are there, the parser's confidence."""
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    there = {s: has_any(df, s) for s in SECTIONS}
    pick = lambda want: F.array_compact(F.array(*[F.when(t if want else ~t, F.lit("name" if s == "full_name" else s)) for s, t in there.items()]))
    links = sum((F.when(F.coalesce(F.length(f"links.{k}") > 0, F.lit(False)), 1).otherwise(0) for k in ("linkedin", "github", "portfolio")), F.when(count("links.other") > 0, 1).otherwise(0))
    return df.select(
        "source", "content_type",
        *(count(c).alias(n) for c, n in (("emails", "emails_found"), ("phones", "phones_found"), ("skills", "skills_found"), ("experience", "experience_count"), ("education", "education_count"))),
        links.alias("links_found"), there["full_name"].alias("has_name"), there["headline"].alias("has_headline"), pick(True).alias("sections_found"), pick(False).alias("sections_missing"), confidence.alias("parser_confidence"), "error",
    )


def field_count(scalars: list[Column], lists: list[Column]) -> Column:
    """Non-null scalars and all elements of lists."""
    out = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in scalars), F.lit(0))
    return sum((F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) for c in lists), out)


def quality(present: dict[str, Column], duplicates: Column, conflicting: Column, n_warnings: Column, match_quality: Column, overall_confidence: Column) -> dict[str, Column]:
    """The five scores, missing fields and suggestions; `present` has a test for each of the twelve expected fields."""
    there = {k: F.coalesce(present[k], F.lit(False)) for k in X.EXPECTED}
    found = sum((F.when(t, 1).otherwise(0) for t in there.values()), F.lit(0))
    completeness = found / len(X.EXPECTED)
    consistency = F.greatest(F.lit(0.0), 1 - (duplicates * 0.1 + conflicting * 0.05))
    validity = F.greatest(F.lit(0.0), 1 - n_warnings * 0.15)
    merged = F.coalesce(match_quality, overall_confidence)
    missing = F.array_compact(F.array(*[F.when(~t, F.lit(k)) for k, t in there.items()]))
    lines = [F.when(F.size(missing) > 0, said(X.ADVICE["missing"], F.array_join(F.slice(missing, 1, 5), ", ")))]
    lines += [F.when(~there[k], X.ADVICE[k]) for k in ("LinkedIn", "Headline / Summary", "Work Experience", "Skills")]
    lines += [said(X.ADVICE["advisory"], F.lit(a)) for a in X.ADVISORIES]
    return {
        "completeness_score": F.round(completeness, 3),
        "consistency_score": F.round(consistency, 3),
        "validity_score": F.round(validity, 3),
        "merge_quality_score": F.round(merged, 3),
        "overall_score": F.round(completeness * 0.35 + consistency * 0.20 + validity * 0.20 + merged * 0.25, 3),
        "missing_fields": missing,
        "suggestions": F.array_compact(F.array(*lines)),
    }


def percent(score: Column) -> Column:
    """Whole per cents, cut off."""
    return (score * 100).cast("int")


def decision_rule(reason: Column) -> Column:
    low = F.lower(F.coalesce(reason, F.lit("")))
    has = lambda s: F.contains(low, F.lit(s))
    return F.when((low == "") | has("single source") | has("initial profile"), "single_source").when(has("priority"), "source_priority").when(has("confidence"), "confidence").when(has("recency"), "recency").otherwise("auto")


def explanation(reason: Column) -> Column:
    """One or two sentences about a decision."""
    rule = decision_rule(reason)
    out = F.when(F.coalesce(reason, F.lit("")) == "", F.array(*map(F.lit, X.EXPLANATIONS["none"])))
    for name, texts in X.EXPLANATIONS.items():
        out = out.when(rule == name, F.array(*[said(t, *[reason] * t.count("{}")) for t in texts]))
    return out.otherwise(F.array(reason))


def heat(confidence: Column) -> Column:
    return F.when(confidence >= 0.85, "High").when(confidence >= 0.65, "Medium").when(confidence.isNotNull(), "Low").otherwise("Missing")


def field_breakdown(present: dict[str, Column], confidence: dict[str, Column] | None = None) -> Column:
    """field, present and confidence (0 where it is missing, else 1 unless given) of each expected field."""
    confidence = confidence or {}
    there = {k: F.coalesce(present[k], F.lit(False)) for k in X.EXPECTED}
    one = lambda k, t: F.struct(F.lit(k).alias("field"), t.alias("present"), F.when(t, F.coalesce(confidence.get(k, F.lit(1.0)), F.lit(0.0))).otherwise(0.0).alias("confidence"))
    return F.array(*[one(k, t) for k, t in there.items()])


def repeated_values(values: Column, kind: str) -> Column:
    """`kind:value` of each value that a list holds more than once, in order of their first places."""
    some = F.coalesce(values, F.array().cast("array<string>"))
    twice = F.filter(F.array_distinct(some), lambda v: F.size(F.filter(some, lambda x: x == v)) > 1)
    return F.transform(twice, lambda v: F.concat(F.lit(f"{kind}:"), v))


def conflicting_fields(provenance: Column) -> Column:
    """Fields that more than one source gave, in order."""
    fields = F.array_distinct(F.transform(provenance, lambda p: p["field"]))
    sources = lambda f: F.size(F.array_distinct(F.transform(F.filter(provenance, lambda p: p["field"] == f), lambda p: p["source"])))
    return F.coalesce(F.filter(fields, lambda f: sources(f) > 1), F.array().cast("array<string>"))


def decision_explanations(provenance: DataFrame, field: str = "field", value: str = "value") -> DataFrame:
    """A row per surviving value of an explained field: its label, winner, preview, rule and sentences.

    provenance: entity, field, value, source, confidence, decision_reason, and item (the company of a job, else null).
    """
    label = F.coalesce(
        *[F.when(F.col(field) == k, v) for k, v in X.FIELD_LABELS.items()],
        F.when(F.col(field) == "skills", F.concat(F.lit("Skill: "), F.col(value))),
        F.when(F.col(field) == "experience", F.concat(F.lit("Experience: "), F.coalesce("item", F.lit("?")))),
    )
    reason = F.col("decision_reason")
    shown = F.when(F.length(F.col(value)) > 120, F.concat(F.left(F.col(value), F.lit(120)), F.lit("..."))).otherwise(F.coalesce(F.col(value), F.lit("(empty)")))
    out = provenance.withColumn("label", label).filter(F.col("label").isNotNull())
    return out.select("entity", F.col("label").alias("field"), F.col("source").alias("winner_source"), F.col("confidence").alias("winner_confidence"), shown.alias("winner_value_preview"), decision_rule(reason).alias("decision_rule"), explanation(reason).alias("reasons"))


def report_sections(golden: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """candidate_id, `carry`, section, nr, label, value, note: the data of a report on each golden record, a row per line."""
    line = lambda label, value, note=None: F.struct(F.lit(label).cast("string").alias("label") if not isinstance(label, Column) else label.alias("label"), value.cast("string").alias("value"), (note if note is not None else F.lit(None)).cast("string").alias("note"))
    listed = lambda c: F.coalesce(truthy(F.array_join(c, ", ")), F.lit("None"))
    share = lambda c: F.concat(percent(c).cast("string"), F.lit("%"))
    some = lambda c, make, empty: F.when(F.size(c) > 0, F.transform(c, make)).otherwise(F.array(line(None, F.lit(X.REPORT_EMPTY[empty])))) if empty else F.transform(F.coalesce(c, F.array()), make)
    place = F.coalesce(truthy(F.array_join(F.filter("location", lambda x: F.length(x) > 0), ", ")), F.lit("N/A"))
    title = lambda e: F.concat(e["title"], F.lit(" at "), e["company"], F.lit(" ("), F.coalesce(e["start"], F.lit("N/A")), F.lit(" — "), F.coalesce(e["end"], F.lit("Present")), F.lit(")"))
    degree = lambda e: F.concat(e["institution"], F.lit(" — "), F.coalesce(truthy(e["degree"]), F.lit("Degree")), F.coalesce(F.concat(F.lit(" in "), truthy(e["field"])), F.lit("")), F.lit(" (Class of "), F.coalesce(e["end_year"].cast("string"), F.lit("N/A")), F.lit(")"))
    sections = {
        "overview": F.array(line("Name", F.col("full_name")), line("Years Experience", F.coalesce(F.concat(F.col("years_experience").cast("string"), F.lit(" Years")), F.lit("N/A"))), line("Ingestion Confidence", share(F.col("overall_confidence"))), line("Data Quality Score", share(F.col("data_quality_score"))), line("Location", place)),
        "contact": F.array(line("Emails", listed(F.col("emails"))), line("Phones", listed(F.col("phones"))), *(line(k, F.coalesce(truthy(F.col(f"links.{k.lower()}")), F.lit("None"))) for k in ("LinkedIn", "GitHub", "Portfolio"))),
        "summary": F.array(line(None, F.coalesce(truthy(F.col("headline")), F.lit(X.REPORT_EMPTY["summary"])))),
        "skills": F.transform("skills", lambda s: line(s["name"], share(s["confidence"]), F.array_join(s["sources"], ", "))),
        "experience": some(F.col("experience"), lambda e: line(title(e), e["summary"]), "experience"),
        "education": some(F.col("education"), lambda e: line(None, degree(e)), "education"),
        "provenance": F.transform("provenance", lambda p: line(p["field"], F.concat_ws(", ", p["source"], F.coalesce(p["method"], F.lit("N/A"))), F.coalesce(p["decision_reason"], F.lit(X.REPORT_EMPTY["reason"])))),
        "warnings": some(F.col("validation_warnings"), lambda w: line(None, w), "warnings"),
        "metadata": F.array(line("Candidate ID", F.col("candidate_id"))),
    }

    def told(k: str, lines: Column) -> Column:
        return F.transform(F.coalesce(lines, F.array(line(None, F.lit(None)))), lambda s, i: F.struct(F.lit(X.REPORT[k]).alias("section"), i.alias("nr"), s["label"].alias("label"), s["value"].alias("value"), s["note"].alias("note")))

    rows = [told(k, c) for k, c in sections.items()]
    return golden.select("candidate_id", *(carry or []), F.inline(F.filter(F.concat(*rows), lambda r: r["label"].isNotNull() | r["value"].isNotNull())))
