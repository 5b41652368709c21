"""Facts of structured payloads: rows of exports and JSON profiles, as VARIANT paths.

Keys are compared in lower case.  A profile may be below `profile` or the root itself; of a list, the first element.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.functions import fixed as X
from goldweave.functions import text as T
from goldweave.functions.normalize import bound, truthy
from goldweave.plans.schemas import EXTRACTED, LINKS

#: Names that a fact goes by, in the order they are tried.
KEYS = {
    "name": ["name", "candidate_name", "full_name"],
    "emails": ["emails", "email_addresses", "email"],
    "phones": ["phones", "phone_numbers", "phone"],
    "links": ["links", "social_links"],
    "headline": ["headline", "bio", "summary", "professional_summary"],
    "years": ["years_experience", "experience_years"],
    "experience": ["experience", "employment", "work_history"],
    "education": ["education", "academic", "education_history", "academic_history"],
    "city": ["city", "town"],
    "region": ["region", "state", "province"],
    "country": ["country", "country_code"],
    "company": ["company", "employer"],
    "title": ["title", "job_title"],
    "start": ["start", "start_date"],
    "end": ["end", "end_date"],
    "summary": ["summary", "description", "responsibilities"],
    "institution": ["institution", "school"],
    "degree": ["degree", "degree_name"],
    "field": ["field", "major", "field_of_study"],
    "end_year": ["end_year", "year_completed", "grad_year", "year"],
}


def _get(v: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{key}", kind)


def _any(v: Column, names: list[str], kind: str = "string") -> Column:
    """The first of several keys with a value that isn't null or empty."""
    return F.coalesce(*[truthy(_get(v, k, kind)) if kind == "string" else _get(v, k, kind) for k in names])


def _strings(v: Column, names: list[str]) -> Column:
    """A scalar as a list of one, a list as its strings."""

    def told(x: Column) -> Column:
        listed, one = F.filter(F.try_variant_get(x, "$", "array<string>"), lambda s: F.length(s) > 0), F.try_variant_get(x, "$", "string")
        single = ~F.schema_of_variant(x).rlike("^(ARRAY|OBJECT)")
        return F.when(x.isNotNull(), F.coalesce(F.nullif(listed, F.array().cast("array<string>")), F.when(single & (F.length(one) > 0), F.array(one))))

    return F.coalesce(*[bound(_get(v, k, "variant"), told) for k in names], F.array().cast("array<string>"))


#: Without backslashes every quote begins or ends a string: then this is a key with something to fold.  What follows the end of a string begins
#: with a comma, colon or bracket, so no match begins there; texts with a key that begins so as well are told by _ODD_KEY.
_TO_FOLD = r'"(?!\s*+[,:\]}])[\x00-\x21\x23-\x40\x5B-\x7F]*+[^"]++"\s*+:'
_ODD_KEY = r'[{,]\s*+"\s*+[,:\]}]'
#: Each key to fold costs a pass over the text.
_MOST_KEYS = 16


def lower_keys(json: Column) -> Column:
    """JSON text with the keys in lower case: a name before a colon, at any depth, so that keys of jobs and studies fold as well.

    Of plain texts only the keys with something to fold are replaced.  Others are taken apart: into the keys, and what stands between
    them (at most 64 strings at once, as the pattern's depth grows with them).
    """
    parts = F.regexp_extract_all(json, F.lit(r'("[^"\\]*+(?:\\.[^"\\]*+)*+"\s*+:|(?:[^"]++|"[^"\\]*+(?:\\.[^"\\]*+)*+"(?!\s*+:)){1,64}+)'), 1)
    folded = F.array_join(F.transform(parts, lambda p: F.when(F.startswith(p, F.lit('"')) & F.endswith(p, F.lit(":")), F.lower(p)).otherwise(p)), "")
    plain = ~F.contains(json, F.lit("\\")) & ~json.rlike(_ODD_KEY)
    keys = F.when(plain, F.array_distinct(F.regexp_extract_all(json, F.lit(_TO_FOLD), F.lit(0))))
    return bound(keys, lambda k: F.when(k.isNotNull() & (F.size(k) <= _MOST_KEYS), F.aggregate(k, json, lambda s, x: F.replace(s, x, F.lower(x)))).otherwise(folded))


def profile(json: Column) -> Column:
    """The object that holds the facts; each step stands once, so a text is folded and parsed once."""
    part = lambda v, path: F.try_variant_get(v, path, "variant")
    return bound(F.try_parse_json(lower_keys(json)), lambda v: F.coalesce(part(v, "$[0].profile"), part(v, "$[0]"), part(v, "$.profile"), v))


def _location(v: Column) -> Column:
    def told(place: Column) -> Column:
        listed = F.try_variant_get(place, "$", "array<string>")
        parts = bound(F.array(*[_any(place, KEYS[k]) for k in ("city", "region", "country")]), lambda p: F.when(F.exists(p, lambda x: x.isNotNull()), p))
        text = F.when(F.schema_of_variant(place) == "STRING", T.split_location(F.try_variant_get(place, "$", "string")))
        # only an object has parts, only a string is split, so whichever is tried first
        return F.when(place.isNotNull(), F.coalesce(parts, F.when(F.size(listed) >= 3, F.slice(listed, 1, 3)), text))

    return F.coalesce(bound(_get(v, "location", "variant"), told), F.array(*[F.lit(None).cast("string")] * 3))


def _links(v: Column) -> Column:
    flat = F.coalesce(*[_get(v, k, "array<string>") for k in KEYS["links"]])
    named = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "variant") for k in KEYS["links"]])
    last = lambda word: F.try_element_at(F.filter(flat, lambda u: F.contains(u, F.lit(word))), F.lit(-1))
    others = F.filter(flat, lambda u: ~u.rlike(r"linkedin\.com|github\.com"))
    by_list = F.struct(last("linkedin.com").alias("linkedin"), last("github.com").alias("github"), F.lit(None).cast("string").alias("portfolio"), others.alias("other"))
    by_name = F.struct(*[_get(named, k).alias(k) for k in ("linkedin", "github", "portfolio")], F.coalesce(_get(named, "other", "array<string>"), F.array().cast("array<string>")).alias("other"))
    return F.when(flat.isNotNull(), by_list.cast(LINKS)).otherwise(by_name.cast(LINKS))


def _items(v: Column, names: list[str], fields: list[str], defaults: dict[str, str], kind: str) -> Column:
    listed = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "array<variant>") for k in names])
    one = lambda x: F.struct(*[F.coalesce(_any(x, KEYS[f]), F.lit(defaults.get(f))).alias(f) for f in fields])
    made = F.transform(listed, one)
    if "end_year" in fields:
        made = F.transform(made, lambda s: F.struct(*[(s[f].try_cast("int") if f == "end_year" else s[f]).alias(f) for f in fields]))
    return F.coalesce(made.cast(kind), F.array().cast(kind))


def _skills(v: Column) -> Column:
    listed = F.try_variant_get(v, "$.skills", "array<variant>")
    named = F.transform(listed, lambda s: F.coalesce(_get(s, "name"), F.try_variant_get(s, "$", "string")))
    return F.coalesce(F.filter(named, lambda s: F.length(s) > 0), F.array().cast("array<string>"))


def bad_number(v: Column) -> Column:
    """Why the years of experience of a profile are no number; null if they are one or missing."""
    raw = F.coalesce(*[_get(v, k) for k in KEYS["years"]])
    bad = (F.length(raw) > 0) & raw.try_cast("double").isNull()
    return F.when(bad, F.concat(F.lit("could not convert string to float: '"), raw, F.lit("'")))


def from_json(v: Column, only: Collection[str] = tuple(EXTRACTED)) -> dict[str, Column]:
    """The facts of a profile: see profile()."""
    made = {
        "full_name": lambda: _any(v, KEYS["name"]),
        "emails": lambda: _strings(v, KEYS["emails"]),
        "phones": lambda: _strings(v, KEYS["phones"]),
        "location": lambda: _location(v),
        "links": lambda: _links(v),
        "headline": lambda: _any(v, KEYS["headline"]),
        "years_experience": lambda: F.nullif(F.coalesce(*[_get(v, k, "double") for k in KEYS["years"]]), F.lit(0.0)),
        "skills": lambda: _skills(v),
        "experience": lambda: _items(v, KEYS["experience"], ["company", "title", "start", "end", "summary"], {"company": X.UNKNOWN_COMPANY, "title": X.UNKNOWN_TITLE}, T.JOB),
        "education": lambda: _items(v, KEYS["education"], ["institution", "degree", "field", "end_year"], {"institution": X.UNKNOWN_SCHOOL}, T.STUDY),
    }
    return {k: make() for k, make in made.items() if k in only}


def from_row(v: Column, only: Collection[str] = tuple(EXTRACTED)) -> dict[str, Column]:
    """A row of a recruiter's export, as an object with lower-case keys."""
    nothing = F.array().cast("array<string>")

    def one(k: str) -> Column:
        return F.coalesce(F.when(_any(v, [k]).isNotNull(), F.array(_any(v, [k]))), nothing)

    def jobs() -> Column:
        company, title = _any(v, ["current_company"]), _any(v, KEYS["title"])
        job = F.struct(F.coalesce(company, F.lit(X.UNKNOWN_COMPANY)), F.coalesce(title, F.lit(X.UNKNOWN_TITLE)), F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("Imported from recruiter CSV export."))
        return F.when(company.isNotNull() | title.isNotNull(), F.array(job).cast(T.JOB)).otherwise(F.array().cast(T.JOB))

    made = {
        "full_name": lambda: _any(v, ["name", "full_name"]),
        "emails": lambda: one("email"),
        "phones": lambda: one("phone"),
        "location": lambda: F.coalesce(T.split_location(_any(v, ["location"])), F.array(*[F.lit(None).cast("string")] * 3)),
        "links": lambda: F.struct(F.lit(None), F.lit(None), F.lit(None), nothing).cast(LINKS),
        "headline": lambda: F.lit(None).cast("string"),
        "years_experience": lambda: F.lit(None).cast("double"),
        "skills": lambda: nothing,
        "experience": jobs,
        "education": lambda: F.array().cast(T.STUDY),
    }
    return {k: make() for k, make in made.items() if k in only}


def extract(payloads: DataFrame, rejected: bool = False, only: Collection[str] = tuple(EXTRACTED), kinds: Collection[str] | None = None) -> DataFrame:
    """Payloads with the facts of EXTRACTED.  rejected: sources with an error, or a number that isn't one, are kept as rows with `error`.

    only: the facts that are read later; the others' plans, most of the seconds before anything runs, aren't built.
    kinds: the content types of the payloads, where they are known, for the same reason; a row of another type then ends the run with an error.

    Every fact reads the parsed payload, which is made once per row: a generated column is one that neither projections nor
    filters above it are merged with (inline_outer, as size tests are inferred from inline).
    """
    kind = F.col("content_type")
    is_json = kind == "json"
    has = lambda k: kinds is None or k in kinds
    has_text = kinds is None or any(k not in ("csv", "json") for k in kinds)
    parsers = [(k, make) for k, make in (("csv", lambda: F.try_parse_json("content")), ("json", lambda: profile(F.col("content")))) if has(k)]
    whole = F.when(F.lit(False), F.try_parse_json(F.lit("")))
    for k, make in parsers:
        whole = whole.when(kind == k, make())
    if kinds is not None:
        known = F.when(F.coalesce(kind.isin(*kinds), F.lit(False)), kind).otherwise(F.raise_error(F.concat(F.lit(f"content type other than {', '.join(kinds)}: "), F.coalesce(kind, F.lit("null")))).cast("string"))
        payloads = payloads.withColumn("content_type", known)
    told = lambda v: F.struct(v.alias("__v"), F.coalesce("error", F.when(is_json, bad_number(v))).alias("__why"))
    payloads = payloads.select("*", F.inline_outer(F.transform(F.array(whole), told))).drop("error").withColumnRenamed("__why", "error")
    payloads = payloads if rejected else payloads.filter(F.col("error").isNull())
    by_kind = [(k, make(F.col("__v"), only)) for k, make in (("csv", from_row), ("json", from_json)) if has(k)]
    texts = T.extract(F.coalesce("content", F.lit("")), only=only) if has_text else {}

    def pick(c: str, t: str) -> Column:
        # of known kinds the last needs no test
        tests = by_kind if has_text else by_kind[:-1]
        last = (texts if has_text else by_kind[-1][1])[c].cast(t)
        out = None
        for k, facts in tests:
            out = (F if out is None else out).when(kind == k, facts[c].cast(t))
        return last if out is None else out.otherwise(last)

    sure = F.when(kind.isin("csv", "json"), X.STRUCTURED_CONFIDENCE).otherwise(X.TEXT_CONFIDENCE)
    method = F.when(kind.isin("csv", "json"), "structured_map").otherwise("regex_heuristics")
    record = F.sha2(F.concat_ws("|", "source", F.col("ingest_seq").cast("string")), 256)
    told = ["error"] if rejected else []
    fact = lambda c, t: F.when(F.col("error").isNull(), pick(c, t)) if rejected else pick(c, t)
    return payloads.select(record.alias("record_id"), "source", "content_type", "ingest_ts", F.col("ingest_seq").alias("seq"), method.alias("method"), sure.alias("confidence"), *(fact(c, t).alias(c) for c, t in EXTRACTED.items() if c in only), *told)
