"""Facts about a person read from free text, as Column expressions of one text column.

Each fact is an expression of its own, so a query that needs two of them pays for two.
"""

from __future__ import annotations

from collections.abc import Callable, Collection

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldweave.functions import fixed as X
from goldweave.functions.normalize import bound, strip, truthy


def _first(text: Column, pattern: str, group: int = 0) -> Column:
    return truthy(F.regexp_extract(text, pattern, group))


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), group)


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def repair_emails(text: Column, guard: bool = True) -> Column:
    """Addresses without the blanks that copying puts around @ and the last dot.

    guard: not across the end of a sentence (`a@b.com. Then` stays); without it, as the pattern alone would have it.
    """
    pattern = X.SPACED_EMAIL.replace(r"\s*\.\s*", r"(?:\s+\.\s*|\.)") if guard else X.SPACED_EMAIL
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, pattern, "$1@$2.$3")).otherwise(text)


def addresses(text: Column) -> Column:
    """Distinct addresses as they stand; texts without an @, which are most, don't meet the pattern."""
    none = F.when(text.isNotNull(), F.array().cast("array<string>"))
    return F.when(F.contains(text, F.lit("@")), F.array_distinct(_all(text, X.EMAIL))).otherwise(none)


def emails(text: Column, guard: bool = True) -> Column:
    return addresses(repair_emails(text, guard))


def phones(text: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(_all(text, X.PHONE), strip), lambda p: F.length(p) >= 7))


def _https(link: Column) -> Column:
    return F.when(F.startswith(link, F.lit("http")), link).otherwise(F.concat(F.lit("https://"), link))


def linkedin(text: Column) -> Column:
    return _https(_first(text, X.LINKEDIN))


def github(text: Column) -> Column:
    return _https(_first(text, X.GITHUB))


def _web_links(text: Column) -> Column:
    """Links that are neither addresses, nor profiles, nor mail providers, in order."""
    full = _all(text, X.URL)
    found = F.transform(F.when(F.size(full) > 0, full).otherwise(_all(text, X.DOMAIN)), lambda u: F.regexp_replace(u, r"[.,;()\[\]{}]+$", ""))

    def keep(u: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(u, r"^https?://(www\.)?", ""), "/+$", "")
        return ~F.contains(u, F.lit("@")) & ~u.rlike(r"linkedin\.com|github\.com") & ~F.split_part(bare, F.lit("/"), F.lit(1)).isin(X.MAIL_PROVIDERS)

    return F.filter(found, keep)


def portfolio(text: Column) -> Column:
    return F.get(F.filter(_web_links(text), lambda u: u.rlike(X.PORTFOLIO)), F.lit(0))


def other_links(text: Column) -> Column:
    links = _web_links(text)
    at = F.array_position(F.transform(links, lambda u: u.rlike(X.PORTFOLIO)), True)
    return F.array_distinct(F.filter(links, lambda u, i: i + 1 != at))


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda s: F.length(s) > 0)


def name_by_label(text: Column) -> Column:
    return strip(_first(text, X.NAME_LABEL, 1))


def name_by_position(text: Column) -> Column:
    """The first of the first three lines with two or three words that isn't a heading or an address."""
    like = lambda s: F.size(F.split(s, r"\s+")).between(2, 3) & ~F.lower(s).rlike("page|resume|cv|@")
    return F.get(F.filter(F.slice(_lines(text), 1, 3), like), F.lit(0))


def full_name(text: Column) -> Column:
    return F.coalesce(name_by_label(text), name_by_position(text))


def skills(text: Column) -> Column:
    """Known terms that stand as whole tokens, in the order of the list; a pattern is met only by texts that contain its term."""
    low = F.lower(text)
    quoted = lambda s: "".join(c if c.isalnum() or c == " " else "\\" + c for c in s)
    stands = lambda s: F.contains(low, F.lit(s)) & low.rlike(rf"(?U)(?<!\w){quoted(s)}(?!\w)")
    return F.array_compact(F.array(*[F.when(stands(s), F.lit(X.SKILL_CASES.get(s, s.title()))) for s in X.SCANNED_SKILLS]))


def headline(text: Column) -> Column:
    return truthy(strip(F.regexp_replace(_first(text, X.HEADLINE, 1), r"\s+", " ")))


def split_location(place: Column) -> Column:
    """[city, region, country] of `city, region, country`, `city, country`, `city, region` or `city`."""

    def told(parts: Column) -> Column:
        part = lambda i: F.get(parts, F.lit(i))
        known = F.try_element_at(F.create_map(*[F.lit(x) for kv in X.CITIES.items() for x in kv]), F.lower(part(0)))
        is_country = (F.length(part(1)) == 2) | F.lower(part(1)).isin(X.COUNTRY_WORDS)
        two = F.size(parts) == 2
        region = F.when(F.size(parts) >= 3, part(1)).when(two & ~is_country, part(1))
        country = F.when(F.size(parts) >= 3, part(2)).when(two & is_country, part(1)).otherwise(known)
        return F.array(part(0), region, country)

    return bound(place, lambda p: F.when(truthy(p).isNotNull(), bound(F.transform(F.split(p, ","), strip), told)))


def location(text: Column) -> Column:
    named = split_location(strip(F.coalesce(*[_first(text, p, 1) for p in X.LOCATIONS])))
    phrases = [F.when(F.contains(text, F.lit(k)), _strings(list(v))) for k, v in X.PLACES.items()]
    cities = [F.when(text.rlike(rf"(?i)\b{k}\b"), F.array(F.lit(k.title()), F.lit(None).cast("string"), F.lit(v))) for k, v in X.CITIES.items()]
    return F.coalesce(named, *phrases, *cities, F.array(*[F.lit(None).cast("string")] * 3))


def _paragraphs(section: Column) -> Column:
    return F.filter(F.transform(F.split(section, "\n\n"), strip), lambda p: F.length(p) > 0)


def _per_paragraph(section: Column, make: Callable[[Column, Column], Column], kind: str) -> Column:
    return F.coalesce(F.transform(_paragraphs(section), lambda p: make(p, _lines(p))), F.array().cast(kind))


JOB = "array<struct<company:string,title:string,start:string,end:string,summary:string>>"
STUDY = "array<struct<institution:string,degree:string,field:string,end_year:int>>"


def experience(text: Column) -> Column:
    """Jobs of the work section, a paragraph each: title and company, dates, the rest as summary."""

    def job(p: Column, lines: Column) -> Column:
        head = F.split(F.get(lines, F.lit(0)), X.JOB_SPLIT, 2)
        two = F.size(head) == 2
        rest = F.array_join(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), " ")
        return F.struct(
            F.when(two, strip(F.get(head, F.lit(1)))).otherwise(F.get(lines, F.lit(0))).alias("company"),
            F.when(two, strip(F.get(head, F.lit(0)))).otherwise(F.lit(X.UNKNOWN_TITLE)).alias("title"),
            _first(p, X.JOB_DATES, 1).alias("start"),
            _first(p, X.JOB_DATES, 2).alias("end"),
            F.when(F.size(lines) > 1, rest).otherwise(F.lit("Extracted from resume text.")).alias("summary"),
        )

    return _per_paragraph(_first(text, X.WORK_SECTION, 1), job, JOB)


def education(text: Column) -> Column:
    """Studies of the education section, a paragraph each."""

    def study(p: Column, lines: Column) -> Column:
        line = lambda i: F.get(lines, F.lit(i))
        schools = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda s: F.lower(s).rlike("|".join(X.SCHOOL_WORDS)))
        place = F.when(line(0).rlike(X.DEGREE_START), F.coalesce(F.get(schools, F.lit(0)), line(1), F.lit(X.UNKNOWN_SCHOOL))).otherwise(line(0))
        degree = _first(p, rf"(?i)\b({X.DEGREE})\b", 1)
        after = strip(F.regexp_extract(p, rf"(?is)\b(?:{X.DEGREE})\b(.*)", 1))
        after = F.regexp_replace(after, r"(?i)^[.,\s]+(?:in|of|major\s+in)?\s+", "")
        subject = F.regexp_replace(strip(F.regexp_replace(after, r"(?is)\b(?:19\d{2}|20\d{2}|present|current|ongoing)\b.*", "")), r"[.,;()\[\]{}–\-—\s]+$", "")
        field = F.coalesce(strip(_first(p, X.STUDY_FIELD, 1)), F.when(degree.isNotNull() & (F.length(subject) >= 3), subject))
        return F.struct(place.alias("institution"), degree.alias("degree"), field.alias("field"), F.try_element_at(_all(p, X.STUDY_DATES, 1), F.lit(-1)).try_cast("int").alias("end_year"))

    return _per_paragraph(_first(text, X.STUDY_SECTION, 1), study, STUDY)


def years_of(jobs: Column, reference_year: int = 2026) -> Column:
    """Years between the starts and ends of jobs; an open end counts to `reference_year`; null unless positive."""
    year = lambda c: F.regexp_extract(c, r"\b(19\d{2}|20\d{2})\b", 1).try_cast("int")

    def span(j: Column) -> Column:
        last = F.coalesce(year(j["end"]), F.when(F.contains(F.lower(j["end"]), F.lit("present")), F.lit(reference_year)))
        return F.coalesce(last - year(j["start"]), F.lit(0))

    total = F.aggregate(jobs, F.lit(0), lambda s, j: s + span(j))
    return F.when(total > 0, total.cast("double"))


def extract(text: Column, guard: bool = True, reference_year: int = 2026, only: Collection[str] | None = None) -> dict[str, Column]:
    """All facts, or those of `only`, by the column names of extracted records."""
    clean = repair_emails(text, guard)
    made = {
        "full_name": lambda: full_name(text),
        "emails": lambda: emails(text, guard),
        "phones": lambda: phones(clean),
        "location": lambda: location(text),
        "links": lambda: F.struct(linkedin(clean).alias("linkedin"), github(clean).alias("github"), portfolio(clean).alias("portfolio"), other_links(clean).alias("other")),
        "headline": lambda: headline(text),
        "years_experience": lambda: years_of(experience(text), reference_year),
        "skills": lambda: skills(text),
        "experience": lambda: experience(text),
        "education": lambda: education(text),
    }
    return {k: make() for k, make in made.items() if only is None or k in only}
