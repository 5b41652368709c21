"""Normal forms of names, contacts, dates, countries, skills and links, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from goldweave.functions import fixed as X


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def said(template: str, *values: Column) -> Column:
    """A fixed text with columns in place of each {}."""
    first, *rest = template.split("{}")
    parts = [F.lit(first)]
    for v, text in zip(values, rest, strict=True):
        parts += [v.cast("string"), F.lit(text)]
    return F.concat(*parts)


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """make(value), where `value` stands once however often it is used: copies of an expression are each worked out."""
    return F.get(F.transform(F.array(value), make), F.lit(0))


def truthy(c: Column) -> Column:
    """Null for an empty string, else the string; a null is worked out once, which with nullif would be twice."""
    return F.when(c != "", c)


def _title(c: Column) -> Column:
    """Each run of ASCII letters capitalised, whatever stands between (initcap only looks at blanks)."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit("([A-Za-z]+|[^A-Za-z]+)"), 1), lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.lower(F.substr(x, F.lit(2))))), "")


def normalize_name(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, X.HONORIFICS, ""), r"\([^)]*\)", "")
    tidy = strip(F.regexp_replace(F.replace(bare, F.lit(","), F.lit(" ")), r"\s+", " "))
    cased = F.when(tidy.rlike(r"^\p{ASCII}*$"), _title(tidy)).otherwise(tidy)
    return F.coalesce(truthy(F.when(truthy(c).isNotNull(), cased)), F.lit(X.UNKNOWN_NAME))


def normalize_email(c: Column) -> Column:
    tidy = F.lower(strip(c))
    return F.when(F.contains(tidy, F.lit("@")) & F.contains(tidy, F.lit(".")), tidy)


def normalize_phone(c: Column, country: str = "IN") -> Column:
    """E.164 where it can be told; null for too few digits, one repeated digit and made-up sequences."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?i)\s*(?:ext\.?|x|extension)\s*\d+", ""), r"[()\-\s.]", "")
    digits = F.regexp_replace(bare, r"\D", "")
    prefix = {"US": "+1", "IN": "+91"}.get(country)
    local = F.when(F.length(digits) == 10, F.concat(F.lit(prefix), digits)) if prefix else F.lit(None).cast("string")
    fake = (F.length(digits) < 7) | digits.rlike(r"^(\d)\1*$") | digits.isin(X.FAKE_PHONES)
    form = F.when(F.startswith(bare, F.lit("+")), bare).when(F.startswith(bare, F.lit("00")), F.concat(F.lit("+"), F.substr(bare, F.lit(3))))
    return F.when(~fake, F.coalesce(form, local, F.concat(F.lit("+"), digits)))


def normalize_date(c: Column) -> Column:
    """yyyy-MM; null for an open end; the tidied input where no year is found.

    Patterns are met only where a cheaper test of the same text lets them, each once.
    """
    low = F.lower(strip(c))
    iso = truthy(F.regexp_extract(c, r"\b(\d{4}-\d{2})\b", 1))
    slash = F.when(F.contains(c, F.lit("/")), truthy(F.regexp_extract(c, r"\b(\d{1,2}/\d{4})\b", 1)))
    year = truthy(F.regexp_extract(c, r"\b(\d{4})\b", 1))
    # the first month of the list whose name occurs anywhere, not the first in the text
    month = F.coalesce(*[F.when(F.contains(low, F.lit(m)), F.lit(f"-{i:02d}")) for i, m in enumerate(X.MONTHS, 1)], F.lit("-01"))
    turned = F.concat(F.right(slash, F.lit(4)), F.lit("-"), F.lpad(F.substring_index(slash, "/", 1), 2, "0"))
    found = F.coalesce(iso, turned, F.concat(year, month), strip(c))
    return F.when(truthy(c).isNotNull() & ~low.isin(X.OPEN_ENDED) & ~F.contains(low, F.lit("currently")), found)


def _looked_up(table: dict[str, list[str]], key: Column) -> Column:
    """The name whose spellings hold the key."""
    return F.try_element_at(F.create_map(*[F.lit(x) for name, spellings in table.items() for s in spellings for x in (s, name)]), key)


def normalize_country(c: Column) -> Column:
    tidy = strip(c)
    return F.when(truthy(c).isNotNull(), F.coalesce(_looked_up(X.COUNTRIES, F.lower(tidy)), F.left(F.upper(tidy), F.lit(2))))


def normalize_skill(c: Column) -> Column:
    tidy = strip(c)
    return F.coalesce(_looked_up(X.SKILLS, F.lower(tidy)), tidy)


def normalize_url(c: Column) -> Column:
    tidy = strip(c)
    full = F.when(F.lower(tidy).rlike("^https?://"), tidy).otherwise(F.concat(F.lit("https://"), tidy))
    known = F.lower(full).rlike(r"linkedin\.com|github\.com")
    return F.when(truthy(c).isNotNull(), F.when(known, F.substring_index(full, "?", 1)).otherwise(full))
