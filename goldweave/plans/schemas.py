"""Types of records on their way from sources to golden records."""

from __future__ import annotations

from goldweave.functions.text import JOB, STUDY

LINKS = "struct<linkedin:string,github:string,portfolio:string,other:array<string>>"
#: What every source is read into: a row per input file, or per line of a CSV file.
PAYLOAD = "source string, content_type string, content string, ingest_ts timestamp, ingest_seq bigint, error string"
#: Facts of a record as its source states them.
EXTRACTED = {"full_name": "string", "emails": "array<string>", "phones": "array<string>", "location": "array<string>", "links": LINKS, "headline": "string", "years_experience": "double", "skills": "array<string>", "experience": JOB, "education": STUDY}
#: One value with where it came from; `value` may be null in a claim that exists (an open end date).
CLAIM = "record_id string, ingest_seq bigint, field string, pos int, value string, source string, method string, confidence double, ingest_ts timestamp"
SCALARS = ["full_name", "headline", "years_experience", "city", "region", "country", "linkedin", "github", "portfolio"]
LISTS = ["emails", "phones", "other_links", "skills"]
