import json

import pytest

from goldweave.plans.golden import projected, run, selected
from goldweave.sources import readers

NOTES = """Candidate: Mira Quell
Email: mira.quell @example.org
GitHub: github.com/miraquell
Skills: Python, Docker, AWS and C++
Location: Pune, Maharashtra, India
Phone: +91 98765 43211

Experience

Engineer at Blue Fern
Jan 2020 - Present
Kept engines running.

Data Lead | Tall Oak
2015-03 to 2019-12

Education

B.Tech in Computing
Hill University
2011 - 2015

Skills
"""
ROW = {"name": "mira quell", "email": "mira.quell@example.org", "phone": "2024561111", "current_company": "Blue Fern Ltd", "title": "Engineer"}
OTHER = {"profile": {"Name": "Otto Brandt", "emails": ["otto@example.net"], "location": {"city": "Berlin", "country": "germany"}, "links": ["https://linkedin.com/in/otto?x=1", "https://otto.dev"], "skills": ["js", {"name": "k8s"}], "experience": [{"company": "Gamma", "title": "Dev", "start_date": "05/2018", "end_date": "2017"}], "education": [{"school": "TU", "degree": "MS", "grad_year": "2040"}]}}


@pytest.fixture(scope="module")
def done(spark):
    items = [("recruiter_export.csv", "csv", json.dumps(ROW)), ("recruiter_notes.txt", "txt", NOTES), ("ats_profile.json", "json", json.dumps(OTHER))]
    return run(readers.in_memory(spark, items))


def by_name(done):
    return {r.full_name: r for r in done.golden.collect()}


def test_notes_and_export_become_one_record(done):
    found = by_name(done)
    assert set(found) == {"Mira Quell", "Otto Brandt"}
    mira = found["Mira Quell"]
    assert mira.records == 2 and mira.emails == ["mira.quell@example.org"]
    assert mira.links.github == "https://github.com/miraquell"
    assert {s.name for s in mira.skills} == {"Python", "Docker", "AWS", "C++"}
    assert mira.location == ["Pune", "Maharashtra", "IN"]
    assert [e.company for e in mira.experience] == ["Blue Fern", "Tall Oak"]
    assert mira.experience[0].start == "2020-01" and mira.experience[0].end is None
    assert mira.education[0].institution == "Hill University" and mira.education[0].end_year == 2015
    assert mira.education[0].field == "Computing\nHill University"[: len(mira.education[0].field)]


def test_profile_is_read_checked_and_scored(done):
    otto = by_name(done)["Otto Brandt"]
    assert otto.location == ["Berlin", None, "DE"]
    assert otto.links.linkedin == "https://linkedin.com/in/otto" and otto.links.other == ["https://otto.dev"]
    assert {s.name for s in otto.skills} == {"JavaScript", "Kubernetes"}
    assert len(otto.validation_warnings) == 2
    assert otto.overall_confidence == 1.0
    assert otto.data_quality_score == pytest.approx(0.15 + 0.25 + 0.1 + 0.1 + 0.15 + 0.1 - 0.2)


def test_selection_takes_the_most_trusted_source(done):
    assert selected(done.golden).first().full_name == "Mira Quell"


def test_conflict_names_both_sides(done):
    rows = {(r.field, r.winner_source, r.decision_rule) for r in done.conflicts.collect()}
    assert not any(f == "full_name" for f, _, _ in rows)


def test_projection_of_the_run(done):
    config = {"fields": [{"path": "who", "from": "full_name", "normalize": "anonymize"}, {"path": "mail", "from": "emails[0]"}, {"path": "skills", "from": "skills[].name", "type": "string"}]}
    rows = {r.who: r for r in projected(done, config).collect()}
    assert set(rows) == {"M. Q.", "O. B."}
    assert rows["O. B."].mail == "otto@example.net" and rows["O. B."].skills == "JavaScript, Kubernetes"
