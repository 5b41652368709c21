import io
import json
import logging
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from goldweave import logs
from goldweave.plans.golden import normalized, run, stats, timeline
from goldweave.plans.projection import project
from goldweave.plans.schemas import PAYLOAD
from goldweave.plans.staging import made_since
from goldweave.queries import QUERIES, _golden_run, _profiles_json
from goldweave.sources import readers, sinks
from goldweave.sources.structured import extract, lower_keys
from goldweave.streaming.winners import streaming_winners, windowed_winners

RECORD = "full_name string, emails array<string>, phones array<string>, years double, skills array<struct<name:string,confidence:double>>, links struct<github:string>, provenance array<struct<field:string,source:string>>, overall_confidence double"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("John Doe", ["a@b.c", "d@e.f"], ["2024561111"], 4.5, [("js", 0.6), (None, 1.0)], ("https://github.com/j",), [("emails", "x"), ("skills", "y")], 0.9), ("Solo", [], None, None, [], None, [], 1.0)], RECORD)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def test_subset_rename_paths_types(people):
    config = {"include_confidence": False, "fields": [
        {"path": "name", "from": "full_name"}, {"path": "mail", "from": "emails[0]"}, {"path": "second", "from": "emails[1]"}, {"path": "skill_names", "from": "skills[].name"}, {"path": "git", "from": "links.github"},
        {"path": "text", "from": "emails", "type": "string"}, {"path": "list", "from": "full_name", "type": "string[]"}, {"path": "n", "from": "years", "type": "number"}, {"path": "flag", "from": "emails", "type": "boolean"},
        {"path": "none", "from": "skills[].name.deeper"}, {"path": "gone", "from": "skills[x]"}, {"path": "tel", "from": "phones[0]", "normalize": "E164"}, {"from": "full_name"},
    ]}
    one, two = rows(project(people, config))
    assert one == {"name": "John Doe", "mail": "a@b.c", "second": "d@e.f", "skill_names": ["js"], "git": "https://github.com/j", "text": "a@b.c, d@e.f", "list": ["John Doe"], "n": 4.5, "flag": False, "none": None, "gone": None, "tel": "+912024561111"}
    assert two["mail"] is None and two["skill_names"] is None and two["text"] == ""


def test_anonymize_canonical_lowercase(people):
    config = {"include_confidence": False, "fields": [{"path": "full_name", "normalize": "anonymize"}, {"path": "hidden", "from": "skills[].name", "normalize": "anonymize"}, {"path": "known", "from": "skills[].name", "normalize": "canonical"}, {"path": "low", "from": "full_name", "normalize": "lowercase"}, {"path": "same", "from": "full_name", "type": "object", "normalize": "what"}]}
    one, two = rows(project(people, config))
    assert one == {"full_name": "J. D.", "hidden": ["[Redacted Skill]"], "known": ["JavaScript"], "low": "john doe", "same": "John Doe"}
    assert two["full_name"] == "C. A."


def test_missing_policies(people):
    field = {"path": "mail", "from": "emails[0]", "required": True}
    omitted = [r["record"] for r in rows(project(people, {"fields": [field], "on_missing": "omit", "include_confidence": False}))]
    assert omitted == ['{"mail":"a@b.c"}', "{}"]
    with pytest.raises(PySparkException, match="mail"):
        project(people, {"fields": [field], "on_missing": "error"}).collect()
    with pytest.raises(ValueError, match="Self-conflicting"):
        project(people, {"fields": [field, field]})


def test_provenance_is_renamed(people):
    one = rows(project(people, {"fields": [{"path": "mail", "from": "emails[0]"}]}))[0]
    assert one["provenance"] == [{"field": "mail", "source": "x"}] and one["overall_confidence"] == 0.9


def _docx(*paragraphs):
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}<w:tbl/></w:body></w:document>')
    return out.getvalue()


def test_files_of_all_kinds(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Name,Email\nMira Quell,m@q.org\nOtto,o@b.net\n", encoding="utf-8")
    (tmp_path / "none.csv").write_text("")
    (tmp_path / "b.json").write_text('{"profile": {"NAME": "Ann", "email": "a@n.org", "location": "Pune, India"}}')
    (tmp_path / "bad.json").write_text('{"name": "x"')
    (tmp_path / "none.json").write_text("")
    (tmp_path / "c.txt").write_text("Name: Bo Li\n")
    (tmp_path / "d.docx").write_bytes(_docx("Name: Cy Roe", " ", "Python"))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    names = ["a.csv", "none.csv", "b.json", "bad.json", "none.json", "c.txt", "d.docx", "bad.docx", "lost.txt"]
    payloads, missing = readers.read(spark, [str(tmp_path / n) for n in names])
    assert [m.rsplit("/", 1)[-1] for m in missing] == ["lost.txt"]
    bad = {r.source: r.error for r in payloads.filter("error is not null").collect()}
    assert set(bad) == {"bad.json", "bad.docx"} and "line 1" in bad["bad.json"]
    found = {r.full_name: r for r in extract(payloads).filter("full_name is not null").collect()}
    assert set(found) == {"Mira Quell", "Otto", "Ann", "Bo Li", "Cy Roe"}
    assert found["Mira Quell"].emails == ["m@q.org"] and found["Ann"].emails == ["a@n.org"] and found["Ann"].location == ["Pune", None, "India"]
    assert found["Cy Roe"].skills == ["Python"] and found["Ann"].confidence == 1.0 and found["Bo Li"].confidence == 0.6
    with pytest.raises(ValueError, match="supported"):
        readers.extension_of("x.xyz")
    assert readers.read_csv(spark, [str(tmp_path / "a.csv")], first_row_only=True).count() == 1


def test_files_of_equal_names_and_their_order(spark, tmp_path):
    """Two folders with a file of one name: both are read, in the order of the paths; of equal trust the later one wins."""
    for d, name in (("a b", "Ann Lee"), ("b", "Anne Lee")):
        (tmp_path / d).mkdir()
        (tmp_path / d / "notes.txt").write_text(f"Name: {name}\nEmail: ann@x.org\n")
    for order in (["a b", "b"], ["b", "a b"]):
        payloads, missing = readers.read(spark, [f"{tmp_path}/{d}/notes.txt" for d in order])
        assert not missing and payloads.count() == 2 and payloads.select("ingest_seq").distinct().count() == 2
        done = run(payloads)
        want = {"a b": "Ann Lee", "b": "Anne Lee"}[order[-1]]
        assert [r.full_name for r in done.golden.collect()] == [want]
        (told,) = done.provenance.filter("field = 'full_name'").collect()
        assert told.decision_reason == "Recency tie-breaker (incoming newer)"


def test_export_and_profile_of_equal_trust(spark):
    """Both sources have 20 and are sure: the one that is processed later wins, in either order."""
    items = [("recruiter_export.csv", "csv", '{"name": "Ann Lee", "email": "ann@x.org"}'), ("ats_profile.json", "json", '{"name": "Anne Lee-Berg", "email": "ann@x.org", "skills": ["js"]}')]
    for order in (items, items[::-1]):
        done = run(readers.in_memory(spark, order))
        want = {"recruiter_export.csv": "Ann Lee", "ats_profile.json": "Anne Lee-Berg"}[order[-1][0]]
        assert done.golden.first().full_name == want
    done = run(readers.in_memory(spark, items), priorities={"recruiter_export.csv": 90, "ats_profile.json": 40})
    g = done.golden.first()
    assert g.full_name == "Ann Lee" and [s.name for s in g.skills] == ["JavaScript"]
    assert timeline(done).filter("status = 'ok'").count() == 3


def test_bad_numbers_reject_their_source(spark):
    items = [("a.json", "json", '{"name": "Ann Lee", "years_experience": "many"}'), ("b.json", "json", '{"name": "Otto Brandt", "years_experience": "4.5"}'), ("bad.json", "json", None)]
    payloads = readers.in_memory(spark, items)
    done = run(payloads)
    assert [(r.source, r.error) for r in done.rejected.collect()] == [("a.json", "could not convert string to float: 'many'")]
    assert {r.full_name: r.years_experience for r in done.golden.collect()}["Otto Brandt"] == 4.5
    assert {r.stage for r in timeline(done).collect()} == {"Parse", "Identity Resolution", "Field Merge", "Parse: a.json"}


def test_plain_pdf_text():
    data = b"%PDF-1.4\n1 0 obj\n<</Length 9>>\nstream\nBT (Name: Cy \\(Jay\\) Roe) Tj T* [(Em) -20 (ail: ) <6340726F652E6F7267>] TJ ET\nendstream\nendobj\n2 0 obj\n<</Length 3 /Filter /DCTDecode>>\nstream\nBT (x) Tj\nendstream"
    assert readers.shown_text(data) == ["Name: Cy (Jay) Roe\nEmail: c@roe.org"]
    with pytest.raises(ValueError):
        readers.shown_text(b"no pdf")


def test_debug_log_is_off_unless_asked_for(monkeypatch, capsys):
    monkeypatch.setenv("PIPELINE_DEBUG", "0")
    logs.event("identity", "silent")
    assert capsys.readouterr().err == ""
    monkeypatch.setenv("PIPELINE_DEBUG", "1")
    assert logs.enabled()
    assert any(h.formatter for h in logging.getLogger("pipeline").handlers)
    monkeypatch.setenv("PIPELINE_DEBUG", "0")
    assert not logs.enabled()


def test_json_sink(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "é")], "a int, b string")
    sinks.write_json(df.coalesce(1), f"{tmp_path}/keep")
    sinks.write_json(df.coalesce(1), f"{tmp_path}/omit", omit_missing=True)
    read = lambda p: sorted(r.value for r in spark.read.text(f"{tmp_path}/{p}").collect())
    assert read("keep") == ['{"a":1,"b":null}', '{"a":2,"b":"é"}'] and read("omit") == ['{"a":1}', '{"a":2,"b":"é"}']


STREAM = "entity bigint, value string, priority int, confidence double, ts timestamp, seq bigint"


def test_streaming_winners_equal_batch(spark, tmp_path):
    src = f"{tmp_path}/in"
    rows_ = [(i % 3, f"v{i}", 10 + i % 2 * 10, (i % 4) / 4, f"2024-01-01 00:{i:02d}:00", i) for i in range(40)]
    df = spark.createDataFrame(rows_, STREAM.replace("ts timestamp", "ts string")).withColumn("ts", __import__("pyspark").sql.functions.to_timestamp("ts"))
    for k in range(4):
        df.filter(f"seq % 4 = {k}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    for name, out, mode in (("won", streaming_winners(stream, "entity"), "complete"), ("win", windowed_winners(stream, "entity", "10 minutes", "1 hour"), "append")):
        q = out.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    got = {r.entity: r.value for r in spark.table("won").collect()}
    best = {}
    for e, v, p, c, t, s in rows_:
        if e not in best or (p, c, t, -s) > best[e][0]:
            best[e] = ((p, c, t, -s), v)
    assert got == {e: v for e, (_, v) in best.items()}
    assert spark.table("win").count() == 0  # no window is past the watermark
    rows_ = [(1, "a", 10, 0.5, "2024-01-01 00:01:00", 0), (1, "b", 20, 0.5, "2024-01-01 00:05:00", 1), (2, "c", 10, 0.5, "2024-01-01 00:11:00", 2), (3, "late", 99, 0.9, "2024-01-01 00:02:00", 4), (1, "far", 10, 0.5, "2024-01-01 05:00:00", 3)]
    src = f"{tmp_path}/in2"
    df = spark.createDataFrame(rows_, STREAM.replace("ts timestamp", "ts string")).withColumn("ts", __import__("pyspark").sql.functions.to_timestamp("ts"))
    for part in ("seq < 3", "seq = 3", "seq = 4"):  # the last one comes after its window has been closed
        df.filter(part).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(df.schema).parquet(src)
        q = windowed_winners(stream, "entity", "10 minutes", "1 hour").writeStream.outputMode("append").option("checkpointLocation", f"{tmp_path}/state2").trigger(availableNow=True).foreachBatch(lambda b, n: b.write.mode("append").parquet(f"{tmp_path}/out2")).start()
        q.awaitTermination()
    assert sorted((r.from_ts.minute, r.entity, r.value) for r in spark.read.parquet(f"{tmp_path}/out2").collect()) == [(0, 1, "b"), (10, 2, "c")]


@pytest.mark.parametrize("name", ["json_location", "json_scalar_or_list", "normalize_records"])
def test_a_payload_is_parsed_once(spark, name):
    """However many facts read it, and whatever filters stand above; and one file's rows are several tasks'."""
    found = QUERIES[name](spark, "/root/testdata/sf0.001")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parseJson") == 1
    assert found.rdd.getNumPartitions() > 1


def test_keys_fold_beside_odd_strings(spark):
    r"""Keys with escapes and blanks before the colon, values that look like keys, long strings."""
    texts = ['{"Na\\"Me" \n: "Keep: \\"THIS\\": x", "B":["C", {"D\\\\": "E\\\\"}]}', '{"A": "' + "Y" * 20_000 + '"}', '{"A": "' + '\\"' * 200 + '"}']
    want = ['{"na\\"me" \n: "Keep: \\"THIS\\": x", "b":["C", {"d\\\\": "E\\\\"}]}', '{"a": "' + "Y" * 20_000 + '"}', '{"a": "' + '\\"' * 200 + '"}']
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", lower_keys(F.col("t")).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == want


def test_a_run_makes_only_what_is_asked_for(spark):
    """Conflicts need neither merged jobs nor provenance; what is told of the stages comes with their writing."""
    mark = len(made_since())
    done = _golden_run(spark, "/root/testdata/sf0.001")
    assert done.conflicts.count() == 3 * 150 + 75
    assert not any(f"goldweave-{name}" in p for p in made_since(mark) for name in ("provenance", "experience", "education"))
    assert [t[3] for t in done.timeline] == ["300 record(s) parsed, 0 rejected", "150 unique candidate(s), 150 duplicate(s) merged", f"{done.claims.count()} claim(s)"]


def test_only_the_wanted_facts_are_built(spark):
    """Fewer facts, the same values."""
    payloads = _profiles_json(spark, "/root/testdata/sf0.001")
    some = extract(payloads, only=["emails", "location"])
    assert set(some.columns) - set(extract(payloads.limit(0)).columns) == set() and "skills" not in some.columns and "links" not in normalized(some).columns
    rows_of = lambda d: sorted(map(repr, d.select("seq", "emails", "location").collect()))
    assert rows_of(some) == rows_of(extract(payloads))


def test_keys_fold_among_many_strings(spark):
    """More strings between two keys than are taken at once; texts without a key to fold stay as they are."""
    many = ",".join(f'"V{i}"' for i in range(500))
    texts = [f'{{"A":[{many}],"bÄ" :"X:"}}', '{"a":"B","c":["D", "E: F"]}', '{"a": "B" , "C" : 1}']
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", lower_keys(F.col("t")).alias("t"), F.size(F.split(lower_keys(F.col("t")), "V")).alias("n")).orderBy("i").collect()
    assert [r.t for r in got] == [f'{{"a":[{many}],"bä" :"X:"}}', texts[1], '{"a": "B" , "c" : 1}']


def test_known_kinds_leave_the_rest_unbuilt(spark):
    """A row of another kind isn't passed over: it ends the run."""
    rows = [("a.csv", "csv", '{"name": "ann lee", "email": "a@x.org"}', None, 0, None), ("b.json", "json", '{"NAME": "bob", "emails": ["b@x.org"]}', None, 1, None), ("c.json", "json", "{", None, 2, "broken")]
    payloads = spark.createDataFrame(rows, PAYLOAD)
    plain, known = (extract(payloads, rejected=True, kinds=k) for k in (None, ["csv", "json"]))
    assert known.orderBy("seq").collect() == plain.orderBy("seq").collect() and known.schema == plain.schema
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "portfolio|blog" not in plan(known) and len(plan(known)) < len(plan(plain)) / 2
    assert [r.emails for r in extract(payloads.filter("source = 'b.json'"), only=["emails"], kinds=["json"]).collect()] == [["b@x.org"]]
    with pytest.raises(Exception, match="content type other than json: csv"):
        extract(payloads, kinds=["json"]).collect()


def test_keys_are_replaced_where_texts_are_plain(spark):
    """Keys that begin like what follows a string, many keys, and strings that look like keys."""
    texts = [
        '{"a": "b", "c": 1E5, ": Foo": 2, "Bar": "Bar"}', '{"A": ["k", 1E5, ":"], "x": "B:", "B": ","}', '{"x": ": Foo", "K": 1, ", Y": "Z"}', '{"": 1, "É" : "É", "Q": {"Q" \n: "Q"}}',
        "{" + ", ".join(f'"K{i}": "K{i}"' for i in range(40)) + "}", '{"N": "he said \\"N\\": x", "a\\"N": 1}', "[]", '{"x": "],", "Y": 1}',
    ]
    want = [json.loads(t, object_pairs_hook=lambda kv: {k.lower(): v for k, v in kv}) for t in texts]
    got = [json.loads(r[0]) for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(lower_keys(F.col("t"))).collect()]
    assert got == want


def test_counters_need_no_provenance(spark):
    done = run(readers.in_memory(spark, [("recruiter_export.csv", "csv", json.dumps({"name": "ann lee", "email": "a@x.org"})), ("ats_profile.json", "json", json.dumps({"name": "Ann Leigh", "email": "a@x.org", "skills": ["js"]}))]))
    told = stats(done).first()
    assert (told.fields_merged, told.conflicts_detected, told.duplicates_removed) == (3, 1, 1) and "provenance" not in done.__dict__
