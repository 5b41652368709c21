"""The whole run: payloads -> records -> entities -> surviving claims -> golden records -> projection.

Records, entities and claims are written to the shared folder, so that what is made of them reads them instead of parsing
again; the tables made of these are worked out only where they are asked for; identity writes its rounds there too.  Shuffles: keys and components, (entity, field) and entity.

Recency is the order of processing: of claims with equal priority and confidence the later record's wins.  Times of
ingestion are kept beside it.
"""

from __future__ import annotations

import time
from collections.abc import Collection
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from goldweave import logs
from goldweave.functions import fixed as X
from goldweave.functions import normalize as N
from goldweave.operators import analytics as A
from goldweave.operators import golden as G
from goldweave.operators import identity, items, survivorship
from goldweave.plans.projection import project
from goldweave.plans.schemas import LISTS, SCALARS
from goldweave.plans.staging import staged
from goldweave.sources.structured import extract

TIMELINE = "stage string, status string, duration_ms double, detail string"


class Run:
    """The tables of a run; each is a lazy DataFrame, made when it is asked for.  timeline: what the eager stages took."""

    def __init__(self, extracted: DataFrame, records: DataFrame, links: DataFrame, owned: DataFrame, claims: DataFrame, timeline: list[tuple[str, str, float, str]]):
        self.records, self.links, self.owned, self.claims, self.timeline = records, links, owned, claims, timeline
        self.rejected = extracted.filter("error is not null").select("source", "content_type", "error")
        self.single = claims.filter(F.col("field").isin(SCALARS))
        self._kept: set[str] = set()

    @cached_property
    def winners(self) -> DataFrame:
        return survivorship.winners(self.single, "entity", "field", [*_CARRY, "seq"])

    @cached_property
    def lists(self) -> DataFrame:
        return survivorship.list_union(self.claims.filter(F.col("field").isin(LISTS)), "entity", "field", _CARRY)

    @cached_property
    def merged(self) -> dict[str, DataFrame]:
        """Jobs and studies of each entity."""
        return {kind: items.collections(_items(self.owned, kind), kind) for kind in ("experience", "education")}

    @cached_property
    def provenance(self) -> DataFrame:
        return _provenance(self.single, self.winners, self.lists, self.merged)

    @cached_property
    def conflicts(self) -> DataFrame:
        found = survivorship.conflicts(_tagged(self.single), ["entity", "field"])
        for kind in ("experience", "education"):
            found = found.unionByName(items.conflicts(_items(self.owned, kind), kind))
        return found

    @cached_property
    def golden(self) -> DataFrame:
        return _golden(self)

    def keep(self, name: str) -> DataFrame:
        """Writes a table that is going to be read more than once, unless that is done."""
        if name not in self._kept:
            self._kept.add(name)
            made = getattr(self, name)
            setattr(self, name, {k: staged(d, k) for k, d in made.items()} if isinstance(made, dict) else staged(made, name))
        return getattr(self, name)


_CARRY = ["source", "method", "confidence"]


def normalized(extracted: DataFrame, country: str = "IN") -> DataFrame:
    """Records with normal forms of the facts that are there; invalid contacts are dropped."""
    some = lambda c, f: F.filter(F.transform(F.col(c), f), lambda v: F.length(v) > 0)
    place = lambda i: N.strip(F.get("location", F.lit(i)))
    jobs = lambda: F.transform("experience", lambda j: F.struct(N.strip(j["company"]).alias("company"), N.strip(j["title"]).alias("title"), N.normalize_date(j["start"]).alias("start"), N.normalize_date(j["end"]).alias("end"), N.strip(j["summary"]).alias("summary")))
    made = {
        "full_name": lambda: [F.when(N.truthy(F.col("full_name")).isNotNull(), N.normalize_name(F.col("full_name"))).alias("full_name")],
        "emails": lambda: [some("emails", N.normalize_email).alias("emails")],
        "phones": lambda: [some("phones", lambda p: N.normalize_phone(p, country)).alias("phones")],
        "location": lambda: [N.truthy(place(0)).alias("city"), N.truthy(place(1)).alias("region"), N.normalize_country(F.get("location", F.lit(2))).alias("country")],
        "links": lambda: [*(N.normalize_url(F.col(f"links.{k}")).alias(k) for k in ("linkedin", "github", "portfolio")), some("links.other", N.normalize_url).alias("other_links")],
        "headline": lambda: [N.truthy(N.strip(F.col("headline"))).alias("headline")],
        "years_experience": lambda: [F.col("years_experience")],
        "skills": lambda: [some("skills", N.normalize_skill).alias("skills")],
        "experience": lambda: [jobs().alias("experience")],
        "education": lambda: [F.col("education")],
    }
    facts = [c for k, make in made.items() if k in extracted.columns for c in make()]
    return extracted.select("record_id", "source", "content_type", "method", "confidence", "ingest_ts", F.col("seq").alias("ts"), "seq", *facts)


def to_claims(records: DataFrame) -> DataFrame:
    """Long form: a row per record, field and value."""
    own = ["entity", "record_id", "source", "method", "confidence", "ingest_ts", "ts", "seq", "priority"]
    single = F.array(*[F.struct(F.lit(f).alias("field"), F.lit(0).alias("pos"), F.col(f).cast("string").alias("value")) for f in SCALARS])

    def listed(f: str):
        return F.transform(F.coalesce(F.col(f), F.array().cast("array<string>")), lambda v, i: F.struct(F.lit(f).alias("field"), i.alias("pos"), v.alias("value")))

    lists = [listed(f) for f in LISTS]
    return records.select(*own, F.inline(F.concat(F.filter(single, lambda s: s["value"].isNotNull()), *lists)))


def _items(records: DataFrame, kind: str) -> DataFrame:
    cols = ["entity", "seq", "source", "method", "priority", "confidence", "ts"]
    return records.select(*cols, F.posexplode(kind).alias("pos", "x")).select(*cols, "pos", "x.*")


def _tagged(claims: DataFrame) -> DataFrame:
    """Fields by the names that conflicts have for them."""
    return claims.withColumn("field", F.coalesce(*[F.when(F.col("field") == k, v) for k, v in X.CONFLICT_FIELDS.items()], F.col("field")))


def _provenance(single: DataFrame, winners: DataFrame, lists: DataFrame, merged: dict[str, DataFrame]) -> DataFrame:
    """entity, field, value, item, source, method, confidence, decision_reason: a row per surviving value; seq orders them."""
    cols = ["entity", "field", "value", "item", "source", "method", "confidence", "decision_reason", "seq"]
    none = F.lit(None).cast("string")
    reasons = survivorship.decision_reasons(single, "entity", "field")
    out = winners.join(reasons, ["entity", "field"], "left").withColumn("item", none).select(*cols)
    out = out.unionByName(lists.withColumn("item", none).withColumn("decision_reason", F.col("list_reason")).withColumn("seq", F.col("first_seq")).select(*cols))
    for kind, done in merged.items():
        fields = [f.name for f in done.schema.fields if f.name not in ("entity", "pos", "sources", "proof")]
        value = F.coalesce(*[F.when(F.col("p.field") == f, F.col(f"`{f}`").cast("string")) for f in fields])
        rows = done.withColumn("p", F.explode("proof"))
        out = out.unionByName(rows.select("entity", F.concat(F.lit(f"{kind}."), F.col("p.field")).alias("field"), value.alias("value"), F.col(fields[0]).alias("item"), "p.source", "p.method", "p.confidence", "p.decision_reason", F.col("pos").cast("bigint").alias("seq")))
    return out


def run(payloads: DataFrame, priorities: dict[str, int] | None = None, country: str = "IN", mode: str = "exact", fuzzy: bool = True, kinds: Collection[str] | None = None) -> Run:
    """All entities of the payloads as golden records; mode and fuzzy: see identity.resolve(), kinds: structured.extract()."""
    timeline: list[tuple[str, str, float, str]] = []

    def timed(stage: str, make, detail: str) -> DataFrame:
        began = time.perf_counter()
        try:
            out, told = make()
        except Exception as e:
            logs.error(stage, e)
            raise
        timeline.append((stage, "ok", (time.perf_counter() - began) * 1000, detail.format(*told)))
        logs.event(stage, timeline[-1][3])
        return out

    def written(df: DataFrame, name: str, *told: Column) -> tuple[DataFrame, tuple]:
        """The table, with what is told of it: that comes with the writing."""
        seen = Observation()
        out = staged(df.observe(seen, *(c.alias(f"n{i}") for i, c in enumerate(told))), name)
        return out, tuple(seen.get.values())

    extracted = timed("Parse", lambda: written(extract(payloads, rejected=True, kinds=kinds), "extracted", F.count_if(F.col("error").isNull()), F.count_if(F.col("error").isNotNull())), "{0} record(s) parsed, {1} rejected")
    records = staged(normalized(extracted.filter("error is null"), country), "records")
    people = records.select("seq", F.coalesce("full_name", F.lit("")).alias("name"), latest_company().alias("company"), "emails", "phones")
    # an entity is named by one of its own records
    own = F.col("seq") == F.col("entity")
    links = timed("Identity Resolution", lambda: written(identity.resolve(people, mode, fuzzy), "entities", F.count_if(own), F.count_if(~own)), "{0} unique candidate(s), {1} duplicate(s) merged")
    owned = survivorship.with_priority(records.join(links, "seq"), priorities=priorities, templates=True)
    claims = timed("Field Merge", lambda: written(to_claims(owned), "claims", F.count("*")), "{0} claim(s)")
    return Run(extracted, records, links, owned, claims, timeline)


def _golden(done: Run, proof: bool = True) -> DataFrame:
    """A row per entity, with all that survived; proof: without it, only the values and `records`, which need no provenance."""
    single, claims, owned, winners, lists = done.single, done.claims, done.owned, done.winners, done.lists
    merged = done.keep("merged") if proof else done.merged
    lost = survivorship.rejected_links(single.filter(F.col("field").isin("linkedin", "github", "portfolio")), ["entity", "field"])
    order = F.array_sort(F.collect_list(F.struct("first_seq", "value")))
    wide = winners.groupBy("entity").pivot("field", SCALARS).agg(F.first("value"))
    flat = lists.groupBy("entity").pivot("field", LISTS).agg(order.getField("value"))
    more = lost.groupBy("entity").agg(F.sort_array(F.collect_set("value")).alias("lost"))
    skills = G.skill_rollup(claims.filter("field = 'skills'"), "entity").groupBy("entity").agg(F.sort_array(F.collect_list(F.struct(F.col("skill").alias("name"), "confidence", "sources"))).alias("skill_items"))
    entities = owned.groupBy("entity").agg(
        F.max("priority").alias("max_priority"), F.min("seq").alias("first_seq"), F.count("*").alias("records"), F.max_by(F.struct("match_type", "match_status", "matched_seq", "matched_name"), F.col("match_type") == "fuzzy").alias("match"), F.min("match_score").alias("match_score")
    ).select("*", "match.match_type", "match.match_status", "match.matched_seq", "match.matched_name").drop("match")
    listed = lambda kind: merged[kind].groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("pos", *[c for c in merged[kind].columns if c not in ("entity", "pos", "proof")]))).alias(kind))
    if not proof:
        whole = entities
        for part in (wide, flat, skills, listed("experience"), listed("education")):
            whole = whole.join(part, "entity", "left")
        return whole.select("entity", "records", "full_name", "headline", F.col("years_experience").try_cast("double").alias("years_experience"), "linkedin", "github", "portfolio", F.array("city", "region", "country").alias("location"), "emails", "phones", F.col("skill_items").alias("skills"), "experience", "education")
    provenance = done.keep("provenance")
    counted = G.overall_confidence(provenance, "entity")
    proof = G.distinct_provenance(provenance.select("entity", "field", "source", "method", "decision_reason", "confidence", "seq"))
    log = proof.groupBy("entity").agg(F.sort_array(F.collect_list(F.struct("field", "source", "method", "decision_reason", "confidence"))).alias("provenance"))
    whole = entities
    for part in (wide, flat, more, skills, listed("experience"), listed("education"), counted, log):
        whole = whole.join(part, "entity", "left")
    empty = F.array().cast("array<string>")
    other = F.array_distinct(F.concat(F.coalesce("other_links", empty), F.coalesce("lost", empty)))
    years = F.col("years_experience").try_cast("double")
    notes = G.warnings(F.col("experience"), years, F.col("education"), F.col("emails"), F.col("phones"), F.col("match_type"), F.col("match_score"))
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    score = G.data_quality(
        F.coalesce("full_name", F.lit(X.UNKNOWN_NAME)), some("emails"), some("phones"),
        F.coalesce("linkedin", "github", "portfolio").isNotNull() | (F.size("other") > 0), F.coalesce("city", "region", "country").isNotNull(), some("experience"), some("education"), F.size("validation_warnings"),
    )
    return whole.withColumn("other", other).withColumn("validation_warnings", notes).select(
        F.sha2(F.col("entity").cast("string"), 256).alias("candidate_id"), "entity", "max_priority", "first_seq", "records", "match_type", "match_status", "match_score", "matched_seq", "matched_name",
        F.coalesce("full_name", F.lit(X.UNKNOWN_NAME)).alias("full_name"), F.coalesce("emails", empty).alias("emails"), F.coalesce("phones", empty).alias("phones"),
        F.array("city", "region", "country").alias("location"), F.struct("linkedin", "github", "portfolio", "other").alias("links"), "headline", years.alias("years_experience"),
        F.col("skill_items").alias("skills"), "experience", "education", "provenance", F.coalesce("overall_confidence", F.lit(1.0)).alias("overall_confidence"), "validation_warnings", score.alias("data_quality_score"),
    )


def latest_company() -> Column:
    """The company of a record's first job, as its source lists them."""
    return F.get("experience", F.lit(0)).getField("company")


def explanations(done: Run) -> DataFrame:
    """Why each scalar, address, phone, skill and job has its value: see analytics.decision_explanations().

    A job is told by its summary, or its title where it has none.
    """
    rows = done.keep("provenance")
    job = rows.filter(F.col("field").isin("experience.summary", "experience.title"))
    told = job.groupBy("entity", "seq").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("entity", "seq")]), F.col("field") == "experience.summary").alias("r")).select("entity", "seq", "r.*")
    return A.decision_explanations(rows.filter(~F.col("field").contains(".")).unionByName(told.withColumn("field", F.lit("experience")).select(*rows.columns)))


def quality(done: Run) -> DataFrame:
    """Scores, missing, repeated and conflicting fields, the breakdown and suggestions of each golden record."""
    g = done.golden
    some = lambda c: F.coalesce(F.size(c) > 0, F.lit(False))
    given = lambda c: F.coalesce(F.length(c) > 0, F.lit(False))
    present = {
        "Full Name": F.col("full_name") != X.UNKNOWN_NAME, "Email": some("emails"), "Phone": some("phones"), "Location": F.exists("location", lambda x: F.coalesce(F.length(x) > 0, F.lit(False))), "Headline / Summary": given("headline"), "Years Experience": F.col("years_experience").isNotNull(),
        "Skills": some("skills"), "Work Experience": some("experience"), "Education": some("education"), "LinkedIn": given("links.linkedin"), "GitHub": given("links.github"), "Portfolio": given("links.portfolio"),
    }
    twice = F.concat(A.repeated_values(F.col("emails"), "email"), A.repeated_values(F.col("phones"), "phone"))
    torn = A.conflicting_fields(F.coalesce("provenance", F.array()))
    sure = F.concat(F.coalesce(F.transform("skills", lambda s: s["confidence"]), F.array().cast("array<double>")), F.array_compact(F.array("match_score")))
    mean = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda a, x: a + x) / F.size(sure))
    scores = A.quality(present, F.size(twice), F.size(torn), F.size("validation_warnings"), mean, F.col("overall_confidence"))
    best = F.array_max(F.transform("skills", lambda s: s["confidence"]))
    return g.select("entity", *(v.alias(k) for k, v in scores.items()), A.field_breakdown(present, {"Skills": best}).alias("field_breakdown"), twice.alias("duplicate_fields"), torn.alias("conflicting_fields"))


def stats(done: Run) -> DataFrame:
    """One row of counters: sources and records, fields of golden records, conflicts, duplicates, rules, rejected sources."""
    n = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    scalars = ["full_name", "headline", "years_experience", "linkedin", "github", "portfolio"]
    known = lambda c: F.when((F.col(c).isNotNull()) & (F.col(c).cast("string") != X.UNKNOWN_NAME), 1).otherwise(0)
    fields = sum((known(c) for c in scalars), n(F.array_compact("location")) + n("emails") + n("phones") + n("skills") + n("experience") + n("education"))
    g = _golden(done, proof=False).agg(F.coalesce(F.sum(fields), F.lit(0)).cast("bigint").alias("fields_merged"), (F.coalesce(F.sum("records"), F.lit(0)) - F.count("*")).alias("duplicates_removed"))
    r = done.records.agg(F.countDistinct("source").alias("files_processed"), F.count("*").alias("records_parsed"))
    c = done.conflicts.agg(F.count("*").alias("conflicts_detected"))
    x = done.rejected.agg(F.count("*").alias("sources_rejected"))
    return r.join(g).join(c).join(x).select("files_processed", "records_parsed", F.col("fields_merged").alias("fields_compared"), "fields_merged", "conflicts_detected", "duplicates_removed", F.lit(X.VALIDATION_RULES).alias("validation_rules_executed"), "sources_rejected")


def timeline(done: Run) -> DataFrame:
    """stage, status, duration_ms, detail: the stages that wrote tables, and the rejected sources as stages in error."""
    spark = done.golden.sparkSession
    ran = spark.createDataFrame(done.timeline, TIMELINE)
    return ran.unionByName(done.rejected.select(F.concat(F.lit("Parse: "), F.col("source")).alias("stage"), F.lit("error").alias("status"), F.lit(None).cast("double").alias("duration_ms"), F.col("error").alias("detail")))


def selected(golden: DataFrame) -> DataFrame:
    """The one golden record with the highest source priority; ties go to the one seen first."""
    return golden.orderBy(F.desc("max_priority"), "first_seq").limit(1)


def projected(done: Run, config: dict, country: str = "IN") -> DataFrame:
    return project(done.golden, config, country)
