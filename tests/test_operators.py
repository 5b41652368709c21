import itertools
import random
from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F

import plain
from goldweave.functions import similarity
from goldweave.operators import identity, items, survivorship
from goldweave.operators.analytics import decision_rule, explanation
from goldweave.operators.graph import connected_components

T0 = datetime(2024, 1, 1)
CLAIMS = "entity string, value string, source string, priority int, confidence double, ts timestamp, seq bigint"


def batch(rng, n):
    return [(f"e{rng.randrange(6)}", rng.choice(["x", "y", "z", None]), rng.choice("ab"), rng.choice([10, 20]), rng.choice([0.5, 1.0]), T0 + timedelta(days=rng.randrange(3)), i) for i in range(n)]


def fold(rows):
    """The claim that survives when records are merged one by one, and the steps on the way."""
    best, told = None, []
    for r in sorted(rows, key=lambda r: r[6]):
        if best is not None:
            win = r[3:6] > best[3:6]
            kind = "source_priority" if r[3] != best[3] else "confidence" if r[4] != best[4] else "recency"
            told.append((r[6], (best[1] or "") != (r[1] or ""), kind, (r if win else best)[2]))
        if best is None or r[3:6] > best[3:6]:
            best = r
    return best, told


@pytest.mark.parametrize("seed", range(4))
def test_winner_and_conflicts_equal_the_fold(spark, seed):
    rows = batch(random.Random(seed), 60)
    random.Random(seed).shuffle(rows)
    df = spark.createDataFrame(rows, CLAIMS)
    won = {r.entity: (r.value, r.source) for r in survivorship.winners(df, "entity", carry=["source"]).collect()}
    told = {(r.seq, r.decision_rule, r.winner_source) for r in survivorship.conflicts(df, ["entity"]).collect()}
    want = {e: fold([r for r in rows if r[0] == e]) for e in {r[0] for r in rows}}
    assert won == {e: (b[1], b[2]) for e, (b, _) in want.items()}
    assert told == {(s, k, w) for _, steps in want.values() for s, differ, k, w in steps if differ}


def test_null_value_can_win_and_reasons(spark):
    rows = [("e", "2020-01", "a", 10, 1.0, T0, 0), ("e", None, "b", 20, 1.0, T0, 1), ("f", "v", "a", 10, 1.0, T0, 2), ("g", "v", "a", 10, 0.5, T0, 3), ("g", "w", "a", 10, 1.0, T0, 4)]
    df = spark.createDataFrame(rows, CLAIMS)
    assert {r.entity: r.value for r in survivorship.winners(df, "entity").collect()}["e"] is None
    why = {r.entity: r.decision_reason for r in survivorship.decision_reasons(df, "entity").collect()}
    assert why == {"e": "Source priority (b: 20) > (a: 10)", "f": None, "g": "Confidence (1.0) > (0.5)"}


def test_lists_keep_values_with_their_reason(spark):
    rows = [("e", "x", "a", 10, 1.0, T0, 0), ("e", "y", "b", 10, 1.0, T0, 1), ("e", "x", "b", 20, 1.0, T0, 1), ("e", None, "b", 20, 1.0, T0, 1)]
    got = {r.value: (r.source, r.list_reason) for r in survivorship.list_union(spark.createDataFrame(rows, CLAIMS), "entity", carry=["source"]).collect()}
    assert got["x"][0] == "b" and got["y"] == ("b", "Single source populated") and set(got) == {"x", "y"}


def test_priorities(spark):
    df = spark.createDataFrame([("resume.pdf",), ("other.PDF",), ("noext",), (None,)], "source string")
    got = [r.priority for r in survivorship.with_priority(df, priorities={"resume.pdf": 40, "a.pdf": 50}, templates=True).collect()]
    assert got == [40, 40, 10, 10]


@pytest.mark.parametrize("seed", range(3))
def test_components_by_brute_force(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(40)] + [(200, 300 + i) for i in range(50)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    for most in (1 << 20, 9):
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), most=most).collect()}
        assert got == {x: find(x) for x in root}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def model(records):
    """The greedy rule over all records at once."""
    known, leaders, out = {}, [], {}
    for seq, name, company, keys in records:
        entity = next((known[k] for k in keys if k in known), None)
        if entity is None:
            for s, ks, _, _ in leaders:
                if set(keys) & set(ks):
                    entity = s
                    known.update(dict.fromkeys(ks, s))
                    break
        if entity is None:
            for s, _, n, c in leaders:
                score = plain.score(name, n, company, c)
                if score >= 0.65:
                    entity = s
                    break
        if entity is None:
            entity = seq
            leaders.append((seq, keys, name, company))
        known.update(dict.fromkeys(keys, entity))
        out[seq] = entity
    return out


@pytest.mark.parametrize("seed", range(3))
def test_identity_equals_the_greedy_rule(spark, seed):
    rng = random.Random(seed)
    names = ["anna berg", "ana berg", "otto brandt", "ot brand", "li wu", ""]
    rows = [(i, rng.choice(names), rng.choice(["", "fern", "fern ltd"]), [f"m{rng.randrange(14)}@x.org" for _ in range(rng.randrange(3))], []) for i in range(25)]
    df = spark.createDataFrame(rows, "seq bigint, name string, company string, emails array<string>, phones array<string>")
    got = {r.seq: r.entity for r in identity.resolve(df).collect()}
    assert got == model([(i, n, c, [f"email:{m}" for m in ms]) for i, n, c, ms, _ in rows])


def test_no_similar_pair_is_lost(spark):
    """All pairs of names and companies by the plain score, short names and missing companies too."""
    rng = random.Random(9)
    word = lambda n: "".join(rng.choice("abcd") for _ in range(n))
    names = sorted({word(rng.randrange(1, 12)) for _ in range(120)})
    rows = [(i, rng.choice(names), rng.choice(["", "fern", "fern ltd", "oak", "acorn", "zz"])) for i in range(160)]
    df = spark.createDataFrame(rows, "seq bigint, name string, company string")
    heads = {}
    for i, n, c in rows:
        heads.setdefault((n, c), i)
    want = {}
    for (x, i), (y, j) in itertools.combinations(heads.items(), 2):
        s = plain.score(x[0], y[0], x[1], y[1])
        if s >= 0.65:
            want[min(i, j), max(i, j)] = s
    got = identity.fuzzy_pairs(df).collect()
    assert {(r.a, r.b): pytest.approx(r.score) for r in got} == want and len(got) == len(want) > 300


def test_jaro_winkler_of_many_pairs():
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdeé日🙂") for _ in range(rng.randrange(1, 14)))
    pairs = [(word(), word()) for _ in range(3000)]
    got = similarity.jaro_winkler_many([a for a, _ in pairs], [b for _, b in pairs])
    assert all(abs(g - similarity.jaro_winkler_of(*p)) < 1e-12 for g, p in zip(got, pairs))


def test_one_component_of_most_records(spark):
    """A hot chain and a hot star, over several tasks."""
    edges = [(i, i + 1) for i in range(0, 3000)] + [(10_000, 20_000 + i) for i in range(3000)]
    random.Random(3).shuffle(edges)
    df = spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)
    for most in (1 << 20, 1000, 50):  # one task, several, and several that each hold only a part of their edges
        got = {r.node: r.component for r in connected_components(df, most=most).collect()}
        assert got == {i: 0 for i in range(3001)} | {10_000: 10_000} | {20_000 + i: 10_000 for i in range(3000)}, most


def test_items_are_merged_greedily():
    rows = [("e", 0, 0, "a", 10, 1.0, T0, "Blue Fern", "Engineer", "2020-01", None, None), ("e", 0, 1, "a", 10, 1.0, T0, "Blue Fern", "Engineer", None, None, None), ("e", 1, 0, "b", 20, 0.6, T0, "blue fern ltd", "Senior Engineer", None, "2021-01", "s"), ("e", 1, 1, "b", 20, 0.6, T0, "Oak", "Clerk", None, None, None)]
    d = pd.DataFrame(rows, columns=["entity", "seq", "pos", "source", "priority", "confidence", "ts", *items.JOB_FIELDS])
    got = items.merge_items(d, "experience")
    assert got["company"].tolist() == ["blue fern ltd", "Blue Fern", "Oak"]
    _, told = items.fold_items(d, "experience")
    assert [(t[4], t[8], t[11], t[14]) for t in told] == [("Blue Fern", "blue fern ltd", "b", "source_priority"), ("Engineer", "Senior Engineer", "b", "source_priority")]
    proof = {p[0]: p[4] for p in got["proof"].tolist()[0]}
    assert proof == {"company": "Source priority (b: 20) > (a: 10)", "title": "Source priority (b: 20) > (a: 10)", "start": "Single source populated", "end": "Single source populated", "summary": "Single source populated"}
    assert got["start"].tolist()[0] == "2020-01" and got["end"].tolist()[0] == "2021-01" and got["sources"].tolist()[0] == ["a", "b"]


def test_same_items(spark):
    e = lambda *x: items.same_experience(*map(F.lit, x)).alias("x")
    s = lambda *x: items.same_education(*map(F.lit, x)).alias("x")
    row = spark.range(1).select(e("Blue Fern", "Dev", "bluefern ltd", "Senior Dev"), e("A", "Dev", "B", "Dev"), s("Hill University", None, "hill university x", "MS"), s("Hill", "BS", "Hill", "PhD")).first()
    assert list(row) == [True, False, True, False]


def test_explanations(spark):
    texts = [None, "Single source populated", "Source priority (a: 2) > (b: 1)", "Confidence (1) > (0)", "Recency tie-breaker (current newer)", "other"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(decision_rule(F.col("t")).alias("r"), explanation(F.col("t")).alias("e"))
    got = df.collect()
    assert [g.r for g in got] == ["single_source", "single_source", "source_priority", "confidence", "recency", "auto"]
    assert [len(g.e) for g in got] == [1, 1, 2, 2, 2, 1]


def test_entities_over_many_batches(spark):
    """Whole years stay whole beside missing ones, and an entity's items may be more than a batch of rows; ids beyond doubles."""
    big = 2**53 + 1
    item = lambda e, seq, school, year: (e, seq, 0, "a", "m", 10, 1.0, seq, school, "MS", None, year)
    rows = [item(big, 0, "Hill", 2015), item(big, 1, "Hill", 2016), item(big + 1, 2, "Hill", None), item(big + 1, 3, "Oak", None)] + [item(5, i, "TU", 1990 + i % 2) for i in range(12_000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "entity bigint, seq bigint, pos int, source string, method string, priority int, confidence double, ts bigint, institution string, degree string, field string, end_year int")
    told = items.conflicts(df, "education").collect()
    assert [(r.value_a, r.value_b, r.winning_value) for r in told if r.entity == big] == [("2015", "2016", "2016")]
    assert sum(r.entity == 5 for r in told) == 11_999 and {r.entity for r in told} == {5, big}
    merged = {(r.entity, r.pos): (r.institution, r.end_year) for r in items.collections(df, "education").collect()}
    assert merged == {(big, 0): ("Hill", 2016), (big + 1, 0): ("Hill", None), (big + 1, 1): ("Oak", None), (5, 0): ("TU", 1991)}


def test_no_group_of_its_own_per_entity(spark):
    """Jobs and components are streamed through a task; a pandas group costs an entity a millisecond or more."""
    df = spark.createDataFrame([("e", 0, 0, "a", "m", 10, 1.0, 0, "Hill", "MS", None, 2015)], "entity string, seq bigint, pos int, source string, method string, priority int, confidence double, ts bigint, institution string, degree string, field string, end_year int")
    people = spark.createDataFrame([(0, "a b", "c", ["x@y.z"], []), (1, "q r", "c", ["x@y.z"], [])], "seq bigint, name string, company string, emails array<string>, phones array<string>")
    for d in (items.collections(df, "education"), items.conflicts(df, "education"), identity.resolve(people, fuzzy=False)):
        assert "GroupsInPandas" not in d._jdf.queryExecution().optimizedPlan().toString()


def test_stars_are_told_without_contraction(spark, monkeypatch):
    """Edges of shared keys that are stars already, and records that all follow one of their keys, reach no Python worker."""
    monkeypatch.setattr("goldweave.operators.graph._contract", None)
    monkeypatch.setattr("goldweave.operators.identity.greedy", None)
    stars = spark.createDataFrame([(2, 1), (1, 3), (2, 1), (7, 7), (9, 5)], "a bigint, b bigint")
    assert {r.node: r.component for r in connected_components(stars).collect()} == {1: 1, 2: 1, 3: 1, 5: 5, 9: 5}
    people = spark.createDataFrame([(1, "a", None, ["x", "y"], []), (2, "b", None, ["y"], []), (3, "c", None, ["x"], ["1"]), (4, "d", None, [], [])], "seq bigint, name string, company string, emails array<string>, phones array<string>")
    found = identity.resolve(people, fuzzy=False)
    assert {(r.seq, r.entity, r.match_type) for r in found.collect()} == {(1, 1, "new"), (2, 1, "key"), (3, 1, "key"), (4, 4, "new")}
    assert "MapInArrow" not in found._jdf.queryExecution().toString()
