"""Jobs and studies of an entity, matched greedily and merged field by field.

The match depends on order: each record's items are compared with the list as it has grown, the first that is the same
is merged, otherwise the item is appended.  That isn't associative, so it runs per entity (few items each) in Python, over
sorted rows as they stream by: a group or a pandas table of its own would cost an entity more than its items do.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from goldweave.functions import fixed as X
from goldweave.operators.rows import runs, told_as

if TYPE_CHECKING:  # workers, of which each imports this module, need none of it
    import pandas as pd

JOB_FIELDS = ["company", "title", "start", "end", "summary"]
STUDY_FIELDS = ["institution", "degree", "field", "end_year"]


def _plain(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit(""))


def _within(a: Column, b: Column) -> Column:
    return F.contains(a, b) | F.contains(b, a)


def same_experience(company_a: Column, title_a: Column, company_b: Column, title_b: Column) -> Column:
    """Companies and titles contain each other, but for blanks and case; without a title, companies are equal."""
    c, d, t, u = map(_plain, (company_a, company_b, title_a, title_b))
    return F.coalesce(F.when(t.isNull() | u.isNull(), c == d).otherwise(_within(c, d) & _within(t, u)), F.lit(False))


def same_education(place_a: Column, degree_a: Column, place_b: Column, degree_b: Column) -> Column:
    """Institutions contain each other, and degrees do or one is missing."""
    e, f = (F.coalesce(_plain(d), F.lit("")) for d in (degree_a, degree_b))
    return F.coalesce(_within(_plain(place_a), _plain(place_b)), F.lit(False)) & ((e == "") | (f == "") | _within(e, f))


def _text(v) -> str | None:
    return None if v is None or v != v else str(v).lower().replace(" ", "")


def _alike(a: str, b: str) -> bool:
    return a in b or b in a


def is_same(kind: str, a: dict, b: dict) -> bool:
    if kind == "experience":
        c, d, t, u = (_text(v) for v in (a["company"], b["company"], a["title"], b["title"]))
        return c is not None and d is not None and (c == d if t is None or u is None else _alike(c, d) and _alike(t, u))
    p, q, e, f = (_text(v) for v in (a["institution"], b["institution"], a["degree"], b["degree"]))
    return p is not None and q is not None and _alike(p, q) and (not e or not f or _alike(e, f))


PROOF = "array<struct<field:string,source:string,method:string,confidence:double,decision_reason:string>>"
CONFLICTS = "entity {0}, field string, seq bigint, source_a string, value_a string, confidence_a double, priority_a int, source_b string, value_b string, confidence_b double, priority_b int, winner_source string, winning_value string, rejected_value string, decision_rule string"


def _value_key(v) -> str:
    return re.sub(r"[\s\-/]+", "", str(v).strip().lower())


def _preview(v, most: int = 120) -> str:
    text = str(v)
    return text if len(text) <= most else text[:most] + "..."


def _step(old: dict, new: dict) -> tuple[bool, str, str]:
    """(the new claim wins, the rule, the reason in words)."""
    win = (new["priority"], new["confidence"], new["ts"]) > (old["priority"], old["confidence"], old["ts"])
    first, second = (new, old) if win else (old, new)
    if new["priority"] != old["priority"]:
        return win, "source_priority", X.REASONS["source_priority"].format(first["source"], first["priority"], second["source"], second["priority"])
    if new["confidence"] != old["confidence"]:
        return win, "confidence", X.REASONS["confidence"].format(first["confidence"], second["confidence"])
    return win, "recency", X.REASONS["newer" if win else "older"]


def fold_items(items: pd.DataFrame, kind: str) -> tuple[list[dict], list[tuple]]:
    """See fold_rows()."""
    return fold_rows(items.sort_values(["seq", "pos"]).to_dict("records"), kind)


def fold_rows(rows: list[dict], kind: str) -> tuple[list[dict], list[tuple]]:
    """(merged items in order, conflicts) of one entity's items, by seq and pos, with source, method, priority, confidence, ts and the fields.

    Each field survives on its own: the claim with the higher (priority, confidence, ts), the earlier on a tie.  Of a merged item, a
    field that one side lacks has the reason of a single source; items that never met another keep theirs null.
    """
    fields = JOB_FIELDS if kind == "experience" else STUDY_FIELDS
    grown: list[dict] = []
    told: list[tuple] = []
    first = rows[0]["seq"]
    for r in rows:
        own = {"source": r["source"], "method": r.get("method"), "priority": r["priority"], "confidence": r["confidence"], "ts": r["ts"], "reason": None}
        best = {f: own for f in fields if r[f] is not None and r[f] == r[f]}
        item = {f: r[f] if f in best else None for f in fields}
        # the first record's items stand as they are; later ones are compared with all that is there
        at = None if r["seq"] == first else next((g for g in grown if is_same(kind, g["item"], item)), None)
        if at is None:
            grown.append({"item": item, "best": best, "sources": [r["source"]]})
            continue
        for f in fields:
            if f not in best or f not in at["best"]:
                if f in best or f in at["best"]:
                    at["best"][f] = (best.get(f) or at["best"][f]) | {"reason": X.REASONS["single"]}
                    at["item"][f] = item[f] if f in best else at["item"][f]
                continue
            old, new, before = at["best"][f], best[f], at["item"][f]
            win, rule, words = _step(old, new)
            if _value_key(before) != _value_key(item[f]):
                a, b = _preview(before), _preview(item[f])
                told.append((r["entity"], kind, r["seq"], old["source"], a, old["confidence"], old["priority"], new["source"], b, new["confidence"], new["priority"], (new if win else old)["source"], b if win else a, a if win else b, rule))
            at["best"][f] = (new if win else old) | {"reason": words}
            at["item"][f] = item[f] if win else before
        at["sources"] = list(dict.fromkeys([*at["sources"], r["source"]]))
    return grown, told


_PROOF = ["field", "source", "method", "confidence", "decision_reason"]


def _merged(rows: list[dict], kind: str) -> list[dict]:
    grown, _ = fold_rows(rows, kind)
    proof = lambda g: [(f, b["source"], b["method"], b["confidence"], b["reason"]) for f, b in g["best"].items()]
    return [{"entity": rows[0]["entity"], "pos": i, **g["item"], "sources": g["sources"], "proof": proof(g)} for i, g in enumerate(grown)]


def merge_items(items: pd.DataFrame, kind: str) -> pd.DataFrame:
    """One entity's merged items: see fold_rows()."""
    import pandas as pd

    return pd.DataFrame(_merged(items.sort_values(["seq", "pos"]).to_dict("records"), kind))


def _columns(items: DataFrame, kind: str) -> list:
    method = F.col("method") if "method" in items.columns else F.lit(None).cast("string").alias("method")
    return ["entity", "seq", "pos", "source", method, "priority", "confidence", "ts", *(JOB_FIELDS if kind == "experience" else STUDY_FIELDS)]


def _folded(items: DataFrame, kind: str, schema: str, tell: Callable[[list[dict]], list[dict]]) -> DataFrame:
    """What `tell` makes of each entity's items, dealt by entity over all shuffle partitions: they cost Python time, not bytes, by which tasks would be merged."""
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = items.select(*_columns(items, kind)).repartition(tasks, "entity").sortWithinPartitions("entity", "seq", "pos")
    shape = told_as(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shape.batches(r for rows in runs(batches, "entity") for r in tell(rows))

    return dealt.mapInArrow(run, schema)


def collections(items: DataFrame, kind: str) -> DataFrame:
    """items(entity, seq, pos, source, method, priority, confidence, ts, fields) -> entity, pos, fields, sources, proof (a row per field)."""
    fields = JOB_FIELDS if kind == "experience" else STUDY_FIELDS
    schema = f"entity {items.schema['entity'].dataType.simpleString()}, pos int, " + "".join(f"`{f}` {items.schema[f].dataType.simpleString()}, " for f in fields) + f"sources array<string>, proof {PROOF}"

    def tell(rows: list[dict]) -> list[dict]:
        return [r | {"proof": [dict(zip(_PROOF, p)) for p in r["proof"]]} for r in _merged(rows, kind)]

    return _folded(items, kind, schema, tell)


def conflicts(items: DataFrame, kind: str) -> DataFrame:
    """A row per field of a matched item on which both sides had different values; the columns of survivorship.conflicts()."""
    schema = CONFLICTS.format(items.schema["entity"].dataType.simpleString())
    names = [c.split()[0] for c in CONFLICTS.split(", ")]
    return _folded(items, kind, schema, lambda rows: [dict(zip(names, t)) for t in fold_rows(rows, kind)[1]])
