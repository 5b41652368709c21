"""Transcript parsing: a hidden Markov model finds turns and roles in raw lines, then renders them.

States are a role's first line and its further lines.  A line is observed by its speaker marker, whether a blank
line or nothing stands before it, its length and its end.  Start, transition and emission probabilities are
counted over all labelled lines.  Viterbi gives the most probable states, markers are stripped and turns rendered.

Conversations of any length: lines are range-partitioned in order and cut in chunks of `chunk` lines; what the border of a task
hides (blank lines, whether the conversation has begun, the state before) is carried over by a row per task.  A chunk of a long
conversation is summarised by the best log-probability from each state before it to each of its end (a max-plus product); chains of
these small matrices fix each chunk's states before and at its end, and chunks are then decoded on their own, many at a
time.  That is exactly Viterbi over the whole conversation, up to ties (which go to the first state).

Blank lines separate; those within a turn are kept, those at its ends dropped.  Null lines are blank; a null id is an id
of its own; repeated rows are repeated lines; a transcript of blank lines only has no turns.  Extra columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from goldweave.llm.base import id_again, whole_id
from goldweave.plans.staging import staged

ROLES = ["system", "user", "assistant"]
CHUNK, MOST_SENT = 4096, 100_000
#: Names that speakers of each role go by.
NAMES = {"system": "system|sys|context|setup", "user": "user|human|customer|client|question|q|prompt|instruction|you|me", "assistant": "assistant|ai|bot|model|agent|answer|a|response|reply|support"}
_MARKER = re.compile(r"^\s*[#>*\[(<|\-]*\s*(?:" + "|".join(f"(?P<{k}>{v})" for k, v in NAMES.items()) + r")\s*[\])>|*]*\s*[:>\-]+[*]*\s*", re.I)
_SPEAKER = re.compile(r"^[^\W\d_][\w.-]*(?: [\w.-]+){0,2}:\s")
S = 2 * len(ROLES)  # first lines are the even states
#: Features and their numbers of values: marker (0 none, 1 a name, then the roles), after a gap, bits of the length, a question.
FEATURES = ["marker", "gap", "size", "asks"]
SIZES = [2 + len(ROLES), 2, 14, 2]


@dataclass
class Model:
    start: np.ndarray
    move: np.ndarray
    emit: list[np.ndarray]  # per feature: (states, values)


def observe(line: str) -> tuple[int, int]:
    """(marker, its length): 0 none, 1 a name that isn't stripped, then the roles."""
    m = _MARKER.match(line)
    return (2 + ROLES.index(m.lastgroup), m.end()) if m else (int(bool(_SPEAKER.match(line))), 0)


def emissions(model: Model, x: np.ndarray) -> np.ndarray:
    return sum(e[:, x[:, f]].T for f, e in enumerate(model.emit))


def summary(model: Model, x: np.ndarray, opens: bool) -> np.ndarray:
    """(S, S): best log-probability of a chunk from each state before it (all alike if it opens the conversation) to each last state."""
    e = emissions(model, x)
    m = np.broadcast_to(model.start, (S, S)) + e[0] if opens else model.move + e[0]
    for r in e[1:]:
        m = (m[:, :, None] + model.move[None]).max(axis=1) + r
    return m


def viterbi(model: Model, x: np.ndarray, starts: np.ndarray, enters: np.ndarray, leaves: np.ndarray) -> np.ndarray:
    """The best states of many chunks: x (lines, features) of all, starts (n + 1) of each, the state before it (-1: it opens) and at its end (-1: any).

    All chunks take a step together, so the cost of a step is shared; the longest go first and the shorter ones drop out.
    """
    n = np.diff(starts)
    order = np.argsort(-n, kind="stable")
    s, n, enters, leaves = starts[:-1][order], n[order], enters[order], leaves[order]
    e = emissions(model, x)
    v = np.where((enters < 0)[:, None], model.start, model.move[enters]) + e[s]
    back, path = np.zeros((len(x), S), np.int8), np.empty(len(x), np.int64)
    longest = int(n[0]) if len(n) else 0
    live = np.searchsorted(-n, -np.arange(longest), "left")  # chunks with more than t lines
    for t in range(1, longest):
        m = live[t]
        step = v[:m, :, None] + model.move[None]
        back[s[:m] + t] = step.argmax(axis=1)
        v[:m] = step.max(axis=1) + e[s[:m] + t]
    path[s + n - 1] = np.where(leaves < 0, v.argmax(axis=1), leaves)
    for t in range(longest - 1, 0, -1):
        at = s[: live[t]] + t
        path[at - 1] = back[at, path[at]]
    return path


def chain(matrices: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """States before (-1: none) and at the end of each chunk of one conversation, in order."""
    best, back = matrices[0][0], []
    for m in matrices[1:]:
        s = best[:, None] + m
        back.append(s.argmax(axis=0))
        best = s.max(axis=0)
    ends = [int(best.argmax())]
    for b in reversed(back):
        ends.append(int(b[ends[-1]]))
    ends.reverse()
    return [-1, *ends[:-1]], ends


class _Cutter:
    """Numbers the lines of one task: chunks, blank lines before each, the state before.  Only the last line is remembered."""

    def __init__(self, part: int, chunk: int):
        self.part, self.chunk, self.count = part, chunk, part << 40
        self.first: tuple | None = None
        self.now: tuple | None = None
        self.blanks = self.had = 0
        self.state, self.single = -1, True

    def cut(self, b: pd.DataFrame) -> pd.DataFrame:
        ids, none, lines, state = b["id"].to_numpy(np.int64), b["no_id"].to_numpy(bool), b["line"].tolist(), b["state"].to_numpy(np.int64)
        begins = np.ones(len(b), bool)
        begins[1:] = (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])
        head = (int(ids[0]), bool(none[0]))
        begins[0] = head != self.now
        self.first = self.first or head
        if self.now is not None and begins[0]:
            self.single = False
        own = np.cumsum(begins)  # conversations of the batch; 0 goes on from the batch before
        text = np.flatnonzero([not (t is None or not t.strip()) for t in lines])
        conv_start = np.flatnonzero(begins)
        start = np.where(own > 0, conv_start[np.maximum(own - 1, 0)] if len(conv_start) else 0, 0)[text]
        of = own[text]
        fresh = np.ones(len(text), bool)  # the first text line of its conversation here
        fresh[1:] = of[1:] != of[:-1]
        before = np.where(fresh, start - 1, np.append(-1, text[:-1]) if len(text) else 0)
        blanks = text - before - 1
        place = np.arange(len(text)) - np.maximum.accumulate(np.where(fresh, np.arange(len(text)), 0))
        prev = np.where(fresh, -1, np.append(-1, state[text[:-1]]) if len(text) else 0)
        opens = fresh.copy()
        on = of == 0  # lines of the conversation that the batch before ended in
        if on.any():
            blanks[0] += self.blanks
            place[on] += self.had
            if self.had:
                opens[0], prev[0] = False, self.state
        chunk_begins = place % self.chunk == 0
        chunks = self.count + np.cumsum(chunk_begins)
        in_first = own[text] == (0 if not begins[0] else 1) if self.single else np.zeros(len(text), bool)
        out = pd.DataFrame({"id": ids[text], "no_id": none[text], "chunk": chunks, "nr": place % self.chunk, "blanks": blanks, "opens": opens, "lead": opens & in_first, "prev": prev, "state": state[text], "line": [lines[i] for i in text]})
        seen = [observe(t) for t in out["line"]]
        out["marker"], out["cut"] = [m for m, _ in seen], [z for _, z in seen]
        out["size"] = [min(len(t).bit_length(), SIZES[2] - 1) for t in out["line"]]
        out["asks"] = [int(t.rstrip().endswith("?")) for t in out["line"]]
        out["border"] = None
        # what the next batch must know
        self.count += int(chunk_begins.sum())
        self.single &= own[-1] <= int(begins[0])
        last = text[of == own[-1]]
        kept = self.had if own[-1] == 0 else 0
        begun = int(conv_start[-1]) if len(conv_start) else 0
        self.blanks = len(b) - 1 - int(last[-1]) if len(last) else len(b) - begun + (self.blanks if own[-1] == 0 else 0)
        self.state = int(state[last[-1]]) if len(last) else self.state if own[-1] == 0 else -1
        self.had = kept + len(last)
        self.now = (int(ids[-1]), bool(none[-1]))
        return out

    def border(self) -> pd.DataFrame:
        """A row about the task: its part; first and last conversation; blank lines, text and state at its end; whether there is one conversation only."""
        about = [self.part, *map(int, self.first), *map(int, self.now), self.blanks, int(self.had > 0), self.state, int(self.single)]
        return pd.DataFrame({c: [v] for c, v in zip(_LINES, [0, False, 0, -1, 0, False, False, -1, -1, None, 0, 0, 0, 0, about])})


LINES = "id bigint, no_id boolean, chunk bigint, nr int, blanks int, opens boolean, lead boolean, prev int, state int, line string, marker int, cut int, size int, asks int, border array<bigint>"
_LINES = [c.split()[0] for c in LINES.split(", ")]


def carried(borders: list[list[int]]) -> list[tuple[int, int, bool, int]]:
    """(part, blank lines, whether text, state) that stand before the first line of each task whose conversation began earlier."""
    out, conv, blanks, had, state = [], None, 0, False, -1
    for part, f, f_none, z, z_none, b, text, last, single in sorted(borders):
        goes_on = conv == (f, f_none)
        if goes_on:
            out.append((part, blanks, had, state))
        if goes_on and single:
            blanks, state = (b if text else blanks + b), (last if text else state)
            had = had or bool(text)
        else:
            blanks, had, state = b, bool(text), last
        conv = (z, z_none)
    return out


def read_lines(df: DataFrame, conv: str, order: list[str], line: str, state: Column | None = None, chunk: int = CHUNK) -> DataFrame:
    """The lines that aren't blank, with their features, ordered by `order` within `conv` and written to the shared folder.

    state: 2 * role + (0 for the first line of a turn, else 1) of labelled lines, null for others.  Repeated rows of one order are
    taken as they come.
    """
    spark = df.sparkSession
    names = [f"__o{i}" for i in range(len(order))]
    known = F.coalesce(state.cast("int"), F.lit(-1)) if state is not None else F.lit(-1)
    rows = df.select(*whole_id(conv), *(F.col(o).alias(n) for o, n in zip(order, names)), F.coalesce(F.col(line), F.lit("")).alias("line"), known.alias("state"), F.monotonically_increasing_id().alias("__nr"))
    sort = ["no_id", "id", *names, "__nr"]  # __nr parts equal rows, of which one conversation may have very many
    ordered = rows.repartitionByRange(*sort).sortWithinPartitions(*sort).select("id", "no_id", "line", "state")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cutter = _Cutter(TaskContext.get().partitionId(), chunk)
        for b in batches:
            if len(b):
                yield cutter.cut(b)
        if cutter.first:
            yield cutter.border()

    made = staged(ordered.mapInPandas(cut, LINES), "lines")
    leads = carried([list(r["border"]) for r in made.filter("border is not null").select("border").collect()])  # a row per task
    before = spark.createDataFrame(leads, "part bigint, more int, had boolean, was int")
    before = F.broadcast(before) if len(leads) <= MOST_SENT else before
    lines = made.filter("border is null").drop("border").join(before, F.col("lead") & (F.shiftright("chunk", 40) == F.col("part")), "left")
    had = F.coalesce("had", F.lit(False))
    lines = lines.withColumns({"blanks": F.col("blanks") + F.coalesce("more", F.lit(0)), "opens": F.col("opens") & ~had, "prev": F.when(had, F.col("was")).otherwise(F.col("prev"))})
    return lines.withColumn("gap", (F.col("opens") | (F.col("blanks") > 0)).cast("int")).drop("part", "more", "had", "was", "lead")


def fit(lines: DataFrame) -> Model:
    """From all labelled lines of read_lines(); add-one smoothing.  Their combinations, which are few, are counted by Spark."""
    start, move, emit = np.ones(S), np.ones((S, S)), [np.ones((S, n)) for n in SIZES]
    for r in lines.filter("state >= 0").groupBy("opens", "prev", "state", *FEATURES).count().collect():
        if r["opens"]:
            start[r["state"]] += r["count"]
        if r["prev"] >= 0:
            move[r["prev"], r["state"]] += r["count"]
        for f, n in zip(FEATURES, emit):
            n[r["state"], r[f]] += r["count"]
    log = lambda n: np.log(n / n.sum(axis=-1, keepdims=True))
    return Model(log(start), log(move), [log(n) for n in emit])


def _whole_chunks(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """(rows, n + 1 starts of their chunks): chunks come one after another and are of bounded size; none is parted."""
    rest: pd.DataFrame | None = None
    for b in batches:
        if not len(b):
            continue
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        c = b["chunk"].to_numpy(np.int64)
        starts = np.append(0, np.flatnonzero(c[1:] != c[:-1]) + 1)
        if len(starts) > 1:
            yield b.iloc[: starts[-1]], starts
        rest = b.iloc[starts[-1] :].reset_index(drop=True)
    if rest is not None:
        yield rest, np.array([0, len(rest)])


def turns(lines: DataFrame, model: Model) -> DataFrame:
    """conv_id, turn (from 0), role, n_lines, text, rendered: the turns of the lines of read_lines()."""
    sent = lines.sparkSession.sparkContext.broadcast(model)
    conv = ["id", "no_id"]
    # only conversations of several chunks need the chain
    long = lines.groupBy(*conv).agg(F.min("chunk").alias("from"), F.max("chunk").alias("to")).filter("from < to").select(*conv)

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d, starts in _whole_chunks(batches):
            x = d[FEATURES].to_numpy(np.int64)
            best = [summary(sent.value, x[s:e], bool(o)).ravel() for s, e, o in zip(starts[:-1], starts[1:], d["opens"].iloc[starts[:-1]])]
            yield d[[*conv, "chunk"]].iloc[starts[:-1]].assign(best=best)

    def chained(d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values("chunk")
        enters, leaves = chain([np.asarray(b).reshape(S, S) for b in d["best"]])
        return pd.DataFrame({"chunk": d["chunk"], "enters": enters, "leaves": leaves})

    by_chunk = lines.select(*conv, "chunk", "nr", "opens", *FEATURES).join(long, conv).repartition("chunk").sortWithinPartitions("chunk", "nr").drop("nr")
    fixed = staged(by_chunk.mapInPandas(summaries, "id bigint, no_id boolean, chunk bigint, best array<double>").groupBy(*conv).applyInPandas(chained, "chunk bigint, enters int, leaves int"), "chains")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d, starts in _whole_chunks(batches):
            enters, leaves = (d[c].to_numpy(np.int64)[starts[:-1]] for c in ("enters", "leaves"))
            path = viterbi(sent.value, d[FEATURES].to_numpy(np.int64), starts, enters, leaves)
            begins = path % 2 == 0
            begins[starts[:-1][enters < 0]] = True
            total = np.cumsum(begins)
            at = total - np.repeat(total[starts[:-1]] - begins[starts[:-1]], np.diff(starts))
            yield d[[*conv, "chunk", "nr", "blanks", "cut", "line"]].assign(many=np.repeat(leaves >= 0, np.diff(starts)), begins=begins, at=at, role=path // 2)

    sides = [F.coalesce(c, F.lit(-1)).alias(c) for c in ("enters", "leaves")]
    joined = lines.join(fixed, "chunk", "left").select(*conv, "chunk", "nr", "blanks", "cut", "line", *FEATURES, *sides).repartition("chunk").sortWithinPartitions("chunk", "nr")
    done = staged(joined.mapInPandas(decode, "id bigint, no_id boolean, chunk bigint, nr int, blanks int, cut int, line string, many boolean, begins boolean, at bigint, role int"), "decoded")
    w = W.partitionBy(*conv).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    offsets = done.filter("many").groupBy(*conv, "chunk").agg(F.count_if("begins").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).select("chunk", "before")
    said = F.when(F.col("begins"), F.substr("line", F.col("cut") + 1)).otherwise(F.col("line"))
    numbered = done.join(offsets, "chunk", "left").select(*conv, (F.col("at") + F.coalesce("before", F.lit(0)) - 1).alias("turn"), "chunk", "nr", "blanks", said.alias("line"), "role")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("chunk", "nr", "line", "blanks"))), lambda s, i: F.concat(F.repeat(F.lit("\n"), F.when(i > 0, s["blanks"] + 1).otherwise(0)), s["line"]))
    role = F.get(F.array(*map(F.lit, ROLES)), F.min_by("role", F.struct("chunk", "nr")))
    out = numbered.groupBy(*conv, "turn").agg(role.alias("role"), F.count("*").alias("n_lines"), F.array_join(parts, "").alias("text"))
    rendered = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    return out.select(id_again().alias("conv_id"), "turn", "role", "n_lines", "text", rendered.alias("rendered"))
