"""Live operators over streams of actions, and their batch twins.

Streams are rows (trace_id, seq, atom); seq numbers a trajectory's actions from first (0)
on without gaps. A file source gives files of one time stamp in any order, so actions
that come early wait in the state until all before them are there, and an action that
comes again is taken once. With first=None numbers may have gaps (times, say): then only
every micro-batch is sorted, and micro-batches must come in order. State per trajectory
is bounded where the operator allows (trailing runs and last atoms for guards) but for
what waits, and a full spine is kept only where an arbitrary pattern needs it.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.sequences import spine
from ..operators.cliffs import CliffDetector
from ..operators.scoring import Spec


Rows = list[tuple[int, str]]


def in_turn(rows: Rows, due: int, held: list[list]) -> tuple[Rows, int, list[list]]:
    """(actions whose turn has come, next number, those that wait), given sorted rows, the number that is due and what has waited so far."""
    if any(s is None or s != s for s, _ in rows):
        raise ValueError("an action without a number")
    waiting = {int(s): a for s, a in held}
    for s, a in rows:
        if s >= due:
            waiting.setdefault(int(s), a)
    ready = []
    while due in waiting:
        ready.append((due, waiting.pop(due)))
        due += 1
    return ready, due, [[s, a] for s, a in sorted(waiting.items(), key=lambda x: x[0])]


def _stateful(stream: DataFrame, step, schema: str, first: int | None) -> DataFrame:
    """One JSON string of state per trajectory; step(state or None, rows in order) gives (state, output rows). A trajectory has few rows a batch, so rows are plain lists: making frames of them costs more than the steps."""
    columns = [x.split()[0] for x in schema.split(", ")]

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        rows = sorted((x for f in frames for x in zip(f["seq"].tolist(), f["atom"].tolist())), key=lambda x: (x[0] != x[0], x[0]))
        kept = json.loads(state.get[0]) if state.exists else {"own": None, "due": first, "held": []}
        if first is not None:
            if any(s < first for s, _ in rows):
                raise ValueError(f"an action numbered under {first}")
            rows, kept["due"], kept["held"] = in_turn(rows, kept["due"], kept["held"])
        kept["own"], out = step(kept["own"], key[0], rows)
        state.update((json.dumps(kept),))
        if out:
            yield pd.DataFrame(out, columns=columns)

    return stream.select("trace_id", "seq", "atom").groupBy("trace_id").applyInPandasWithState(run, schema, "state string", "append", GroupStateTimeout.NoTimeout)


def stream_cliffs(stream: DataFrame, window: int = 5, quantile: float = 0.9, min_scores: int = 5, first: int | None = 0) -> DataFrame:
    """(trace_id, index, jsd, threshold) as cliffs fire."""

    def step(state, trace, rows):
        d = CliffDetector(window, quantile, min_scores)
        if state:
            d.load(state)
        out = [(trace, *c) for _, a in rows if (c := d.append(a)) is not None]
        return d.dump(), out

    return _stateful(stream, step, "trace_id string, index long, jsd double, threshold double", first)


class Guard:
    """Checks actions of one trajectory against a spec: an action that would break a penalty is blocked or steered."""

    def __init__(self, spec: Spec, mode: str = "block", alternatives: tuple[str, ...] = ("run_test", "read_file")):
        if mode not in ("block", "steer", "warn"):
            raise ValueError(f"unknown mode {mode!r}")
        self.spec, self.mode, self.alternatives = spec, mode, alternatives
        self.run, self.last = 0, []
        self.keep = max([0, *[len(q.forbid_sequence) - 1 for q in spec.penalties]])

    def broken_by(self, atom: str) -> list[str]:
        out = []
        for q in self.spec.penalties:
            over = q.max_run is not None and atom == "edit" and self.run + 1 > q.max_run
            seq = list(q.forbid_sequence)
            ends = bool(seq) and atom == seq[-1] and (len(seq) == 1 or self.last[-(len(seq) - 1) :] == seq[:-1])
            if over or ends:
                out.append(q.name)
        return out

    def commit(self, atom: str) -> None:
        self.run = self.run + 1 if atom == "edit" else 0
        self.last = [*self.last, atom][-self.keep :] if self.keep else []

    def step(self, atom: str) -> tuple[str, str, list[str]]:
        """(verdict, atom that is taken or '', rules)."""
        broken = self.broken_by(atom)
        if not broken:
            self.commit(atom)
            return "allow", atom, []
        if self.mode == "warn":
            self.commit(atom)
            return "warn", atom, broken
        if self.mode == "steer":
            other = next((a for a in self.alternatives if not self.broken_by(a)), "")
            if other:
                self.commit(other)
                return "steer", other, broken
        return "block", "", broken

    def reset(self) -> None:
        self.run, self.last = 0, []


def stream_guard(stream: DataFrame, spec: Spec, mode: str = "block", first: int | None = 0) -> DataFrame:
    """(trace_id, seq, atom, verdict, taken, rules) for every action."""

    def step(state, trace, rows):
        g = Guard(spec, mode)
        if state:
            g.run, g.last = state["run"], state["last"]
        out = [(trace, int(s), a, *g.step(a)) for s, a in rows]
        return {"run": g.run, "last": g.last}, out

    return _stateful(stream, step, "trace_id string, seq long, atom string, verdict string, taken string, rules array<string>", first)


def stream_first_firing(stream: DataFrame, pattern: str, first: int | None = 0) -> DataFrame:
    """(trace_id, step) once, when a pattern first occurs in a trajectory's spine."""
    rx = re.compile(pattern)

    def step(state, trace, rows):
        s = state or {"spine": "", "n": 0, "fired": False}
        out = []
        for _, a in rows:
            if not s["fired"]:
                s["spine"] += a + " "
                s["n"] += 1
                if rx.search(s["spine"]):
                    s["fired"], s["spine"] = True, ""
                    out.append((trace, s["n"] - 1))
        return s, out

    return _stateful(stream, step, "trace_id string, step long", first)


def stream_rolling_mix(stream: DataFrame, window: int = 40, stride: int = 5, first: int | None = 0) -> DataFrame:
    """(trace_id, pos, atom, share): mix of the last window actions, every stride actions."""

    def step(state, trace, rows):
        s = state or {"tail": [], "n": 0}
        out = []
        for _, a in rows:
            s["tail"] = [*s["tail"], a][-window:]
            s["n"] += 1
            if s["n"] % stride == 0:
                out += [(trace, s["n"] - 1, x, s["tail"].count(x) / len(s["tail"])) for x in sorted(set(s["tail"]))]
        return s, out

    return _stateful(stream, step, "trace_id string, pos long, atom string, share double", first)


def first_firing(traces: DataFrame, pattern: str) -> DataFrame:
    """(trace_id, step, atoms_saved): the batch twin of stream_first_firing.

    Whether a pattern has occurred by a step doesn't change back later, unless it looks at
    the end or ahead, so the first such step is found by bisection, and those patterns by
    trying every prefix.
    """
    a, n = F.col("atoms"), F.size("atoms")
    hit = traces.where(spine(a).rlike(pattern))
    held = lambda i: spine(F.slice(a, F.lit(1), i)).rlike(pattern)
    if re.search(r"\$|\(\?[=!<]|\\[bBzZ]", pattern):
        at = F.array_position(F.transform(F.sequence(F.lit(1), n), held), F.lit(True)).cast("int")
        hit = traces.withColumn("at", at).where("at > 0")
        at = F.col("at")
    else:
        rounds = F.sequence(F.lit(0), F.ceil(F.log2(n.cast("double"))).cast("int"))
        start = F.struct(F.lit(0).alias("lo"), n.alias("hi"))

        def halve(s, _):
            mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
            there = held(mid)
            return F.when(s["hi"] - s["lo"] <= 1, s).otherwise(F.struct(F.when(there, s["lo"]).otherwise(mid).alias("lo"), F.when(there, mid).otherwise(s["hi"]).alias("hi")))

        at = F.aggregate(rounds, start, halve)["hi"]
    return hit.select("trace_id", (at - 1).cast("long").alias("step"), (n - at).cast("long").alias("atoms_saved"))
