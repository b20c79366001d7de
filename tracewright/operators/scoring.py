"""Declarative procedure specs: scoring, derivation from winners, enforcement, verification, tuning.

Specs are small driver objects that compile to column expressions, so trajectories are
scored where they are.
"""

from __future__ import annotations

import json
import random
import re
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.distributions import jsd, normalize
from .bpe import SEPARATOR, Vocabulary, encode
from .patterns import Pattern

ATOMS = tuple("create_file delete_file edit error lint localize other package prompt_ai read_file run_code run_test search_repo submit think version_control".split())


@dataclass(frozen=True)
class Phase:
    name: str
    reward: float
    #: one of these atoms must occur often enough
    require_any: tuple[str, ...] = ()
    #: only what stands before this atom counts
    before_first: str | None = None
    #: how often
    min_count: int = 1

    def holds(self, atoms: Column) -> Column:
        if not self.require_any:
            return F.lit(True)
        scope = S.before_first(atoms, self.before_first) if self.before_first else atoms
        found = F.lit(False)
        for a in self.require_any:
            found = found | (S.count_of(scope, a) >= self.min_count)
        return found

    def sentence(self) -> str:
        what = " or ".join(human(a) for a in self.require_any) or "act"
        times = f", {self.min_count} times or more" if self.min_count > 1 else ""
        return f"{what}{times}" + (f", and do so before any {human(self.before_first)}" if self.before_first else "")


@dataclass(frozen=True)
class Penalty:
    """max_run limits runs of edits, whatever the penalty's name; forbid_sequence forbids adjacent atoms."""

    name: str
    reward: float
    #: the longest run of edits that is free
    max_run: int | None = None
    #: atoms that may not follow one another
    forbid_sequence: tuple[str, ...] = ()

    def fires(self, atoms: Column) -> Column:
        hit = S.contains_seq(atoms, list(self.forbid_sequence))
        return hit if self.max_run is None else hit | (S.max_run(atoms, "edit") > self.max_run)

    def sentence(self) -> str:
        parts = [] if self.max_run is None else [f"{self.max_run + 1} or more edits in a row"]
        if self.forbid_sequence:
            parts.append("doing " + ", then ".join(human(a) for a in self.forbid_sequence))
        return " and ".join(parts) or self.name

    def regex(self) -> str | None:
        if self.forbid_sequence:
            return "(?:^| )" + " ".join(re.escape(a) for a in self.forbid_sequence) + "(?: |$)"
        return None if self.max_run is None else f"(?:edit ){{{self.max_run + 1},}}"


def human(atom: str) -> str:
    return atom.replace(SEPARATOR, ", then ").replace("_", " ")


_PHASE_KEYS, _PENALTY_KEYS = ({f.name for f in fields(c)} for c in (Phase, Penalty))


@dataclass(frozen=True)
class Spec:
    #: what earns reward
    phases: tuple[Phase, ...] = ()
    #: what costs it
    penalties: tuple[Penalty, ...] = ()
    #: scores are clipped to this range
    floor: float = 0.0
    ceiling: float = 1.0
    #: summed token counts that enforcement aims at
    target: tuple[int, ...] | None = field(default=None, compare=False)
    name: str = "spec"

    # ------------------------------------------------------------ scoring
    def raw(self, atoms: Column) -> Column:
        out = F.lit(0.0)
        for p in self.phases:
            out = out + F.when(p.holds(atoms), F.lit(float(p.reward))).otherwise(0.0)
        for q in self.penalties:
            out = out - F.when(q.fires(atoms), F.lit(float(q.reward))).otherwise(0.0)
        return out

    def clipped(self, atoms: Column) -> Column:
        return F.greatest(F.lit(float(self.floor)), F.least(F.lit(float(self.ceiling)), self.raw(atoms)))

    def score(self, traces: DataFrame) -> DataFrame:
        """traces with raw, score (clipped), and the phases met and penalties incurred."""
        atoms = F.col("atoms")
        names = lambda pairs: F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in pairs])) if pairs else F.array().cast("array<string>")
        return (
            traces.withColumn("raw", F.round(self.raw(atoms), 4))
            .withColumn("score", F.round(self.clipped(atoms), 4))
            .withColumn("satisfied_phases", names([(p.name, p.holds(atoms)) for p in self.phases]))
            .withColumn("triggered_penalties", names([(q.name, q.fires(atoms)) for q in self.penalties]))
        )

    # ------------------------------------------------------------ other forms
    def to_prompt(self) -> str:
        lines = ["Work through the task by this procedure.", ""]
        lines += [f"{i}. {p.sentence()}" for i, p in enumerate(self.phases, 1)]
        if self.penalties:
            lines += ["", "Never:"] + [f"- {q.sentence()}" for q in self.penalties]
        text = "\n".join(lines)
        return text

    def to_patterns(self) -> list[Pattern]:
        return [Pattern(q.name, r, q.sentence(), must_hold=False) for q in self.penalties if (r := q.regex()) is not None]

    def to_dict(self) -> dict:
        drop = lambda d: {k: (list(v) if isinstance(v, tuple) else v) for k, v in d.items() if v not in (None, ())}
        return {**{k: getattr(self, k) for k in ("name", "floor", "ceiling")}, "phases": [drop(asdict(p)) for p in self.phases], "penalties": [drop(asdict(q)) for q in self.penalties]}

    def to_yaml(self, path: str | Path) -> None:
        import yaml

        Path(path).write_text(yaml.safe_dump(self.to_dict(), sort_keys=False))

    @classmethod
    def from_dict(cls, d: dict) -> Spec:
        """Refuses unknown and missing keys."""

        def checked(x: dict, allowed: set[str], what: str) -> dict:
            if not isinstance(x, dict):
                raise ValueError(f"{what} must be a mapping")
            if more := set(x) - allowed:
                raise ValueError(f"unknown keys in {what}: {sorted(more)}")
            if missing := allowed & {"reward"} - set(x):
                raise ValueError(f"{what} lacks {sorted(missing)}")
            return x

        checked(d, {"name", "floor", "ceiling", "phases", "penalties"}, "spec")
        phases = []
        for k, x in enumerate(d.get("phases") or []):
            checked(x, _PHASE_KEYS, "phase")
            phases.append(Phase(str(x.get("name", f"phase_{k}")), float(x["reward"]), tuple(map(str, x.get("require_any") or ())), x.get("before_first"), int(x.get("min_count", 1))))
        penalties = []
        for k, x in enumerate(d.get("penalties") or []):
            checked(x, _PENALTY_KEYS, "penalty")
            penalties.append(Penalty(str(x.get("name", f"penalty_{k}")), float(x["reward"]), None if x.get("max_run") is None else int(x["max_run"]), tuple(map(str, x.get("forbid_sequence") or ()))))
        return cls(tuple(phases), tuple(penalties), float(d.get("floor", 0.0)), float(d.get("ceiling", 1.0)), None, str(d.get("name", "spec")))

    @classmethod
    def from_yaml(cls, path: str | Path) -> Spec:
        import yaml

        return cls.from_dict(yaml.safe_load(Path(path).read_text()) or {})

    # ------------------------------------------------------------ derivation
    @classmethod
    def from_winners(cls, traces: DataFrame, vocab: Vocabulary, outcome_field: str = "resolved") -> Spec:
        """Rules that winners keep clearly more often than losers, a cap on edit runs, and the winners' summed counts as target.

        One aggregation for all rates, one for the target.
        """
        atoms = F.col("atoms")
        has = lambda a: F.array_contains("atoms", a)
        rules = {
            "verification": (has("edit"), F.array_contains(S.after_first(atoms, "edit"), "run_test")),
            "validation_before_submit": (has("submit"), F.array_contains(S.before_first(atoms, "submit"), "run_test")),
            "exploration": (has("edit"), F.arrays_overlap(S.before_first(atoms, "edit"), F.array(F.lit("search_repo"), F.lit("read_file")))),
        }
        rows = traces.withColumn("won", truthy(F.col("metadata")[outcome_field]))
        aggs = [F.count("*").alias("n")]
        for name, (eligible, kept) in rules.items():
            aggs.append(F.coalesce(F.avg(F.when(eligible, kept.cast("double"))), F.lit(0.0)).alias(name))
        runs = S.max_run(atoms, "edit")
        aggs.append(F.percentile(F.when(runs > 0, runs), F.lit(0.9)).alias("cap"))
        got = {r.won: r for r in rows.groupBy("won").agg(*aggs).collect()}
        if True not in got:
            raise ValueError(f"no trajectory has a true {outcome_field!r}")
        win, lose = got[True], got.get(False)

        def separates(rule: str) -> bool:
            return win[rule] >= 0.65 if lose is None else win[rule] >= 0.5 and win[rule] - lose[rule] >= 0.15

        known = {
            "verification": Phase("verification", 0.25, ("run_test",)),
            "validation_before_submit": Phase("validation_before_submit", 0.15, ("run_test",), "submit"),
            "exploration": Phase("exploration", 0.1, ("search_repo", "read_file"), "edit"),
        }
        phases = tuple(p for n, p in known.items() if separates(n)) or (known["verification"],)
        penalties = () if win["cap"] is None else (Penalty("edit_streak", 0.15, max(3, min(10, round(win["cap"])))),)
        return cls(phases, penalties, 0.0, 1.0, summed_counts(encode(rows.where("won"), vocab), vocab), "derived_from_winners")


def truthy(value: Column) -> Column:
    """Whether a metadata string is true: null, empty, false, 0 and none are not."""
    return F.coalesce(~F.lower(value).isin("", "false", "0", "none", "null"), F.lit(False))


def summed_counts(fps: DataFrame, vocab: Vocabulary) -> tuple[int, ...]:
    """Sum of the count vectors: one number per token reaches the driver."""
    sums = {r.pos: r.n for r in fps.select(F.posexplode("counts").alias("pos", "c")).groupBy("pos").agg(F.sum("c").alias("n")).collect()}
    return tuple(int(sums.get(i, 0)) for i in range(vocab.size))


class Library:
    """A folder of specs, one YAML file each, by slugged name."""

    def __init__(self, folder: str | Path):
        self.folder = Path(folder)

    def _path(self, name: str) -> Path:
        slug = re.sub(r"[^a-z0-9]+", "-", name.lower()).strip("-")
        if not slug:
            raise ValueError("a spec's name needs a letter or digit")
        return self.folder / f"{slug}.yaml"

    def save(self, spec: Spec) -> Path:
        self.folder.mkdir(parents=True, exist_ok=True)
        spec.to_yaml(self._path(spec.name))
        return self._path(spec.name)

    def load(self, name: str) -> Spec:
        if not self._path(name).exists():
            raise KeyError(name)
        return Spec.from_yaml(self._path(name))

    def names(self) -> list[str]:
        return sorted(p.stem for p in self.folder.glob("*.yaml"))

    def __iter__(self):
        return (self.load(n) for n in self.names())

    def __len__(self) -> int:
        return sum(1 for _ in self.names())

    def __contains__(self, name: object) -> bool:
        return isinstance(name, str) and self._path(name).exists()


# ---------------------------------------------------------------- enforcement
def guard_violations(spec: Spec, prefix: Column) -> Column:
    """Names of the guards that a prefix has broken."""
    found = [F.when(S.spine(prefix).rlike(p.pattern), F.lit(p.name)) for p in spec.to_patterns()]
    return F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")


def allowed_next(spec: Spec, prefix: Column, alphabet: Sequence[str] = ATOMS) -> Column:
    """Atoms that may follow a prefix: no edit at a run's cap, no last atom of a forbidden sequence; never empty."""
    blocked = []
    caps = [q.max_run for q in spec.penalties if q.max_run is not None]
    if caps:
        blocked.append(F.when(S.trailing_run(prefix, "edit") >= min(caps), F.lit("edit")))
    for q in spec.penalties:
        if q.forbid_sequence:
            blocked.append(F.when(S.ends_with(prefix, list(q.forbid_sequence[:-1])), F.lit(q.forbid_sequence[-1])))
    everything = F.array(*[F.lit(a) for a in sorted(alphabet)])
    if not blocked:
        return everything
    rest = F.array_except(everything, F.array_compact(F.array(*blocked)))
    return F.when(F.size(rest) > 0, rest).otherwise(everything)


def prefix_scores(spec: Spec, atoms: Sequence[str]) -> list[float]:
    """The clipped score of every prefix, the empty one first, in one pass: state is what each phase has counted and the run of edits."""
    counts = [dict.fromkeys(p.require_any, 0) for p in spec.phases]
    holds = [not p.require_any or p.min_count <= 0 for p in spec.phases]
    closed = [False] * len(spec.phases)
    fired = [q.max_run is not None and q.max_run < 0 for q in spec.penalties]
    run = 0

    def score() -> float:
        out = 0.0
        for p, h in zip(spec.phases, holds):
            out = out + (float(p.reward) if h else 0.0)
        for q, h in zip(spec.penalties, fired):
            out = out - (float(q.reward) if h else 0.0)
        return max(float(spec.floor), min(float(spec.ceiling), out))

    scores = [score()]
    for i, a in enumerate(atoms, 1):
        run = run + 1 if a == "edit" else 0
        for k, p in enumerate(spec.phases):
            closed[k] = closed[k] or (p.before_first is not None and p.before_first != "" and a == p.before_first)
            if not closed[k] and a in counts[k]:
                counts[k][a] += 1
                holds[k] = holds[k] or counts[k][a] >= p.min_count
        for k, q in enumerate(spec.penalties):
            n = len(q.forbid_sequence)
            fired[k] = fired[k] or (q.max_run is not None and run > q.max_run) or (0 < n <= i and a == q.forbid_sequence[-1] and tuple(atoms[i - n : i]) == tuple(q.forbid_sequence))
        scores.append(score())
    return scores


def step_rewards(spec: Spec, atoms: Column) -> Column:
    """Change of the clipped score with each further atom."""

    @F.pandas_udf("array<double>")
    def scores(column: pd.Series) -> pd.Series:
        return column.map(lambda a: prefix_scores(spec, [] if a is None else list(a)))

    change = lambda s: F.zip_with(F.slice(s, F.lit(2), F.size(s)), F.slice(s, F.lit(1), F.size(s) - 1), lambda b, a: F.round(b, 4) - F.round(a, 4))
    return F.get(F.transform(F.array(scores(atoms)), change), F.lit(0))


def enforce(spec: Spec, mode: str = "prompt", scaffold: str | None = None):
    """An artifact for a scaffold: prompt text, or column functions (guard, decode, reward) with their serialised rules."""
    if mode == "prompt":
        render = {None: Spec.to_prompt, "swe-agent": swe_agent_config, "openhands": openhands_skill}.get(scaffold)
        if render is None:
            raise ValueError(f"unknown scaffold {scaffold!r}")
        return render(spec)
    if mode == "guard":
        return {"check": lambda prefix: guard_violations(spec, prefix), "rules_json": json.dumps([asdict(p) for p in spec.to_patterns()])}
    if mode == "decode":
        rules = {"alphabet": sorted(ATOMS), "edit_caps": [q.max_run for q in spec.penalties if q.max_run is not None], "forbidden": [list(q.forbid_sequence) for q in spec.penalties if q.forbid_sequence]}
        return {"allowed": lambda prefix: allowed_next(spec, prefix), "rules_json": json.dumps(rules)}
    if mode == "reward":
        return {"reward": spec.clipped, "step_rewards": lambda atoms: step_rewards(spec, atoms), "spec_json": json.dumps(spec.to_dict())}
    raise ValueError(f"unknown mode {mode!r}")


def _block(text: str, indent: int) -> str:
    return "\n".join(" " * indent + line if line else "" for line in text.split("\n"))


def swe_agent_config(spec: Spec) -> str:
    return "agent:\n  templates:\n    system_template: |\n" + _block(spec.to_prompt(), 6) + "\n"


def openhands_skill(spec: Spec) -> str:
    return f"---\nname: {json.dumps(spec.name)}\ntype: repo\n---\n\n{spec.to_prompt()}\n"


# ---------------------------------------------------------------- verification and tuning
def verify(before: DataFrame, after: DataFrame, spec: Spec, vocab: Vocabulary, outcome_field: str = "resolved", jsd_eps: float = 1e-3, outcome_eps: float = 0.0) -> DataFrame:
    """One row: divergence of both populations' summed counts from the target, change of the resolved rate, verdict."""
    if spec.target is None:
        raise ValueError("the spec has no target")
    both = encode(before, vocab).withColumn("side", F.lit("before")).unionByName(encode(after, vocab).withColumn("side", F.lit("after")))
    target = normalize(F.array(*[F.lit(float(c)) for c in spec.target]))
    sums = both.select("side", F.posexplode("counts").alias("pos", "c")).groupBy("side").agg(*[F.coalesce(F.sum(F.when(F.col("pos") == i, F.col("c"))), F.lit(0)).cast("double").alias(f"c{i}") for i in range(vocab.size)])
    d = sums.select("side", jsd(normalize(F.array(*[F.col(f"c{i}") for i in range(vocab.size)])), target).alias("d"))
    rates = both.groupBy("side").agg(F.avg(truthy(F.col("metadata")[outcome_field]).cast("double")).alias("rate"))
    pick = lambda df, c, s, empty: F.coalesce(F.max(F.when(F.col("side") == s, F.col(c))), F.lit(empty)).alias(f"{c}_{s}")
    one = d.join(rates, "side", "full").agg(pick(d, "d", "before", 1.0), pick(d, "d", "after", 1.0), pick(rates, "rate", "before", 0.0), pick(rates, "rate", "after", 0.0))
    moved = (F.col("d_before") - F.col("d_after")) > jsd_eps
    delta = F.col("rate_after") - F.col("rate_before")
    verdict = F.when(~moved, "weak_enforcement").when(delta > outcome_eps, "lever").otherwise("epiphenomenal")
    return one.select(moved.alias("behavior_moved"), F.col("d_before").alias("jsd_before"), F.col("d_after").alias("jsd_after"), delta.alias("outcome_delta"), verdict.alias("verdict"))


def _objectives(specs: list[Spec], rows: DataFrame, penalty: float) -> list[tuple[float, float]]:
    """(train objective, validation discrimination) of many specs in one pass."""
    atoms = F.col("atoms")
    aggs = []
    for k, s in enumerate(specs):
        for side in ("train", "val"):
            for won in (True, False):
                aggs.append(F.avg(F.when((F.col("part") == side) & (F.col("won") == won), F.round(s.clipped(atoms), 4))).alias(f"{k}_{side}_{int(won)}"))
    r = rows.agg(*aggs).first()

    def gap(k: int, side: str) -> float:
        a, b = r[f"{k}_{side}_1"], r[f"{k}_{side}_0"]
        return 0.0 if a is None or b is None else a - b

    return [(gap(k, "train") - penalty * len(s.phases), gap(k, "val")) for k, s in enumerate(specs)]


def optimize(spec: Spec, traces: DataFrame, outcome_field: str = "resolved", cap_grid: Sequence[int] = (*range(3, 7), 8, 10), seed: int = 0, val_fraction: float = 0.3, complexity_penalty: float = 0.02) -> tuple[Spec, dict]:
    """Picks the cap on edit runs that separates winners from losers best, then drops phases that don't help.

    Trajectories are split into training and validation by a seeded hash of their id; all
    candidates of a move are scored in one pass.
    """
    salt = random.Random(seed).getrandbits(31)
    rows = traces.withColumn("won", truthy(F.col("metadata")[outcome_field])).withColumn("part", F.when(F.pmod(F.xxhash64(F.lit(salt), "trace_id"), F.lit(1000)) < int(val_fraction * 1000), "val").otherwise("train"))
    sides = {r.won for r in rows.select("won").distinct().collect()}
    if sides != {True, False}:
        raise ValueError("tuning needs winners and losers")
    best, trail, tried = spec, [], 0
    first = _objectives([spec], rows, complexity_penalty)[0]
    at = next((i for i, q in enumerate(spec.penalties) if q.max_run is not None), None)
    score = first
    if at is not None:
        made = [replace(spec, penalties=tuple(replace(q, max_run=c) if i == at else q for i, q in enumerate(spec.penalties))) for c in cap_grid]
        got = _objectives(made, rows, complexity_penalty)
        tried += len(made)
        k = max(range(len(made)), key=lambda i: (got[i][0], -i))
        best, score = made[k], got[k]
        trail.append(score[0])
    while len(best.phases) > 1:
        made = [replace(best, phases=tuple(p for j, p in enumerate(best.phases) if j != i)) for i in range(len(best.phases))]
        got = _objectives(made, rows, complexity_penalty)
        tried += len(made)
        k = next((i for i in range(len(made)) if got[i][0] > score[0]), None)
        if k is None:
            break
        best, score = made[k], got[k]
        trail.append(score[0])
    caps = [q.max_run for q in best.penalties if q.max_run is not None]
    return best, {"seed_val_score": first[1], "best_val_score": score[1], "n_candidates": tried, "edit_streak_cap": caps[0] if caps else None, "phases": [p.name for p in best.phases], "train_trace": trail}


# ---------------------------------------------------------------- the older dictionary form
def legacy_score(spec: dict, atoms: Column) -> Column:
    """Score of the older YAML layout: phases with require_any[{atom}], min_occurrences, require_pattern, require_sequence, require_absent_before; penalties with pattern or max_run; bonuses."""

    def sequence_count(seq: list[str], gap: int | None) -> Column:
        # suffixes that hold the sequence, as the layout defines it
        n = F.size(atoms)
        places = F.when(n > 0, F.sequence(F.lit(1), F.greatest(n, F.lit(1)))).otherwise(F.array().cast("array<int>"))
        return F.size(F.filter(places, lambda i: S.matches_with_gaps(F.slice(atoms, i, n), seq, gap)))

    def phase(x: dict) -> Column:
        scope = S.before_first(atoms, x["before_first"]) if x.get("before_first") else atoms
        least = int(x.get("min_occurrences", x.get("min_count", 1)))
        ok = F.lit(True)
        if x.get("require_any"):
            names = [r["atom"] if isinstance(r, dict) else r for r in x["require_any"]]
            any_of = F.lit(False)
            for a in names:
                any_of = any_of | (S.count_of(scope, a) >= least)
            ok = ok & any_of
        if x.get("require_pattern"):
            seq = list(x["require_pattern"]) if not isinstance(x["require_pattern"], str) else x["require_pattern"].split()
            ok = ok & (S.count_seq(scope, seq) >= least)
        if x.get("require_sequence"):
            ok = ok & (sequence_count(list(x["require_sequence"]), x.get("max_gap")) >= least)
        if x.get("require_absent_before"):
            rule = x["require_absent_before"]
            ok = ok & (S.count_of(S.before_first(atoms, rule["before"]), rule["atom"]) == 0)
        return ok

    def penalty(x: dict) -> Column:
        hit = F.lit(False)
        if x.get("pattern"):
            seq = list(x["pattern"]) if not isinstance(x["pattern"], str) else x["pattern"].split()
            hit = hit | (S.count_seq(atoms, seq) >= int(x.get("min_occurrences", 1)))
        if x.get("max_run") is not None:
            hit = hit | (S.max_run(atoms, x.get("atom", "edit")) > int(x["max_run"]))
        return hit

    out = F.lit(0.0)
    for x in [*(spec.get("phases") or []), *(spec.get("bonuses") or [])]:
        out = out + F.when(phase(x), F.lit(float(x.get("reward", 0.0)))).otherwise(0.0)
    for x in spec.get("penalties") or []:
        out = out - F.when(penalty(x), F.lit(abs(float(x.get("reward", x.get("penalty", 0.0)))))).otherwise(0.0)
    return F.greatest(F.lit(float(spec.get("floor", 0.0))), F.least(F.lit(float(spec.get("ceiling", 1.0))), out))


Classifier = Callable[[str], str]
