"""Structural patterns: regular expressions over spines, as columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequences import spine


@dataclass(frozen=True)
class Pattern:
    name: str
    pattern: str
    description: str = ""
    must_hold: bool = True


def load_patterns(path: str | Path) -> list[Pattern]:
    """Rules of a YAML file with a top-level list rules."""
    import yaml

    with open(path) as f:
        body = yaml.safe_load(f)
    if not isinstance(body, dict) or not isinstance(body.get("rules"), list):
        raise TypeError("a rules file holds a mapping with the list 'rules'")
    out = []
    for r in body["rules"]:
        if not isinstance(r, dict):
            raise TypeError("a rule is a mapping")
        if not r.get("name") or not r.get("pattern"):
            raise ValueError("a rule needs a name and a pattern")
        out.append(Pattern(str(r["name"]), str(r["pattern"]), str(r.get("description", "")), bool(r.get("must_hold", True))))
    return out


def grep(traces: DataFrame, pattern: str) -> DataFrame:
    """The trajectories whose spine matches."""
    return traces.where(spine(F.col("atoms")).rlike(pattern))


def hit_rate(traces: DataFrame, pattern: str, *by: str) -> DataFrame:
    return traces.groupBy(*by).agg(F.count("*").alias("n"), F.sum(spine(F.col("atoms")).rlike(pattern).cast("long")).alias("hits"), F.avg(spine(F.col("atoms")).rlike(pattern).cast("double")).alias("rate"))


def violations(traces: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """(trace_id, rule), one row per rule that a trajectory breaks; all rules in one pass."""
    s = spine(F.col("atoms"))
    broken = [F.when(s.rlike(p.pattern) != F.lit(p.must_hold), F.lit(p.name)) for p in patterns]
    return traces.select("trace_id", F.explode(F.array_compact(F.array(*broken))).alias("rule"))


def match_patterns(traces: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """(rule, n, fails, pass_rate) of all rules in one aggregation; without trajectories every rate is 1."""
    s = spine(F.col("atoms"))
    if not patterns:
        return traces.sparkSession.createDataFrame([], "rule string, n long, fails long, pass_rate double")
    sums = traces.agg(F.count("*").alias("n"), *[F.coalesce(F.sum((s.rlike(p.pattern) != F.lit(p.must_hold)).cast("long")), F.lit(0)).alias(f"f{i}") for i, p in enumerate(patterns)])
    rows = F.explode(F.array(*[F.struct(F.lit(p.name).alias("rule"), F.col(f"f{i}").alias("fails")) for i, p in enumerate(patterns)]))
    return sums.select("n", rows.alias("x")).select("x.rule", "n", "x.fails", (1 - F.col("x.fails") / F.greatest("n", F.lit(1))).alias("pass_rate"))


#: Questions with their patterns: a compiler of questions can be any callable from text to a pattern.
CANNED: dict[str, str] = {
    "edits three times in a row": "(?:edit ){3,}",
    "runs tests right after an edit": "(?:^| )edit run_test ",
    "submits without ever running tests": "^(?!.*run_test ).*submit ",
    "starts by reading": "^read_file ",
    "searches before the first edit": "^(?:(?!edit )\\S+ )*search_repo ",
    "ends with an error": "error $",
    "errs twice in a row": "(?:error ){2,}",
    "edits and never tests afterwards": "edit (?:(?!run_test )\\S+ )*$",
}


def ask(question: str, compiler=None) -> str:
    """The pattern of a question: a canned one, or what the given compiler says; None from it refuses."""
    found = CANNED.get(question.strip().lower()) or (compiler(question) if compiler else None)
    if found is None:
        raise ValueError(f"the question can't be expressed as a pattern: {question!r}")
    return found
