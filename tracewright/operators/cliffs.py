"""Cliffs: places where the mix of actions before and after differs unusually.

The score of place i compares the window actions before i with those from i on; it is
known once the action after the window's end has arrived. A cliff fires where the score
reaches the running quantile of the scores so far. Batches are column expressions and a
window; streams keep the last actions and the counts of distinct scores of a trajectory.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_jsd(before: list[str], after: list[str]) -> float:
    """Base-2 divergence of two short windows' mixes."""
    names = sorted({*before, *after})
    p = np.array([before.count(a) for a in names], float) / max(1, len(before))
    q = np.array([after.count(a) for a in names], float) / max(1, len(after))
    part = lambda x: sum(a * math.log2(2 * a / (b + c)) for a, b, c in zip(x, p, q) if a)
    return (part(p) + part(q)) / 2


class CliffDetector:
    """Takes atoms one by one; state is the last 2 * window + 1 atoms and how often each score occurred (two windows of a few actions have few distinct scores)."""

    def __init__(self, window: int = 5, quantile: float = 0.9, min_scores: int = 5):
        self.window, self.quantile, self.min_scores = window, quantile, min_scores
        self.tail: list[str] = []
        self.scores: dict[float, int] = {}
        self.held = 0
        self.seen = 0

    def append(self, atom: str) -> tuple[int, float, float] | None:
        """(place, score, threshold) where a cliff fires."""
        w = self.window
        self.tail.append(atom)
        self.seen += 1
        if len(self.tail) > 2 * w + 1:
            self.tail.pop(0)
        if self.seen < 2 * w + 1:
            return None
        score = round(window_jsd(self.tail[:w], self.tail[w : 2 * w]), 12)
        self.scores[score] = self.scores.get(score, 0) + 1
        self.held += 1
        if self.held < self.min_scores:
            return None
        limit = self._limit()
        return (self.seen - w - 1, score, limit) if score >= limit - 1e-12 else None

    def _limit(self) -> float:
        """The running quantile, interpolated between the two ranks around it."""
        at = (self.held - 1) * self.quantile
        lo, hi = math.floor(at), math.ceil(at)
        upto, found = 0, []
        for value in sorted(self.scores):
            upto += self.scores[value]
            while len(found) < 2 and (lo, hi)[len(found)] < upto:
                found.append(value)
        return found[0] + (found[1] - found[0]) * (at - lo)

    def dump(self) -> dict:
        return {"tail": self.tail, "scores": sorted(self.scores.items()), "seen": self.seen}

    def load(self, d: dict) -> CliffDetector:
        self.tail, self.scores, self.seen = list(d["tail"]), {float(x): int(n) for x, n in d["scores"]}, int(d["seen"])
        self.held = sum(self.scores.values())
        return self


def detect(atoms: list[str], window: int = 5, quantile: float = 0.9, min_scores: int = 5) -> list[tuple[int, float, float]]:
    d = CliffDetector(window, quantile, min_scores)
    return [c for a in atoms if (c := d.append(a)) is not None]


def scores(traces: DataFrame, window: int = 5) -> DataFrame:
    """(trace_id, index, jsd): the score of every place that has a whole window before it and one and a further action after it."""
    a, n, w = F.col("atoms"), F.size("atoms"), window
    places = F.when(n > 2 * w, F.sequence(F.lit(w), F.greatest(n - w - 1, F.lit(w)))).otherwise(F.array().cast("array<int>"))

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x / w * F.log2(2 * x / (x + y))).otherwise(0.0)

    def score(i: Column) -> Column:
        before, after = F.slice(a, i - w + 1, F.lit(w)), F.slice(a, i + 1, F.lit(w))

        def term(name: Column) -> Column:
            x, y = (F.size(F.filter(side, lambda z: z == name)) for side in (before, after))
            return part(x, y) + part(y, x)

        # both halves are sums of a few terms: rounding makes equal windows equal whatever the order of the terms
        return F.round(F.aggregate(F.array_distinct(F.concat(before, after)), F.lit(0.0), lambda t, z: t + term(z)) / 2, 12)

    return traces.select("trace_id", F.explode(F.transform(places, lambda i: F.struct(i.alias("index"), score(i).alias("jsd")))).alias("c")).select("trace_id", "c.index", "c.jsd")


def detect_cliffs(traces: DataFrame, window: int = 5, quantile: float = 0.9, min_scores: int = 5) -> DataFrame:
    """(trace_id, index, jsd, threshold), one row per cliff. The running quantile is a window function; two windows of a few actions have few distinct scores, which is what its state holds."""
    so_far = Window.partitionBy("trace_id").orderBy("index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = scores(traces, window).withColumns({"threshold": F.percentile("jsd", F.lit(quantile)).over(so_far), "k": F.row_number().over(Window.partitionBy("trace_id").orderBy("index"))})
    return s.where((F.col("k") >= min_scores) & (F.col("jsd") >= F.col("threshold") - 1e-12)).select("trace_id", "index", "jsd", "threshold")


def summarize_cliffs(traces: DataFrame, window: int = 5, quantile: float = 0.9, tolerance: int = 1, prompt: str = "prompt_ai") -> DataFrame:
    """Per trajectory: cliffs, those within tolerance of a prompt, hidden share, cliffs per 100 actions."""
    cliffs = detect_cliffs(traces, window, quantile)
    places = F.filter(F.transform("atoms", lambda a, i: F.when(a == prompt, i)), lambda i: i.isNotNull())
    rows = traces.select("trace_id", F.size("atoms").alias("n_actions"), places.alias("prompts"))
    per = cliffs.join(rows, "trace_id").withColumn("near", F.exists("prompts", lambda b: F.abs(F.col("index") - b) <= tolerance))
    agg = per.groupBy("trace_id").agg(F.count("*").alias("n_cliffs"), F.sum((~F.col("near")).cast("long")).alias("n_hidden"))
    out = rows.join(agg, "trace_id", "left").select("trace_id", "n_actions", F.coalesce("n_cliffs", F.lit(0)).alias("n_cliffs"), F.coalesce("n_hidden", F.lit(0)).alias("n_hidden"))
    return out.withColumn("hidden_fraction", F.when(F.col("n_cliffs") > 0, F.col("n_hidden") / F.col("n_cliffs"))).withColumn("per_100_actions", F.when(F.col("n_actions") > 0, 100 * F.col("n_cliffs") / F.col("n_actions")).otherwise(0.0))
