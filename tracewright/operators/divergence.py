"""Divergence between groups of fingerprints."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import jsd_term
from .bpe import with_distribution


def shared_vocab_spec(fps: DataFrame) -> str | None:
    """The one vocabulary that all fingerprints carry; raises where they differ, None where none carries any."""
    found = [r[0] for r in fps.select("vocab_spec").where("vocab_spec is not null").distinct().limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"fingerprints of different vocabularies: {sorted(found)}")
    return found[0] if found else None


def grouping(fps: DataFrame, group_by: str):
    """agent, group (which falls back to agent), or a metadata key."""
    if group_by == "agent":
        return F.col("agent")
    if group_by == "group":
        return F.coalesce("group", "agent")
    return F.col("metadata")[group_by]


def group_means(fps: DataFrame, group_by: str = "group", mode: str = "macro") -> DataFrame:
    """(g, token_id, p): macro averages members' distributions, micro pools their counts."""
    g = grouping(fps, group_by).alias("g")
    if mode == "micro":
        long = fps.select(g, F.posexplode("counts").alias("token_id", "n")).groupBy("g", "token_id").agg(F.sum("n").alias("n"))
        sums = long.groupBy("g").agg(F.sum("n").alias("t"))
        return long.join(sums, "g").select("g", "token_id", (F.col("n") / F.col("t")).alias("p"))
    long = with_distribution(fps).select(g, F.posexplode("distribution").alias("token_id", "p")).where("g is not null")
    return long.groupBy("g", "token_id").agg(F.avg("p").alias("p"))


def jsd_matrix(fps: DataFrame, group_by: str = "group", base: float = 2.0, mode: str = "macro", check: bool = True) -> DataFrame:
    """(row, col, jsd) over all pairs of groups.

    Means are aggregated to one row per group and token before they meet, and they meet by
    token, so neither trajectories nor whole vectors are ever crossed.
    """
    if check:
        shared_vocab_spec(fps)
    m = group_means(fps, group_by, mode)
    a = m.select(F.col("g").alias("row"), "token_id", F.col("p").alias("p"))
    b = m.select(F.col("g").alias("col"), "token_id", F.col("p").alias("q"))
    terms = a.join(b, "token_id").groupBy("row", "col").agg(F.sum(jsd_term(F.col("p"), F.col("q"))).alias("s"))
    return terms.select("row", "col", F.when(F.col("row") == F.col("col"), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("s") / math.log(base))).alias("jsd"))


def dense(matrix: DataFrame) -> tuple[list[str], list[list[float]]]:
    """The grid of a (small) matrix, in the order of group names."""
    rows = {(r.row, r.col): r.jsd for r in matrix.collect()}
    names = sorted({a for a, _ in rows})
    return names, [[rows[a, b] for b in names] for a in names]
