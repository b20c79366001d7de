"""Group statistics of trajectories and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import Vocabulary, with_entropy
from .divergence import group_means, grouping


def atom_frequencies_per_group(traces: DataFrame, k: int = 20, group_by: str = "group") -> DataFrame:
    """The k most frequent atoms of each group (ties by atom): count, rate per trajectory, group totals."""
    rows = traces.select(grouping(traces, group_by).alias("g"), "atoms")
    per = rows.groupBy("g").agg(F.count("*").alias("n_trajectories"), F.sum(F.size("atoms")).alias("n_atoms_total"))
    counts = rows.select("g", F.explode("atoms").alias("atom")).groupBy("g", "atom").agg(F.count("*").alias("n"))
    top = counts.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(F.desc("n"), "atom"))).where(F.col("rank") <= k)
    return top.join(per, "g").select("g", "atom", "n", (F.col("n") / F.col("n_trajectories")).alias("rate"), "rank", "n_trajectories", "n_atoms_total")


def effective_vocab_size_per_group(fps: DataFrame, group_by: str = "group") -> DataFrame:
    """exp of the entropy of each group's mean distribution."""
    m = group_means(fps, group_by)
    return m.groupBy("g").agg(F.exp(-F.sum(F.when(F.col("p") > 0, F.col("p") * F.log("p")).otherwise(0.0))).alias("effective_vocab_size"))


def entropies_per_group(fps: DataFrame, group_by: str = "group") -> DataFrame:
    """n, quartiles and range of the trajectories' entropies (nats)."""
    e = with_entropy(fps).select(grouping(fps, group_by).alias("g"), "entropy")
    return e.groupBy("g").agg(
        F.count("*").alias("n"),
        F.percentile("entropy", F.lit(0.5)).alias("median"),
        F.percentile("entropy", F.lit(0.25)).alias("q1"),
        F.percentile("entropy", F.lit(0.75)).alias("q3"),
        F.min("entropy").alias("min"),
        F.max("entropy").alias("max"),
    )


def discriminative_procedures(fps: DataFrame, vocab: Vocabulary, group_a: str, group_b: str, k: int = 10, *, group_by: str = "group", epsilon: float = 1e-6, ranking: str = "log_odds") -> DataFrame:
    """The k tokens that tell two groups apart, by log odds or by their share of the divergence (both in nats)."""
    if ranking not in ("log_odds", "jsd_contribution"):
        raise ValueError(f"unknown ranking {ranking!r}")
    m = group_means(fps, group_by).where(F.col("g").isin(group_a, group_b))
    wide = m.groupBy("token_id").agg(F.max(F.when(F.col("g") == group_a, F.col("p"))).alias("p_a"), F.max(F.when(F.col("g") == group_b, F.col("p"))).alias("p_b"))
    wide = wide.select("token_id", F.coalesce("p_a", F.lit(0.0)).alias("p_a"), F.coalesce("p_b", F.lit(0.0)).alias("p_b"))
    mid = (F.col("p_a") + F.col("p_b")) / 2
    half = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / mid)).otherwise(0.0)
    scored = wide.withColumn("log_odds", F.log((F.col("p_a") + epsilon) / (F.col("p_b") + epsilon))).withColumn("jsd_contribution", (half("p_a") + half("p_b")) / 2)
    top = scored.orderBy(F.desc(F.abs(ranking)), "token_id").limit(k)
    return top.join(F.broadcast(vocab.frame(fps.sparkSession).select("token_id", "token")), "token_id").select("token_id", "token", "p_a", "p_b", "log_odds", "jsd_contribution")


def concentration(fps: DataFrame, group_by: str = "group") -> DataFrame:
    """Per group: Herfindahl index and Gini coefficient of the mean distribution."""
    m = group_means(fps, group_by)
    w = Window.partitionBy("g").orderBy("p", "token_id")
    r = m.withColumn("i", F.row_number().over(w))
    return r.groupBy("g").agg(F.sum(F.col("p") * F.col("p")).alias("hhi"), (2 * F.sum(F.col("i") * F.col("p")) / (F.count("*") * F.sum("p")) - (F.count("*") + 1) / F.count("*")).alias("gini"))


def action_mix(traces: DataFrame, group_by: str = "agent") -> DataFrame:
    """Pooled shares of atoms per group."""
    n = traces.select(grouping(traces, group_by).alias("g"), F.explode("atoms").alias("atom")).groupBy("g", "atom").agg(F.count("*").alias("n"))
    return n.join(n.groupBy("g").agg(F.sum("n").alias("t")), "g").select("g", "atom", "n", (F.col("n") / F.col("t")).alias("share"))


def profile(traces: DataFrame, group_by: str = "agent") -> DataFrame:
    """Per group: lengths by nearest rank (10, 50, 90 %), mean length, share of exact duplicates."""
    rows = traces.select(grouping(traces, group_by).alias("g"), F.size("atoms").alias("n"), F.array_join("atoms", " ").alias("spine"))
    return rows.groupBy("g").agg(
        F.count("*").alias("n_traces"),
        F.avg("n").alias("mean_length"),
        *[F.percentile("n", F.lit(q)).alias(f"p{round(q * 100)}") for q in (0.1, 0.5, 0.9)],
        (1 - F.count_distinct("spine") / F.count("*")).alias("exact_dup_rate"),
    )
