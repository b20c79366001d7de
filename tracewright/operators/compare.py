"""Two-sided comparison with smoothed natural-log divergence, and study-level measures."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.distributions import jsd_term
from .divergence import grouping
from .scoring import truthy

CANONICAL = tuple("create_file delete_file edit error other read_file run_test search_repo think".split())
PAIR_ALPHABET = tuple("edit read_file run_test search_repo create_file delete_file think error other".split())
EPS = 1e-9


def _units(traces: DataFrame, units: Column, side: Column) -> DataFrame:
    return traces.select(side.alias("side"), F.explode(units).alias("unit")).groupBy("side", "unit").agg(F.count("*").alias("n"))


def _two_sided(counts: DataFrame, a: str, b: str, alphabet: Sequence[str] | None) -> DataFrame:
    """(unit, p, q) smoothed by EPS over the alphabet, or over all units seen."""
    wide = counts.where(F.col("side").isin(a, b)).groupBy("unit").agg(*[F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n"))), F.lit(0)).alias(c) for s, c in ((a, "na"), (b, "nb"))])
    if alphabet is not None:
        names = counts.sparkSession.createDataFrame([(x,) for x in alphabet], "unit string")
        wide = F.broadcast(names).join(wide, "unit", "left").select("unit", F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
    sums = wide.agg((F.sum("na") + EPS * F.count("*")).alias("ta"), (F.sum("nb") + EPS * F.count("*")).alias("tb")).withColumn("one", F.lit(1))
    return wide.withColumn("one", F.lit(1)).join(F.broadcast(sums), "one").select("unit", ((F.col("na") + EPS) / F.col("ta")).alias("p"), ((F.col("nb") + EPS) / F.col("tb")).alias("q"))


def unigram_jsd(traces: DataFrame, a: str, b: str, by: str = "agent", alphabet: Sequence[str] | None = CANONICAL, atoms: str = "atoms") -> DataFrame:
    """One row jsd_nats."""
    return _two_sided(_units(traces, F.col(atoms), grouping(traces, by)), a, b, alphabet).agg(F.sum(jsd_term(F.col("p"), F.col("q"))).alias("jsd_nats"))


def bigram_signature(traces: DataFrame, a: str, b: str, by: str = "agent", top: int = 5) -> DataFrame:
    """(bigram, side, delta_p, rank): each side's most over-represented transitions."""
    t = _two_sided(_units(traces, S.bigrams(F.col("atoms")), grouping(traces, by)), a, b, None).withColumn("delta_p", F.col("p") - F.col("q"))
    ranked = t.where("delta_p <> 0").withColumn("side", F.when(F.col("delta_p") > 0, a).otherwise(b)).withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy(F.desc(F.abs("delta_p")), "unit")))
    return ranked.where(F.col("rank") <= top).select(F.col("unit").alias("bigram"), "side", "delta_p", "rank")


def bigram_jsd(traces: DataFrame, a: str, b: str, by: str = "agent") -> DataFrame:
    return _two_sided(_units(traces, S.bigrams(F.col("atoms")), grouping(traces, by)), a, b, None).agg(F.sum(jsd_term(F.col("p"), F.col("q"))).alias("jsd_nats"))


def positional_curve(traces: DataFrame, a: str, b: str, by: str = "agent", steps: int = 40, least: int = 10, alphabet: Sequence[str] = CANONICAL) -> DataFrame:
    """(step, jsd_nats) up to the first step that fewer than least trajectories of a side reach."""
    rows = traces.select(grouping(traces, by).alias("side"), F.posexplode(F.slice("atoms", 1, steps)).alias("step", "unit")).where(F.col("side").isin(a, b))
    reach = rows.groupBy("step").agg(*[F.sum((F.col("side") == s).cast("long")).alias(c) for s, c in ((a, "ra"), (b, "rb"))])
    short = reach.where(f"ra < {least} or rb < {least}").agg(F.coalesce(F.min("step"), F.lit(steps)).alias("stop")).withColumn("one", F.lit(1))
    counts = rows.where(F.col("unit").isin(*alphabet)).groupBy("step", "unit").agg(*[F.sum((F.col("side") == s).cast("long")).alias(c) for s, c in ((a, "na"), (b, "nb"))])
    sums = counts.groupBy("step").agg((F.sum("na") + EPS * len(alphabet)).alias("ta"), (F.sum("nb") + EPS * len(alphabet)).alias("tb"), F.count("*").alias("seen"))
    p, q = (F.col("na") + EPS) / F.col("ta"), (F.col("nb") + EPS) / F.col("tb")
    # units that neither side has at a step add a constant each
    rest = (len(alphabet) - F.col("seen")) * jsd_term(F.lit(EPS) / F.col("ta"), F.lit(EPS) / F.col("tb"))
    d = counts.join(sums, "step").groupBy("step", "ta", "tb", "seen").agg(F.sum(jsd_term(p, q)).alias("s")).select("step", (F.col("s") + rest).alias("jsd_nats"))
    return d.withColumn("one", F.lit(1)).join(F.broadcast(short), "one").where("step < stop").select("step", "jsd_nats")


def decile_counts(traces: DataFrame, by: str = "agent") -> DataFrame:
    """(g, decile, atom, n): atoms by tenth of their trajectory."""
    rows = traces.select(grouping(traces, by).alias("g"), F.size("atoms").alias("len"), F.posexplode("atoms").alias("pos", "atom"))
    return rows.groupBy("g", F.least(F.floor(F.col("pos") * 10 / F.col("len")), F.lit(9)).cast("int").alias("decile"), "atom").agg(F.count("*").alias("n"))


def behavior_features(traces: DataFrame) -> DataFrame:
    """Per trajectory: searches first, reads before the first edit, longest edit run, share of early thinking, recovery after errors, alternation of edits and tests."""
    a, n = F.col("atoms"), F.size("atoms")
    early = F.slice(a, F.lit(1), F.greatest(F.lit(1), F.floor(n / 3).cast("int")))
    errors = S.count_of(a, "error")
    places = F.when(n >= 2, F.sequence(F.lit(0), F.greatest(n - 2, F.lit(0)))).otherwise(F.array().cast("array<int>"))
    recovered = F.size(F.filter(places, lambda i: (F.get(a, i) == "error") & (F.get(a, i + 1) != "error")))
    swap = lambda i: ((F.get(a, i) == "edit") & (F.get(a, i + 1) == "run_test")) | ((F.get(a, i) == "run_test") & (F.get(a, i + 1) == "edit"))
    return traces.select(
        "trace_id",
        "agent",
        n.alias("n_steps"),
        (S.first_index(a, "search_repo") < S.first_index(a, "edit")).alias("search_first"),
        S.count_of(S.before_first(a, "edit"), "read_file").alias("reads_before_edit"),
        S.max_run(a, "edit").alias("edit_run_max"),
        F.when(n > 0, S.count_of(early, "think") / F.size(early)).otherwise(0.0).alias("think_early_frac"),
        F.when(errors > 0, recovered / errors).otherwise(0.0).alias("error_recovery_rate"),
        F.when(n >= 2, F.size(F.filter(places, swap)) / (n - 1)).otherwise(0.0).alias("interleave_score"),
    )


def out_of_distribution(traces: DataFrame, by: str = "agent", drop: Sequence[str] = ("think",)) -> DataFrame:
    """(trace_id, g, jsd_bits): divergence of each trajectory's mix from its group's mean mix."""
    rows = traces.select("trace_id", grouping(traces, by).alias("g"), F.filter("atoms", lambda x: ~x.isin(*drop)).alias("atoms")).where(F.size("atoms") > 0)
    own = rows.select("trace_id", "g", F.size("atoms").alias("len"), F.explode("atoms").alias("atom")).groupBy("trace_id", "g", "len", "atom").agg((F.count("*") / F.col("len")).alias("p"))
    n = rows.groupBy("g").agg(F.count("*").alias("members"))
    mean = own.groupBy("g", "atom").agg(F.sum("p").alias("s")).join(n, "g").select("g", "atom", (F.col("s") / F.col("members")).alias("q"))
    # atoms that a trajectory lacks add q / 2 each (in units of log 2)
    shared = own.join(mean, ["g", "atom"]).groupBy("trace_id", "g").agg(F.sum(jsd_term(F.col("p"), F.col("q")) / math.log(2)).alias("s"), F.sum("q").alias("covered"))
    return shared.select("trace_id", "g", F.greatest(F.lit(0.0), F.col("s") + (1 - F.col("covered")) / 2).alias("jsd_bits"))


def nearest_group(traces: DataFrame, by: str = "agent") -> DataFrame:
    """(trace_id, g, nearest, jsd_bits): each trajectory's closest other group's mean mix."""
    rows = traces.select("trace_id", grouping(traces, by).alias("g"), "atoms").where(F.size("atoms") > 0)
    own = rows.select("trace_id", "g", F.size("atoms").alias("len"), F.explode("atoms").alias("atom")).groupBy("trace_id", "g", "len", "atom").agg((F.count("*") / F.col("len")).alias("p"))
    n = rows.groupBy("g").agg(F.count("*").alias("members"))
    mean = own.groupBy("g", "atom").agg(F.sum("p").alias("s")).join(n, "g").select(F.col("g").alias("other"), "atom", (F.col("s") / F.col("members")).alias("q"))
    both = own.join(mean, "atom").where("g <> other").groupBy("trace_id", "g", "other").agg(F.sum(jsd_term(F.col("p"), F.col("q")) / math.log(2) - F.col("p") / 2 - F.col("q") / 2).alias("s"))
    d = both.select("trace_id", "g", "other", F.greatest(F.lit(0.0), F.col("s") + 1).alias("d"))
    best = d.groupBy("trace_id", "g").agg(F.min(F.struct("d", "other")).alias("m"))
    # a trajectory that shares no atom with any other group is at distance 1 of all: the first name stands
    first = n.agg(F.slice(F.array_sort(F.collect_list("g")), 1, 2).alias("names")).withColumn("one", F.lit(1))
    rest = own.select("trace_id", "g").distinct().withColumn("one", F.lit(1)).join(F.broadcast(first), "one")
    other = F.get(F.filter("names", lambda x: x != F.col("g")), F.lit(0))
    return rest.join(best, ["trace_id", "g"], "left").where(other.isNotNull()).select("trace_id", "g", F.coalesce("m.other", other).alias("nearest"), F.coalesce("m.d", F.lit(1.0)).alias("jsd_bits"))


def _lcs(p: list, q: list) -> int:
    """Length of the longest common subsequence; one row of the table is the bits of one number."""
    where: dict = {}
    for k, x in enumerate(p):
        where[x] = where.get(x, 0) | 1 << k
    full = (1 << len(p)) - 1
    v = full
    for x in q:
        u = v & where.get(x, 0)
        v = ((v + u) | (v - u)) & full
    return len(p) - v.bit_count()


def lcs_ratio(a: Column, b: Column) -> Column:
    """Twice the longest common subsequence over the sum of the lengths; 0 where either is empty."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([2 * _lcs(list(p), list(q)) / (len(p) + len(q)) if len(p) and len(q) else 0.0 for p, q in zip(x, y)], dtype=float)

    return run(a, b)


def _smoothed(atoms: Column, alphabet: Sequence[str] = PAIR_ALPHABET) -> Column:
    counts = F.transform(F.array(*map(F.lit, alphabet)), lambda a: F.size(F.filter(atoms, lambda x: x == a)) + F.lit(EPS))
    return F.transform(counts, lambda c: c / F.aggregate(counts, F.lit(0.0), lambda t, x: t + x))


def matched_pairs(traces: DataFrame, a: str, b: str, key: str = "instance_id", outcome_field: str = "resolved") -> DataFrame:
    """Two agents' trajectories of each instance that both have with an outcome: lengths, outcomes, divergence in nats of their smoothed mixes, likeness of their order, stratum.

    An agent's trajectory of an instance is its last one. sodp: the same outcome and a
    divergence of at least the third quartile; dosp: different outcomes and one of at most
    the first.
    """
    won = F.col("metadata")[outcome_field]
    rows = traces.select("trace_id", "agent", "atoms", "_ord", F.col("metadata")[key].alias("k"), F.when(won.isNotNull(), truthy(won)).alias("won")).where("k is not null")
    side = lambda s, p: rows.where(F.col("agent") == s).groupBy("k").agg(F.max_by(F.struct("trace_id", "atoms", "won"), F.struct("_ord", "trace_id")).alias(p))
    both = side(a, "x").join(side(b, "y"), "k").where("x.won is not null and y.won is not null")
    zipped = F.zip_with(_smoothed(F.col("x.atoms")), _smoothed(F.col("y.atoms")), jsd_term)
    pairs = both.select(
        "k", F.col("x.trace_id").alias("trace_a"), F.col("y.trace_id").alias("trace_b"), F.col("x.won").alias("resolved_a"), F.col("y.won").alias("resolved_b"), (F.col("x.won") == F.col("y.won")).alias("same_outcome"),
        F.aggregate(zipped, F.lit(0.0), lambda t, x: t + x).alias("jsd"), lcs_ratio(F.col("x.atoms"), F.col("y.atoms")).alias("lcs_ratio"), F.size("x.atoms").alias("len_a"), F.size("y.atoms").alias("len_b"),
    )
    cuts = pairs.agg(F.percentile("jsd", F.lit(0.25)).alias("q25"), F.percentile("jsd", F.lit(0.75)).alias("q75"))  # one row
    stratum = F.when(F.col("same_outcome") & (F.col("jsd") >= F.col("q75")), "sodp").when(~F.col("same_outcome") & (F.col("jsd") <= F.col("q25")), "dosp").otherwise("")
    one = F.lit(1)
    return pairs.withColumn("one", one).join(F.broadcast(cuts.withColumn("one", one)), "one").withColumn("stratum", stratum).drop("q25", "q75", "one")


def matched_summary(pairs: DataFrame) -> DataFrame:
    """One row of matched_pairs' counts: pairs, outcomes of either side, mean and quartiles of the divergence, strata."""
    n = lambda c: F.sum(F.expr(c).cast("long"))
    return pairs.agg(
        F.count("*").alias("n_matched"), n("resolved_a and resolved_b").alias("n_both_pass"), n("not resolved_a and not resolved_b").alias("n_both_fail"), n("resolved_a and not resolved_b").alias("n_a_only"), n("resolved_b and not resolved_a").alias("n_b_only"),
        F.avg("jsd").alias("mean_jsd"), F.percentile("jsd", F.lit(0.25)).alias("q25_jsd"), F.percentile("jsd", F.lit(0.75)).alias("q75_jsd"), n("stratum = 'sodp'").alias("n_sodp"), n("stratum = 'dosp'").alias("n_dosp"),
    )
