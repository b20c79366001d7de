"""Study-level measures: positions, correlations, task matching, patches, rolling mixes."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions.distributions import jsd_term
from .bpe import SEPARATOR, Vocabulary, encode, fit_bpe, with_distribution
from .compare import decile_counts
from .divergence import grouping, jsd_matrix
from .lineage import atom_entropy
from .scoring import truthy
from .stats import discriminative_procedures


def decile_divergence(traces: DataFrame, by: str = "agent") -> DataFrame:
    """(decile, row, col, jsd_bits): divergence between groups' mixes in each tenth of the trajectories."""
    n = decile_counts(traces, by)
    p = n.join(n.groupBy("g", "decile").agg(F.sum("n").alias("t")), ["g", "decile"]).select("g", "decile", "atom", (F.col("n") / F.col("t")).alias("p"))
    a = p.select("decile", "atom", F.col("g").alias("row"), "p")
    b = p.select("decile", "atom", F.col("g").alias("col"), F.col("p").alias("q"))
    # atoms that one side lacks add half their share, so only shared ones need to meet
    s = a.join(b, ["decile", "atom"]).where("row < col").groupBy("decile", "row", "col").agg(F.sum(jsd_term(F.col("p"), F.col("q")) / math.log(2) - (F.col("p") + F.col("q")) / 2).alias("s"))
    there = p.select("decile", "g").distinct()
    pairs = there.select("decile", F.col("g").alias("row")).join(there.select("decile", F.col("g").alias("col")), "decile").where("row < col")
    return pairs.join(s, ["decile", "row", "col"], "left").select("decile", "row", "col", F.greatest(F.lit(0.0), 1 + F.coalesce("s", F.lit(0.0))).alias("jsd_bits"))


def rolling_mix(traces: DataFrame, window: int = 40, stride: int = 5) -> DataFrame:
    """(trace_id, pos, atom, share): the mix of the last window actions at every stride-th; batch twin of the stream."""
    n = F.size("atoms")
    ends = F.when(n >= stride, F.sequence(F.lit(stride), F.greatest(n, F.lit(stride)), F.lit(stride))).otherwise(F.array().cast("array<int>"))
    tails = traces.select("trace_id", F.explode(ends).alias("end"), "atoms").select("trace_id", (F.col("end") - 1).cast("long").alias("pos"), F.slice("atoms", F.greatest(F.col("end") - window + 1, F.lit(1)), F.least(F.col("end"), F.lit(window))).alias("tail"))
    return tails.select("trace_id", "pos", "tail", F.explode(F.array_distinct("tail")).alias("atom")).select("trace_id", "pos", "atom", (F.size(F.filter("tail", lambda a: a == F.col("atom"))) / F.size("tail")).alias("share"))


def pattern_difference(traces: DataFrame, a: str, b: str) -> DataFrame:
    """One row: trajectories that both, only one, or neither of two patterns match."""
    s = S.spine(F.col("atoms"))
    x, y = s.rlike(a), s.rlike(b)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return traces.agg(n(x & y).alias("both"), n(x & ~y).alias("only_a"), n(y & ~x).alias("only_b"), n(~x & ~y).alias("neither"))


def trajectory_metrics(traces: DataFrame) -> DataFrame:
    """Per trajectory: length, entropy, distinct share, concentration, longest edit run, outcome (0 or 1)."""
    a, n = F.col("atoms"), F.size("atoms")
    share = lambda x: F.size(F.filter(a, lambda y: y == x)) / n
    hhi = F.when(n > 0, F.aggregate(F.array_distinct(a), F.lit(0.0), lambda s, x: s + share(x) * share(x))).otherwise(0.0)
    return traces.select("trace_id", n.cast("double").alias("length"), atom_entropy(a).alias("entropy"), F.when(n > 0, F.size(F.array_distinct(a)) / n).otherwise(0.0).alias("distinct_share"), hhi.alias("hhi"), S.max_run(a, "edit").cast("double").alias("edit_run"), truthy(F.col("metadata")["resolved"]).cast("double").alias("outcome"))


def metric_correlations(metrics: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(a, b, r): Pearson correlations of all pairs of columns, in one aggregation."""
    pairs = [(x, y) for i, x in enumerate(columns) for y in columns[i + 1 :]]
    one = metrics.agg(*[F.corr(x, y).alias(f"{x}|{y}") for x, y in pairs])
    rows = F.explode(F.array(*[F.struct(F.lit(x).alias("a"), F.lit(y).alias("b"), F.col(f"`{x}|{y}`").alias("r")) for x, y in pairs])).alias("x")
    return one.select(rows).select("x.a", "x.b", "x.r")


def prune_redundant(correlations: DataFrame, columns: tuple[str, ...], limit: float = 0.9) -> list[str]:
    """Columns kept greedily in order: one goes if it correlates by more than limit with a kept one."""
    r = {frozenset((x.a, x.b)): abs(x.r or 0.0) for x in correlations.collect()}
    kept: list[str] = []
    for c in columns:
        if all(r.get(frozenset((c, k)), 0.0) <= limit for k in kept):
            kept.append(c)
    return kept


def outcome_deciles(metrics: DataFrame, column: str, label: str = "outcome", buckets: int = 10) -> DataFrame:
    """(bucket, n, rate): outcome rate by quantile bucket of a metric."""
    edges = metrics.agg(F.percentile(column, F.array(*[F.lit(i / buckets) for i in range(1, buckets)])).alias("edges")).withColumn("one", F.lit(1))
    rows = metrics.withColumn("one", F.lit(1)).join(F.broadcast(edges), "one")
    bucket = F.size(F.filter("edges", lambda e: e < F.col(column)))
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"), F.avg(label).alias("rate"))


def match_agents(fps: DataFrame, key: str = "instance_id", outcome_field: str = "resolved") -> DataFrame:
    """(k, agent, jsd_bits): for each task the agent whose mean distribution over its other tasks is closest to that of the task's successes; ties by name.

    An agent's mean without a task is its total less the task's part, so every trajectory
    is read once.
    """
    rows = with_distribution(fps).select("agent", F.col("metadata")[key].alias("k"), truthy(F.col("metadata")[outcome_field]).alias("won"), "distribution")
    long = rows.select("agent", "k", "won", F.posexplode("distribution").alias("t", "p"))
    task = long.where("won and k is not null").groupBy("k", "t").agg(F.avg("p").alias("p"))
    part = long.groupBy("agent", "k", "t").agg(F.sum("p").alias("s"), F.count("*").alias("n"))
    whole = part.groupBy("agent", "t").agg(F.sum("s").alias("all"), F.sum("n").alias("m"))
    own = part.select("agent", F.col("k").alias("k"), "t", "s", "n")
    met = task.join(whole, "t").join(own, ["agent", "k", "t"], "left")
    rest = F.col("m") - F.coalesce("n", F.lit(0))
    q = (F.col("all") - F.coalesce("s", F.lit(0.0))) / rest
    # what is left of a subtraction where nothing is may be a hair off 0
    q = F.when(F.abs(q) < 1e-12, 0.0).otherwise(q)
    d = met.where(rest > 0).groupBy("k", "agent").agg(F.greatest(F.lit(0.0), F.sum(jsd_term(F.col("p"), q)) / math.log(2)).alias("d"))
    return d.groupBy("k").agg(F.min(F.struct(F.round("d", 9).alias("r"), "agent", "d")).alias("m")).select("k", "m.agent", F.col("m.d").alias("jsd_bits"))


def task_controlled_jsd(fps: DataFrame, a: str, b: str, key: str = "instance_id") -> DataFrame:
    """(k, n_pairs, jsd_bits): mean divergence over all pairs of two agents' trajectories of each task that both did. Equal distributions of a task are paired once, with their number."""
    rows = with_distribution(fps).where(F.col("agent").isin(a, b)).select("agent", F.col("metadata")[key].alias("k"), "distribution").where("k is not null")
    side = lambda s, p, n: rows.where(F.col("agent") == s).groupBy("k", F.col("distribution").alias(p)).agg(F.count("*").alias(n))
    pairs = side(a, "p", "na").join(side(b, "q", "nb"), "k")
    d = F.aggregate(F.zip_with("p", "q", jsd_term), F.lit(0.0), lambda t, x: t + x) / math.log(2)
    w = F.col("na") * F.col("nb")
    return pairs.withColumn("d", F.greatest(F.lit(0.0), d)).groupBy("k").agg(F.sum(w).alias("n_pairs"), (F.sum(F.col("d") * w) / F.sum(w)).alias("jsd_bits"))


def primitive_procedures(vocab: Vocabulary) -> list[str]:
    """Merged tokens that aren't a shorter token repeated."""
    out = []
    for t in vocab.tokens()[len(vocab.atoms) :]:
        parts = t.split(SEPARATOR)
        n = len(parts)
        if not any(n % k == 0 and parts == parts[:k] * (n // k) for k in range(1, n)):
            out.append(t)
    return out


def explore_compare(traces: DataFrame, a: str, b: str, by: str = "agent", vocab_size: int = 200, top: int = 10) -> dict[str, DataFrame]:
    """The explorer's comparison of two sides: discriminative procedures, divergence, medians."""
    rows = traces.withColumn("side", grouping(traces, by)).where(F.col("side").isin(a, b))
    vocab = fit_bpe(rows, vocab_size)
    fps = encode(rows, vocab)
    return {
        "procedures": discriminative_procedures(fps, vocab, a, b, top, group_by=by),
        "divergence": jsd_matrix(fps, by, mode="micro"),
        "medians": rows.groupBy("side").agg(F.percentile(F.size("atoms"), F.lit(0.5)).alias("median_length"), F.percentile(S.count_of(F.col("atoms"), "think"), F.lit(0.5)).alias("median_think")),
    }


# ---------------------------------------------------------------- files and patches
def file_paths(text: Column) -> Column:
    """Paths with an extension that an action's text names, each once."""
    return F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\w./-]*\w\.(?:py|js|ts|java|go|rs|rb|c|h|cpp|md|txt|json|yml|yaml|toml|cfg))\b"), 1))


def patch_files(patch: Column) -> Column:
    """Files that a unified diff writes."""
    lines = F.filter(F.split(F.coalesce(patch, F.lit("")), "\n"), lambda x: x.startswith("+++ b/"))
    return F.transform(lines, lambda x: F.substring(x, 7, 1 << 20))


def patch_type(patch: Column) -> Column:
    """none, test, source or both, by the names of the files written."""
    files = patch_files(patch)
    test = F.exists(files, lambda f: f.rlike(r"(^|/)tests?(/|_)|(^|/)test_|_test\."))
    source = F.exists(files, lambda f: ~f.rlike(r"(^|/)tests?(/|_)|(^|/)test_|_test\."))
    return F.when(test & source, "both").when(test, "test").when(source, "source").otherwise("none")


def pass_rates(df: DataFrame, patch: str = "patch", outcome: str = "resolved") -> DataFrame:
    return df.groupBy(patch_type(F.col(patch)).alias("patch_type")).agg(F.count("*").alias("n"), F.avg(F.col(outcome).cast("double")).alias("pass_rate"))


def cluster_tasks(texts: DataFrame, embedder: Callable[[DataFrame], DataFrame], k: int = 8, seed: int = 0) -> DataFrame:
    """texts with cluster: embedder adds the column embedding (array of numbers)."""
    from .learn import cluster_vectors

    return cluster_vectors(embedder(texts), "embedding", k, seed)


def shareable(traces: DataFrame) -> DataFrame:
    """What may leave a machine: hashed ids, atoms and counts."""
    from ..sources.adapters import anonymous_id

    return traces.select(anonymous_id(F.col("trace_id")).alias("trace_id"), "agent", "atoms", F.size("atoms").alias("n_atoms"))


def transcript_summary(records: DataFrame) -> DataFrame:
    """Per transcript record: prompts, tool calls in all and by tool, minutes from the first to the last event; counts only."""
    from ..sources.adapters import get, items

    raw = F.col("raw")
    lines = records.select(get(raw, "$.trace_id").alias("trace_id"), F.explode(items(raw, "$.events")).alias("e"))
    blocks = items(F.col("e"), "$.message.content")
    tools = F.transform(F.filter(blocks, lambda b: get(b, "$.type") == "tool_use"), lambda b: F.coalesce(get(b, "$.name"), F.lit("")))
    rows = lines.select("trace_id", (get(F.col("e"), "$.type") == "user").alias("is_user"), tools.alias("tools"), F.try_to_timestamp(get(F.col("e"), "$.timestamp")).alias("ts"))
    per_tool = rows.select("trace_id", F.explode("tools").alias("tool")).groupBy("trace_id", "tool").agg(F.count("*").alias("n"))
    counts = per_tool.groupBy("trace_id").agg(F.sum("n").alias("n_tools"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("by_tool"))
    heads = rows.groupBy("trace_id").agg(F.sum(F.coalesce(F.col("is_user"), F.lit(False)).cast("long")).alias("n_user"), (F.unix_seconds(F.max("ts")) - F.unix_seconds(F.min("ts"))).alias("seconds"))
    return heads.join(counts, "trace_id", "left").select("trace_id", "n_user", F.coalesce("n_tools", F.lit(0)).alias("n_tools"), "by_tool", F.round(F.col("seconds") / 60, 1).alias("minutes"))


def length_strata(traces: DataFrame, by: str = "agent", picks: int = 30) -> DataFrame:
    """A report's stack: at most picks trajectories per group, evenly spread over its lengths."""
    w = Window.partitionBy("g").orderBy("n", "trace_id")
    rows = traces.select(grouping(traces, by).alias("g"), "trace_id", F.size("atoms").alias("n"))
    r = rows.withColumn("i", F.row_number().over(w) - 1).join(rows.groupBy("g").agg(F.count("*").alias("m")), "g")
    slot = F.floor(F.col("i") * picks / F.col("m"))
    before = F.floor((F.col("i") - 1) * picks / F.col("m"))
    return r.where((F.col("i") == 0) | (slot != before)).select("g", "trace_id", "n")
