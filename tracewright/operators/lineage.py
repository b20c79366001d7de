"""Procedural differences between a parent's and a child's trajectories."""

from __future__ import annotations

import math
import warnings
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distributions import jsd_term
from .scoring import truthy

AXES = ("vocabulary", "entropy", "conditional")


def project_atoms(traces: DataFrame, projection: dict[str, str] | None = None, exclude: Sequence[str] = ()) -> DataFrame:
    """traces with atoms renamed by a map (others stay) and some left out."""
    atoms = F.col("atoms")
    if projection:
        table = F.create_map(*[F.lit(x) for kv in projection.items() for x in kv])
        atoms = F.transform(atoms, lambda a: F.coalesce(F.try_element_at(table, a), a))
    if exclude:
        atoms = F.filter(atoms, lambda a: ~a.isin(*exclude))
    return traces.withColumn("atoms", atoms)


def _sides(parent: DataFrame, child: DataFrame) -> DataFrame:
    pick = lambda df, s: df.select(F.lit(s).alias("side"), "atoms", "metadata")
    return pick(parent, "parent").unionAll(pick(child, "child"))


def atom_entropy(atoms: Column) -> Column:
    """Entropy (nats) of one trajectory's atoms; 0 for an empty one."""
    n = F.size(atoms)
    share = lambda a: F.size(F.filter(atoms, lambda b: b == a)) / n
    return F.when(n == 0, 0.0).otherwise(F.aggregate(F.array_distinct(atoms), F.lit(0.0), lambda s, a: s - share(a) * F.log(share(a))))


def vocabulary_axis(parent: DataFrame, child: DataFrame) -> DataFrame:
    """One row: Jaccard of the atom sets, and the atoms of one side only."""
    seen = _sides(parent, child).select("side", F.explode("atoms").alias("atom")).distinct()
    per = seen.groupBy("atom").agg(F.max((F.col("side") == "parent").cast("int")).alias("p"), F.max((F.col("side") == "child").cast("int")).alias("c"))
    both, any_ = F.sum(F.col("p") * F.col("c")), F.count("*")
    only = lambda cond: F.array_sort(F.collect_list(F.when(cond, F.col("atom"))))
    return per.agg(F.when(any_ == 0, 1.0).otherwise(both / any_).alias("jaccard"), only(F.col("p") > F.col("c")).alias("parent_only"), only(F.col("c") > F.col("p")).alias("child_only"))


def entropy_axis(parent: DataFrame, child: DataFrame) -> DataFrame:
    """One row: difference of mean entropies (parent minus child), and medians."""
    e = _sides(parent, child).select("side", atom_entropy(F.col("atoms")).alias("h"))
    of = lambda s: F.when(F.col("side") == s, F.col("h"))
    mean = lambda s: F.coalesce(F.avg(of(s)), F.lit(0.0))
    return e.agg((mean("parent") - mean("child")).alias("entropy_drop"), mean("parent").alias("parent_mean"), mean("child").alias("child_mean"), F.percentile(of("parent"), F.lit(0.5)).alias("parent_median"), F.percentile(of("child"), F.lit(0.5)).alias("child_median"))


def transitions(traces: DataFrame, k: int = 1, *by: str) -> DataFrame:
    """(by, prefix, next, n): what follows each k-atom prefix. Pairs are made inside each row, so nothing is shuffled before the counts."""
    if k < 1:
        raise ValueError("the prefix has at least one atom")
    n = F.size("atoms")
    places = F.when(n > k, F.sequence(F.lit(k + 1), F.greatest(n, F.lit(k + 1)))).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(places, lambda i: F.struct(F.array_join(F.slice("atoms", i - k, F.lit(k)), " ").alias("prefix"), F.get(F.col("atoms"), i - 1).alias("next")))
    return traces.select(*by, F.explode(pairs).alias("x")).groupBy(*by, "x.prefix", "x.next").agg(F.count("*").alias("n"))


def conditional_prefixes(parent: DataFrame, child: DataFrame, k: int = 1) -> DataFrame:
    """(prefix, parent_n, child_n, jsd): divergence of next-atom choices per prefix; null where one side lacks it."""
    t = transitions(_sides(parent, child), k, "side")
    wide = t.groupBy("prefix", "next").agg(F.coalesce(F.sum(F.when(F.col("side") == "parent", F.col("n"))), F.lit(0)).alias("p"), F.coalesce(F.sum(F.when(F.col("side") == "child", F.col("n"))), F.lit(0)).alias("c"))
    sums = wide.groupBy("prefix").agg(F.sum("p").alias("parent_n"), F.sum("c").alias("child_n"))
    terms = wide.join(sums, "prefix").where("parent_n > 0 and child_n > 0").groupBy("prefix").agg((F.sum(jsd_term(F.col("p") / F.col("parent_n"), F.col("c") / F.col("child_n"))) / math.log(2)).alias("jsd"))
    return sums.join(terms, "prefix", "left").select("prefix", "parent_n", "child_n", F.greatest("jsd", F.lit(0.0) * F.col("jsd")).alias("jsd"))


def conditional_axis(parent: DataFrame, child: DataFrame, k: int = 1) -> DataFrame:
    """One row: mean divergence over shared prefixes weighted by the parent's frequency (0 and a flag without any)."""
    p = conditional_prefixes(parent, child, k)
    shared = F.col("jsd").isNotNull()
    weight = F.sum(F.when(shared, F.col("parent_n")))
    count = lambda c: F.sum(c.cast("long"))
    return p.agg(
        F.coalesce(F.sum(F.when(shared, F.col("jsd") * F.col("parent_n"))) / weight, F.lit(0.0)).alias("conditional_jsd"),
        F.coalesce(count(shared), F.lit(0)).alias("shared_prefixes"),
        F.coalesce(count(F.col("child_n") == 0), F.lit(0)).alias("parent_only_prefixes"),
        F.coalesce(count(F.col("parent_n") == 0), F.lit(0)).alias("child_only_prefixes"),
    ).withColumn("undefined", F.col("shared_prefixes") == 0)


def outcome_axis(parent: DataFrame, child: DataFrame, outcome_field: str) -> DataFrame:
    """One row: Jaccard of the atom sets among passes and among fails, and the counts."""
    rows = _sides(parent, child).withColumn("won", truthy(F.col("metadata")[outcome_field]))
    counts = rows.agg(*[F.coalesce(F.sum(((F.col("side") == s) & (F.col("won") == w)).cast("long")), F.lit(0)).alias(f"{s}_{'pass' if w else 'fail'}_n") for s in ("parent", "child") for w in (True, False)])
    seen = rows.select("side", "won", F.explode("atoms").alias("atom")).distinct().groupBy("won", "atom").agg(F.count("*").alias("sides"))
    jac = lambda w: F.coalesce(F.sum(((F.col("won") == w) & (F.col("sides") == 2)).cast("double")) / F.nullif(F.sum((F.col("won") == w).cast("double")), F.lit(0.0)), F.lit(1.0))
    both = seen.agg(jac(True).alias("pass_vocab_jaccard"), jac(False).alias("fail_vocab_jaccard"))
    return counts.withColumn("one", F.lit(1)).join(both.withColumn("one", F.lit(1)), "one").drop("one")


def lineage_diff(parent: DataFrame, child: DataFrame, along: Sequence[str] = AXES, *, provenance_field: str | None = None, exclude_atoms: Sequence[str] = (), conditional_context_k: int = 1, canonical_projection: dict[str, str] | None = None, alphabet: str | Sequence[str] = "canonical", outcome_field: str | None = None) -> dict[tuple[str, str], DataFrame]:
    """(alphabet, axis) -> one-row result, alphabets outside and axes inside."""
    if provenance_field:
        warn_on_provenance(parent, child, provenance_field)
    out = {}
    for alpha in [alphabet] if isinstance(alphabet, str) else alphabet:
        use = canonical_projection if alpha == "canonical" else None
        p, c = project_atoms(parent, use, exclude_atoms), project_atoms(child, use, exclude_atoms)
        for axis in along:
            if axis == "vocabulary":
                out[alpha, axis] = vocabulary_axis(p, c)
            elif axis == "entropy":
                out[alpha, axis] = entropy_axis(p, c)
            elif axis == "conditional":
                out[alpha, axis] = conditional_axis(p, c, conditional_context_k)
            elif axis == "outcome_quadrant":
                if outcome_field is None:
                    raise ValueError("the outcome axis needs outcome_field")
                out[alpha, axis] = outcome_axis(p, c, outcome_field)
            else:
                raise ValueError(f"unknown axis {axis!r}")
    return out


def warn_on_provenance(parent: DataFrame, child: DataFrame, key: str) -> None:
    """Warns if the sides' sets of values of a metadata key differ; a side without the key says nothing. All values are compared, the text shows some of them."""
    side = lambda d, s: d.select(F.col("metadata")[key].alias("v"), F.lit(s).alias("side")).where("v is not null").distinct()
    both = side(parent, "parent").unionAll(side(child, "child")).groupBy("v").agg(F.collect_set("side").alias("sides"))
    n = both.agg(*[F.count_if(F.array_contains("sides", s)).alias(s) for s in ("parent", "child")], F.count_if(F.size("sides") == 1).alias("alone")).first()
    if n.parent and n.child and n.alone:
        seen = both.where(F.size("sides") == 1).orderBy("v").limit(10).collect()
        warnings.warn(f"the sides differ in {key!r}: " + ", ".join(f"{r.v!r} in the {r.sides[0]} only" for r in seen), stacklevel=3)


SUMMARY = {"vocabulary": "jaccard", "entropy": "entropy_drop", "conditional": "conditional_jsd", "outcome_quadrant": "pass_vocab_jaccard"}


def summaries(diff: dict[tuple[str, str], DataFrame]) -> list[dict]:
    """Records of a diff: alphabet, axis, summary value and details."""
    return [{"alphabet": a, "axis": x, "summary_value": (r := df.first().asDict())[SUMMARY[x]], "detail": r} for (a, x), df in diff.items()]


def to_markdown(diff: dict[tuple[str, str], DataFrame]) -> str:
    rows = [f"| {r['alphabet']} | {r['axis']} | {r['summary_value']:.4f} |" for r in summaries(diff)]
    return "\n".join(["| alphabet | axis | value |", "|---|---|---|", *rows])


def noise_floor(traces: DataFrame, key: str, along: Sequence[str] = AXES, **options) -> list[dict]:
    """Smallest, mean and largest absolute value of each axis over all pairs of one metadata key's values (few, by design)."""
    names = [r[0] for r in traces.select(F.col("metadata")[key].alias("k")).where("k is not null").distinct().orderBy("k").limit(33).collect()]
    if not 2 <= len(names) <= 32:
        raise ValueError("the key needs from 2 to 32 values")
    values: dict[str, list[float]] = {}
    traces = traces.where(F.col("metadata")[key].isin(names)).select("atoms", "metadata").persist(StorageLevel.MEMORY_AND_DISK_2)  # every pair reads two parts of it
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            of = lambda v: traces.where(F.col("metadata")[key] == v)
            for r in summaries(lineage_diff(of(a), of(b), along, **options)):
                values.setdefault(r["axis"], []).append(abs(r["summary_value"]))
    traces.unpersist()
    return [{"axis": x, "min": min(v), "mean": sum(v) / len(v), "max": max(v), "pairs": len(v)} for x, v in values.items()]
