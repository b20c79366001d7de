"""Probes and clusters on pyspark.ml, and paired measurement of two arms."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .curate import divergences
from .bpe import Vocabulary, encode, with_distribution
from .divergence import grouping
from .scoring import Spec, truthy


def leave_one_group_out(fps: DataFrame, label_field: str = "agent", group_field: str = "group", classifier=None) -> dict:
    """For each group left out of the fit: accuracy of predicting the label, and how often each label was predicted (groups and labels are few)."""
    rows = with_distribution(fps).select(grouping(fps, label_field).alias("label_name"), grouping(fps, group_field).alias("fold"), array_to_vector("distribution").alias("features")).persist()
    folds = [r[0] for r in rows.select("fold").distinct().orderBy("fold").collect()]
    classes = rows.select("label_name").distinct().count()
    if len(folds) < 2 or classes < 2:
        raise ValueError("a probe needs two groups and two classes at least")
    indexed = StringIndexer(inputCol="label_name", outputCol="label", stringOrderType="alphabetAsc").fit(rows).transform(rows)
    names = [r[0] for r in rows.select("label_name").distinct().orderBy("label_name").collect()]
    accuracy, confusion = {}, {}
    for f in folds:
        fit, test = indexed.where(F.col("fold") != f), indexed.where(F.col("fold") == f)
        n = fit.count()
        model = (classifier() if classifier else LogisticRegression(family="multinomial", regParam=1 / max(1, n), standardization=False, maxIter=200)).fit(fit)
        seen = model.transform(test).groupBy("label", "prediction").agg(F.count("*").alias("n")).collect()
        accuracy[f] = sum(r.n for r in seen if r.label == r.prediction) / sum(r.n for r in seen)
        confusion[f] = {}
        for r in seen:
            name = names[int(r.prediction)]
            confusion[f][name] = confusion[f].get(name, 0) + r.n
    rows.unpersist()
    return {"accuracy": sum(accuracy.values()) / len(accuracy), "by_group": accuracy, "confusion": confusion, "n_classes": classes}


def cluster_vectors(df: DataFrame, column: str = "embedding", k: int = 8, seed: int = 0, starts: int = 10) -> DataFrame:
    """df with cluster: the cheapest of several seeded k-means fits."""
    if k < 2:
        raise ValueError("k is 2 at least")
    rows = df.withColumn("features", array_to_vector(F.col(column).cast("array<double>"))).persist()
    best = min((KMeans(k=k, seed=seed + s).fit(rows) for s in range(starts)), key=lambda m: m.summary.trainingCost)
    return best.transform(rows).withColumnRenamed("prediction", "cluster").drop("features")


def outcome_probe(features: DataFrame, columns: list[str], label: str, folds: int = 5, seed: int = 0) -> float:
    """Mean area under the curve of a standardised logistic regression, by seeded folds."""
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    rows = features.select(F.array(*[F.col(c).cast("double") for c in columns]).alias("x"), F.col(label).cast("double").alias("label"), F.pmod(F.xxhash64(F.lit(seed), *columns), F.lit(folds)).alias("fold")).withColumn("features", array_to_vector("x")).persist()
    got = []
    for f in range(folds):
        fit, test = rows.where(F.col("fold") != f), rows.where(F.col("fold") == f)
        if fit.select("label").distinct().count() == 2 and test.select("label").distinct().count() == 2:
            got.append(BinaryClassificationEvaluator().evaluate(LogisticRegression(regParam=0.01).fit(fit).transform(test)))
    rows.unpersist()
    return sum(got) / len(got) if got else float("nan")


MOST_POINTS = 1_000_000


def umap_project(fps: DataFrame, *, granularity: str = "trace", by: str = "group", n_neighbors: int = 15, min_dist: float = 0.25, metric: str = "cosine", seed: int = 0) -> DataFrame:
    """(label, x, y): two coordinates for each trajectory, or for each group's mean distribution.

    The package umap works on one machine's memory, so at most MOST_POINTS points are
    gathered, which is checked; group means are computed by Spark.
    """
    d = with_distribution(fps)
    if granularity == "group":
        long = d.select(grouping(fps, by).alias("label"), F.posexplode("distribution").alias("t", "p")).groupBy("label", "t").agg(F.avg("p").alias("p"))
        points = long.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "p"))), lambda x: x["p"]).alias("distribution"))
    elif granularity == "trace":
        points = d.select(F.col("trace_id").alias("label"), "distribution")
    else:
        raise ValueError(f"unknown granularity {granularity!r}")
    got = points.orderBy("label").limit(MOST_POINTS + 1).collect()
    if len(got) > MOST_POINTS:
        raise ValueError(f"more than {MOST_POINTS} points; project group means")
    if n_neighbors >= len(got):
        raise ValueError(f"n_neighbors={n_neighbors} must be less than the number of points ({len(got)})")
    from umap import UMAP  # optional

    xy = np.asarray(UMAP(n_neighbors=n_neighbors, min_dist=min_dist, metric=metric, random_state=seed, n_components=2).fit_transform(np.array([r.distribution for r in got])), float)
    return fps.sparkSession.createDataFrame([(r.label, float(x), float(y)) for r, (x, y) in zip(got, xy)], "label string, x double, y double")


def paired_bootstrap(before: DataFrame, after: DataFrame, spec: Spec, vocab: Vocabulary, n_boot: int = 1000, seed: int = 0, key: str = "instance_id", outcome_field: str = "resolved") -> dict:
    """Bootstrap intervals of the change in divergence from the target and in the resolved rate over instances that both arms have.

    Spark sums each instance's counts and outcomes; a resample is then a weighted sum of
    those rows (at most a run's instances, checked), which gives what verifying the
    resampled trajectories would.
    """
    if spec.target is None:
        raise ValueError("the spec has no target")

    def sums(df: DataFrame) -> dict:
        e = encode(df, vocab).withColumn("k", F.col("metadata")[key]).where("k is not null")
        per = e.groupBy("k").agg(F.count("*").alias("n"), F.sum(truthy(F.col("metadata")[outcome_field]).cast("long")).alias("won"), *[F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(vocab.size)])
        got = per.limit(100_001).collect()
        if len(got) > 100_000:
            raise ValueError("a run has too many instances")
        return {r.k: (r.n, r.won, np.array([r[f"c{i}"] for i in range(vocab.size)], float)) for r in got}

    a, b = sums(before), sums(after)
    ids = sorted(set(a) & set(b))
    if not ids:
        raise ValueError("the arms share no instance")
    target = np.array(spec.target, float)
    target = target / target.sum() if target.sum() else np.full(len(target), 1 / len(target))

    def gap(side: dict, w: np.ndarray) -> tuple[float, float]:
        c = sum(x * side[i][2] for x, i in zip(w, ids))
        p = c / c.sum() if c.sum() else np.full(len(c), 1 / len(c))
        d = float(divergences(p[None, :], target)[0])
        n = sum(x * side[i][0] for x, i in zip(w, ids))
        return d, float(sum(x * side[i][1] for x, i in zip(w, ids)) / n) if n else 0.0

    rng = np.random.default_rng(seed)
    draws = []
    for w in [np.ones(len(ids)), *(np.bincount(rng.integers(0, len(ids), len(ids)), minlength=len(ids)) for _ in range(n_boot))]:
        (da, ra), (db, rb) = gap(a, w), gap(b, w)
        draws.append((da - db, rb - ra))
    boot = np.sort(np.array(draws[1:]), axis=0) if n_boot else np.array(draws)
    rank = lambda q: min(len(boot) - 1, max(0, int(np.ceil(q * len(boot))) - 1))
    ci = lambda j: (float(boot[rank(0.025), j]), float(boot[rank(0.975), j]))
    return {"n_instances": len(ids), "behavior_move": draws[0][0], "behavior_ci": ci(0), "outcome_delta": draws[0][1], "outcome_ci": ci(1)}
