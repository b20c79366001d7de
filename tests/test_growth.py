"""What has to hold for tables that don't fit the driver or a single task."""

import json

from pyspark.sql import functions as F

from tracewright.sources import files


def test_run_folders_are_written_and_read_by_tasks(spark, tmp_path, monkeypatch):
    body = json.dumps({"messages": [{"role": "assistant", "content": "hm"}]})
    rows = spark.createDataFrame([(f"{i}.r1.traj.json", body) for i in ("a b", "c+d", "é%41")] + [("other.txt", "no run")], "name string, value string")
    monkeypatch.setattr(type(rows), "toLocalIterator", None)
    assert files.write_files(rows.repartition(3), f"{tmp_path}/arms/x") == 4
    grades = spark.createDataFrame([("c+d", True)], "instance_id string, resolved boolean")
    got = {r.trace_id: (r.atoms, r.metadata["instance_id"], r.metadata["resolved"]) for r in files.read_run_arm(spark, str(tmp_path), "x", grades).collect()}
    assert got == {"a b.r1": (["think"], "a b", ""), "c+d.r1": (["think"], "c+d", "true"), "é%41.r1": (["think"], "é%41", "")}


def test_every_pair_counts_in_the_decomposition(spark):
    """More than 800 trajectories, against all pairs in numpy."""
    import numpy as np

    from tracewright.operators import summary

    rng = np.random.default_rng(5)
    counts, task = rng.integers(0, 4, (900, 3)) + np.array([1, 0, 0]), rng.integers(0, 3, 900)
    fps = spark.createDataFrame([(f"t{i}", "a", None, [int(x) for x in c], {"task": str(k)}) for i, (c, k) in enumerate(zip(counts, task))], "trace_id string, agent string, `group` string, counts array<long>, metadata map<string,string>")
    p = counts / counts.sum(1, keepdims=True)
    h = lambda x: -(x * np.log2(np.where(x > 0, x, 1))).sum(-1)
    d2 = np.maximum(0, h((p[:, None] + p[None]) / 2) - (h(p)[:, None] + h(p)[None]) / 2) ** 2
    within = sum(d2[np.ix_(task == k, task == k)].sum() / 2 / (task == k).sum() for k in range(3))
    got = summary.variance_decomposition(fps, ["task"]).first().r2
    assert abs(got - (1 - within / (d2.sum() / 2 / 900))) < 1e-9


def test_scores_of_all_prefixes_are_the_expression(spark):
    from tracewright.operators import scoring

    spec = scoring.Spec((scoring.Phase("a", 0.3, ("x", "y"), "edit", 2), scoring.Phase("b", 0.4), scoring.Phase("c", 0.1, ("y",))), (scoring.Penalty("p", 0.2, 1), scoring.Penalty("q", 0.1, forbid_sequence=("x", "x"))))
    atoms = ["x", "x", "y", "edit", "edit", "x", "y", "x", "x"]
    rows = spark.createDataFrame([(atoms[:n],) for n in range(len(atoms) + 1)], "a array<string>")
    want = [r[0] for r in rows.select(spec.clipped(F.col("a")).alias("s"), F.size("a").alias("n")).orderBy("n").collect()]
    assert scoring.prefix_scores(spec, atoms) == want
