"""Study-level measures against plain Python."""

import pytest
from pyspark.sql import functions as F

from tracewright.operators import bpe, studies
from tracewright.sources import files
from tracewright.sources.bridge import SCHEMA


@pytest.fixture(scope="module")
def traces(spark):
    rows = [("a", "x", None, ["edit", "run_test"] * 5, {"resolved": "true", "instance_id": "1"}, 0), ("b", "y", None, ["read_file"] * 10, {"resolved": "false", "instance_id": "1"}, 1), ("c", "y", None, [], {}, 2)]
    return spark.createDataFrame(rows, SCHEMA)


def test_positions_and_tasks(traces):
    assert [r.jsd_bits for r in studies.decile_divergence(traces).collect()] == [1.0] * 10
    mix = {(r.pos, r.atom): r.share for r in studies.rolling_mix(traces.where("trace_id = 'a'"), 4, 5).collect()}
    assert mix == {(4, "edit"): 0.5, (4, "run_test"): 0.5, (9, "edit"): 0.5, (9, "run_test"): 0.5}
    assert studies.pattern_difference(traces, "edit ", "read_file ").first().asDict() == {"both": 0, "only_a": 1, "only_b": 1, "neither": 1}
    assert studies.length_strata(traces).count() == 3


def test_metrics(traces):
    m = studies.trajectory_metrics(traces)
    c = studies.metric_correlations(m, ("length", "entropy", "hhi"))
    assert c.count() == 3 and studies.prune_redundant(c, ("length", "entropy", "hhi"), 2.0) == ["length", "entropy", "hhi"]
    assert sum(r.n for r in studies.outcome_deciles(m, "length").collect()) == 3


def test_patches_and_manifests(spark, tmp_path):
    patch = "--- a/x\n+++ b/src/a.py\n+x\n+++ b/tests/test_a.py\n"
    df = spark.createDataFrame([(patch, True), ("+++ b/tests/test_a.py", False), (None, False)], "patch string, resolved boolean")
    got = df.select(studies.patch_files(F.col("patch")).alias("f"), studies.patch_type(F.col("patch")).alias("t")).collect()
    assert got[0].f == ["src/a.py", "tests/test_a.py"] and [x.t for x in got] == ["both", "test", "none"]
    assert {r.patch_type: r.pass_rate for r in studies.pass_rates(df).collect()}["both"] == 1.0
    assert spark.sql("select 'open src/a.py then b.md' s").select(studies.file_paths(F.col("s")).alias("p")).first().p == ["src/a.py", "b.md"]
    files.write_json(tmp_path / "m.json", files.build_manifest({"a": 1}, ["y", "x"]))
    assert files.read_manifest(tmp_path / "m.json")["instances"] == ["x", "y"]
    files.write_json(tmp_path / "m.json", {**files.build_manifest({"a": 1}, []), "spec": {"a": 2}})
    with pytest.raises(ValueError):
        files.read_manifest(tmp_path / "m.json")


def test_transcripts_and_procedures(spark):
    raw = '{"trace_id":"t","events":[{"type":"user","timestamp":"2024-01-01T00:00:00Z"},{"type":"assistant","timestamp":"2024-01-01T00:03:00Z","message":{"content":[{"type":"tool_use","name":"Read"},{"type":"tool_use","name":"Read"}]}}]}'
    r = studies.transcript_summary(spark.createDataFrame([(raw,)], "s string").select(F.parse_json("s").alias("raw"))).first()
    assert (r.n_user, r.n_tools, r.by_tool, r.minutes) == (1, 2, {"Read": 2}, 3.0)
    v = bpe.Vocabulary(("a", "b"), (("a", "a"), ("a", "b"), ("a▁b", "a▁b")))
    assert studies.primitive_procedures(v) == ["a▁b"]


def test_tasks_and_agents(spark):
    import itertools
    import math

    rows = [("a", "x", ["edit", "edit"], "1", "true"), ("b", "x", ["edit", "run_test"], "1", "false"), ("c", "y", ["run_test"], "1", "true"), ("d", "y", ["run_test"], "1", "true"), ("e", "x", ["run_test"], "2", "true"), ("f", "y", ["edit"], "2", "false"), ("g", "z", [], "3", "true")]
    df = spark.createDataFrame([(i, a, None, t, {"instance_id": k, "resolved": w}, n) for n, (i, a, t, k, w) in enumerate(rows)], SCHEMA)
    fps = bpe.encode(df, bpe.Vocabulary(("edit", "run_test"), ()))

    def dist(t):
        return [t.count(x) / len(t) for x in ("edit", "run_test")] if t else [0.5, 0.5]

    def jsd(p, q):
        part = lambda x, y: x * math.log2(2 * x / (x + y)) if x else 0
        return sum(part(x, y) + part(y, x) for x, y in zip(p, q)) / 2

    mean = lambda ds: [sum(x) / len(ds) for x in zip(*ds)]
    for k in ("1", "2"):
        own = {a: [dist(t) for _, b, t, j, _ in rows if (b, j) == (a, k)] for a in "xy"}
        d = [jsd(p, q) for p, q in itertools.product(own["x"], own["y"])]
        got = {r.k: (r.n_pairs, r.jsd_bits) for r in studies.task_controlled_jsd(fps, "x", "y").collect()}
        assert got[k] == (len(d), pytest.approx(sum(d) / len(d)))
    want = {}
    for k in ("1", "2", "3"):
        reference = mean([dist(t) for _, _, t, j, w in rows if j == k and w == "true"])
        others = {a: [dist(t) for _, b, t, j, _ in rows if b == a and j != k] for a in "xyz"}
        want[k] = min((round(jsd(reference, mean(o)), 9), a) for a, o in others.items() if o)[1]
    assert {r.k: r.agent for r in studies.match_agents(fps).collect()} == want


def test_matched_pairs(spark):
    import random

    from tracewright.operators import compare

    def longest(p, q):
        t = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i in range(len(p)):
            for j in range(len(q)):
                t[i + 1][j + 1] = t[i][j] + 1 if p[i] == q[j] else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    r = random.Random(3)
    atoms = {(a, k): [r.choice(["edit", "read_file", "submit", "think"]) for _ in range(r.randint(0, 70))] for a in "xy" for k in range(12)}
    rows = [(f"{a}{k}", a, None, t, {"instance_id": str(k), "resolved": str(k % 3 == 0 or a == "x").lower()}, 5) for (a, k), t in atoms.items()]
    rows += [("early", "x", None, ["edit"], {"instance_id": "0", "resolved": "true"}, 1), ("open", "x", None, ["edit"], {"instance_id": "50"}, 1), ("open2", "y", None, ["edit"], {"instance_id": "50"}, 1)]
    got = {p.k: p for p in compare.matched_pairs(spark.createDataFrame(rows, SCHEMA), "x", "y").collect()}
    assert set(got) == {str(k) for k in range(12)}
    for k in range(12):
        p, q = atoms["x", k], atoms["y", k]
        assert got[str(k)].lcs_ratio == pytest.approx(2 * longest(p, q) / (len(p) + len(q)) if p and q else 0.0)
        assert got[str(k)].trace_a == f"x{k}" and got[str(k)].same_outcome == (k % 3 == 0)
    assert {p.stratum for p in got.values()} <= {"", "sodp", "dosp"} and any(p.stratum for p in got.values())
