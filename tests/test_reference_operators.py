"""Trajectory operators against plain Python."""

import collections
import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions import distributions as D
from tracewright.functions import sequences as S
from tracewright.operators import bpe, cliffs, curate, divergence, floor, learn, lineage, patterns, scoring, stats, summary
from tracewright.sources import adapters, files, ingest
from tracewright.sources.bridge import SCHEMA
from tracewright.streaming import monitors


def traces(spark, rows):
    """rows: (id, agent, group, atoms, metadata)."""
    return spark.createDataFrame([(i, a, g, list(x), m, k) for k, (i, a, g, x, m) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def corpus():
    r = random.Random(7)
    out = []
    for k in range(24):
        weights = [6, 6, 1, 1, 1] if k % 2 else [1, 1, 6, 6, 1]
        atoms = r.choices("edit run_test search_repo read_file submit".split(), weights, k=r.randint(4, 25))
        out.append((f"t{k}", f"agent_{k % 2}", f"g{k % 3}", atoms, {"resolved": str(bool(k % 4 == 1)).lower(), "instance_id": f"i{k // 2}", "steps": str(len(atoms))}))
    return out


def py_bpe(seqs, size, least=2):
    seqs = [list(s) for s in seqs]
    atoms = sorted({a for s in seqs for a in s})
    merges = []
    while len(atoms) + len(merges) < size:
        c = collections.Counter(p for s in seqs for p in zip(s, s[1:]))
        if not c or max(c.values()) < least:
            break
        pair = min(c, key=lambda p: (-c[p], p))
        merges.append(pair)
        for k, s in enumerate(seqs):
            i, new = 0, []
            while i < len(s):
                if tuple(s[i : i + 2]) == pair:
                    new.append(bpe.SEPARATOR.join(pair))
                    i += 2
                else:
                    new.append(s[i])
                    i += 1
            seqs[k] = new
    return atoms, merges, seqs


def py_jsd(p, q, base=2):
    m = [(a + b) / 2 for a, b in zip(p, q)]
    kl = lambda x: sum(a * math.log(a / b) for a, b in zip(x, m) if a > 0)
    return (kl(p) + kl(q)) / 2 / math.log(base)


def test_bpe_fit_encode_and_json(spark, corpus, tmp_path):
    t = traces(spark, corpus)
    v = bpe.fit_bpe(t, 14)
    atoms, merges, seqs = py_bpe([x[3] for x in corpus], 14)
    assert list(v.atoms) == atoms and list(v.merges) == merges
    got = {r.trace_id: r.counts for r in bpe.encode(t, v).collect()}
    for (i, *_), s in zip(corpus, seqs):
        assert got[i] == [s.count(x) for x in v.tokens()]
    v.save(tmp_path / "v.json")
    w = bpe.Vocabulary.load(tmp_path / "v.json")
    assert w == v and w.spec == v.spec and " + " in v.tree()
    with pytest.raises(ValueError):
        bpe.fit_bpe(t, 3)
    toks = {r.trace_id: r.tokens for r in bpe.tokenize(t, v).collect()}
    assert [toks[i[0]] for i in corpus] == seqs


def test_empty_trajectories_are_uniform(spark):
    t = traces(spark, [("a", "x", None, [], {}), ("b", "x", None, ["edit"], {})])
    v = bpe.Vocabulary(("edit", "think"))
    d = {r.trace_id: r.distribution for r in bpe.with_distribution(bpe.encode(t, v)).collect()}
    assert d["a"] == [0.5, 0.5] and d["b"] == [1.0, 0.0]
    z = {r.trace_id: r.distribution for r in bpe.with_distribution(bpe.encode(t, v), False).collect()}
    assert z["a"] == [0.0, 0.0]


def test_jsd_axioms(spark):
    r = np.random.default_rng(0)
    rows = [(list(map(float, r.dirichlet(np.ones(5)))), list(map(float, r.dirichlet(np.ones(5))))) for _ in range(20)] + [([1.0, 0.0], [0.0, 1.0]), ([1.0, 0.0], [1.0, 0.0])]
    df = spark.createDataFrame(rows, "p array<double>, q array<double>")
    got = df.select(D.jsd(F.col("p"), F.col("q")).alias("a"), D.jsd(F.col("q"), F.col("p")).alias("b")).collect()
    for (p, q), x in zip(rows, got):
        assert x.a == pytest.approx(py_jsd(p, q)) and x.a == pytest.approx(x.b) and 0 <= x.a <= 1 + 1e-12
    assert got[-2].a == pytest.approx(1) and got[-1].a == 0
    bad = spark.createDataFrame([([-1.0, 2.0], [0.0, 1.0])], "p array<double>, q array<double>")
    with pytest.raises(Exception, match="finite"):
        bad.select(D.jsd_checked(F.col("p"), F.col("q"))).collect()


def test_jsd_matrix_and_guard(spark, corpus):
    t = traces(spark, corpus)
    v = bpe.fit_bpe(t, 12)
    fps = bpe.encode(t, v)
    names, grid = divergence.dense(divergence.jsd_matrix(fps, "agent"))
    d = {r.trace_id: r.distribution for r in bpe.with_distribution(fps).collect()}
    mean = lambda a: np.mean([d[i] for i, x, *_ in corpus if x == a], axis=0)
    assert grid[0][1] == pytest.approx(py_jsd(mean("agent_0"), mean("agent_1"))) and grid[0][0] == 0 and grid[0][1] == grid[1][0]
    with pytest.raises(ValueError):
        divergence.jsd_matrix(fps.withColumn("vocab_spec", F.col("trace_id")))
    top = stats.discriminative_procedures(fps, v, "agent_0", "agent_1", 3, group_by="agent").collect()
    assert len(top) == 3 and len({x.token for x in top}) == 3


def test_sequence_expressions(spark):
    rows = [["edit", "edit", "run_test", "edit"], [], ["a"], ["run_test", "submit", "edit", "edit", "edit"], ["x", "prompt_ai", "y", "z", "prompt_ai", "prompt_ai", "w"]]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "k int, a array<string>")
    a = F.col("a")
    got = df.select(S.max_run(a, "edit").alias("m"), S.trailing_run(a, "edit").alias("t"), S.contains_seq(a, ["edit", "run_test"]).alias("c"), S.first_index(a, "edit").alias("f"), S.segments(a, "prompt_ai").alias("s"), S.ends_with(a, ["edit", "edit"]).alias("e"), S.bigrams(a).alias("b"), S.after_first(a, "submit").alias("z"), S.spine(a).alias("sp")).collect()
    assert [x.m for x in got] == [2, 0, 0, 3, 0] and [x.t for x in got] == [1, 0, 0, 3, 0] and [x.c for x in got] == [True, False, False, False, False]
    assert [x.f for x in got] == [0, 0, 1, 2, 7] and got[4].s == [1, 2, 1] and got[1].s == [] and [x.e for x in got] == [False, False, False, True, False]
    assert got[0].b == ["edit|edit", "edit|run_test", "run_test|edit"] and got[2].b == [] and got[3].z == ["edit"] * 3 and got[1].sp == " "


def test_patterns(spark, corpus, tmp_path):
    t = traces(spark, corpus)
    (tmp_path / "r.yaml").write_text("rules:\n  - {name: a, pattern: '(edit ){2,}', must_hold: false}\n  - {name: b, pattern: 'run_test .* submit'}\n")
    rules = patterns.load_patterns(tmp_path / "r.yaml")
    import re

    got = {r.rule: r.fails for r in patterns.match_patterns(t, rules).collect()}
    for p in rules:
        assert got[p.name] == sum(bool(re.search(p.pattern, " ".join(x[3]) + " ")) != p.must_hold for x in corpus)
    assert patterns.violations(t, rules).count() == sum(got.values())
    with pytest.raises(ValueError):
        patterns.ask("what is love")
    (tmp_path / "bad.yaml").write_text("rules: {}")
    with pytest.raises(TypeError):
        patterns.load_patterns(tmp_path / "bad.yaml")


SPEC = scoring.Spec((scoring.Phase("v", 0.4, ("run_test",)), scoring.Phase("x", 0.3, ("read_file", "search_repo"), "edit")), (scoring.Penalty("s", 0.5, 2), scoring.Penalty("f", 0.2, forbid_sequence=("edit", "submit"))))


def py_score(a):
    e = a.index("edit") if "edit" in a else len(a)
    run = best = 0
    for x in a:
        run = run + 1 if x == "edit" else 0
        best = max(best, run)
    return 0.4 * ("run_test" in a) + 0.3 * bool({"read_file", "search_repo"} & set(a[:e])) - 0.5 * (best > 2) - 0.2 * any(a[i : i + 2] == ["edit", "submit"] for i in range(len(a)))


def test_scoring(spark, corpus, tmp_path):
    rows = [*corpus, ("e", "z", None, [], {})]
    t = traces(spark, rows)
    got = {r.trace_id: r for r in SPEC.score(t).collect()}
    for i, _, _, a, _ in rows:
        assert got[i].raw == pytest.approx(py_score(a), abs=1e-4) and got[i].score == pytest.approx(max(0, min(1, py_score(a))), abs=1e-4)
    steps = {r.trace_id: r.s for r in t.select("trace_id", scoring.step_rewards(SPEC, F.col("atoms")).alias("s")).collect()}
    for i, *_ in rows:
        assert sum(steps[i]) == pytest.approx(got[i].score - 0.0, abs=1e-3)
    lib = scoring.Library(tmp_path)
    lib.save(SPEC)
    assert SPEC.name in lib and lib.load("spec").to_dict() == SPEC.to_dict() and len(lib) == 1
    with pytest.raises(ValueError):
        scoring.Spec.from_dict({"phasez": []})
    assert "swe" not in scoring.enforce(SPEC) and scoring.enforce(SPEC, "prompt", "openhands").startswith("---")
    allowed = t.select(scoring.allowed_next(SPEC, F.array(F.lit("edit"), F.lit("edit"))).alias("x")).first().x
    assert "edit" not in allowed and "submit" not in allowed and "run_test" in allowed


def test_derive_verify_tune_bootstrap(spark, corpus):
    t = traces(spark, corpus)
    v = bpe.fit_bpe(t, 10)
    s = scoring.Spec.from_winners(t, v)
    won = [x for x in corpus if x[4]["resolved"] == "true"]
    assert sum(s.target) == sum(sum(r.counts) for r in bpe.encode(traces(spark, won), v).collect())
    r = scoring.verify(t.where("agent = 'agent_0'"), t.where("agent = 'agent_1'"), s, v).first()
    assert r.verdict == "lever" and r.jsd_after < r.jsd_before
    best, report = scoring.optimize(SPEC, t)
    assert report["n_candidates"] >= 6 and len(best.phases) >= 1
    b = learn.paired_bootstrap(t.where("agent = 'agent_0'"), t.where("agent = 'agent_1'"), s, v, n_boot=50)
    assert b["n_instances"] == 12 and b["behavior_move"] == pytest.approx(r.jsd_before - r.jsd_after) and b["behavior_ci"][0] <= b["behavior_move"] <= b["behavior_ci"][1]


def test_lineage(spark, corpus):
    t = traces(spark, corpus)
    p, c = t.where("agent = 'agent_0'"), t.where("agent = 'agent_1'")
    d = {r["axis"]: r for r in lineage.summaries(lineage.lineage_diff(p, c, (*lineage.AXES, "outcome_quadrant"), outcome_field="resolved"))}
    assert d["vocabulary"]["summary_value"] == 1.0 and 0 < d["conditional"]["summary_value"] < 1
    tables = [collections.defaultdict(collections.Counter) for _ in range(2)]
    for _, a, _, x, _ in corpus:
        for q, n in zip(x, x[1:]):
            tables[a == "agent_1"][q][n] += 1
    num = den = 0
    for q in set(tables[0]) & set(tables[1]):
        keys = sorted(set(tables[0][q]) | set(tables[1][q]))
        vec = [[s[q][k] / sum(s[q].values()) for k in keys] for s in tables]
        num += py_jsd(*vec) * sum(tables[0][q].values())
        den += sum(tables[0][q].values())
    assert d["conditional"]["summary_value"] == pytest.approx(num / den)
    with pytest.raises(ValueError):
        lineage.lineage_diff(p, c, ("zzz",))


def test_curation_is_the_sequential_result(spark, corpus):
    t = traces(spark, [*corpus, ("dup", "agent_0", "g0", corpus[0][3], {})])
    c = curate.curate(t, 10, near_dup_jsd=0.1)
    v = bpe.fit_bpe(t, 10)
    rows = curate.numbered(t)
    d = bpe.with_distribution(bpe.encode(rows, v), False).join(rows.select("trace_id", "idx"), "trace_id")
    m = np.stack([np.array(x.distribution) for x in d.orderBy("idx").collect()])
    reps = []
    for i in range(len(m)):
        if not reps or curate.divergences(m[reps], m[i]).min() >= 0.1:
            reps.append(i)
    assert c.n_near_clusters == len(reps) and c.n_exact_unique == 24 and c.n_traces == 25
    assert curate.near_clusters(d, 0.1, block=4) == reps
    far = curate.farthest_point(d, 6, 25)
    keep, curate.DRIVER_CELLS = curate.DRIVER_CELLS, 0
    try:
        assert curate.farthest_point(d, 6, 25) == far
    finally:
        curate.DRIVER_CELLS = keep


def test_floor_is_seeded_numpy(spark, corpus):
    t = traces(spark, corpus)
    v = bpe.fit_bpe(t, 8)
    got = {(r.cell, r.n): r["mean"] for r in floor.floor_points(t, "agent", v, seed=3, n_draws=20).collect()}
    d = {r.trace_id: np.array(r.distribution) for r in bpe.with_distribution(bpe.encode(t, v)).collect()}
    m = np.stack([d[x[0]] for x in corpus if x[1] == "agent_1"])
    rng = np.random.default_rng([3, floor.cell_key("agent_1"), 5])
    draws = []
    for _ in range(20):
        k = rng.choice(len(m), 10, replace=False)
        draws.append(py_jsd(m[k[:5]].mean(0), m[k[5:]].mean(0)))
    assert got["agent_1", 5] == pytest.approx(np.mean(draws)) and floor.size_grid(30) == [5, 10, 25, 30]
    with pytest.raises(ValueError):
        floor.measure_floor(t.limit(3), "agent")


def test_summary(spark):
    t = traces(spark, [("a", "x", None, ["e", "prompt_ai", "e", "e"], {"k": "1"}), ("b", "x", None, ["e", "e", "e"], {"k": "3"}), ("c", "x", None, ["prompt_ai"], {"q": "z"})])
    r = summary.autonomy_runlength(t).first()
    assert (r.n_runs, r["mean"], r["median"], r["max"]) == (3, 2.0, 2.0, 3)
    d = summary.summary_diff(t.where("trace_id = 'a'"), t.where("trace_id = 'b'")).collect()
    assert [(x.key, x.delta) for x in d] == [("k", 2.0)]
    assert summary.drift(t).where("group = 'late' and trace_id like 'b%'").first().atoms == ["e"]


def test_cliffs_batch_equals_stream(spark, tmp_path):
    atoms = ["search_repo", "read_file"] * 12 + ["edit", "run_test"] * 12
    t = traces(spark, [("a", "x", None, atoms, {}), ("b", "x", None, ["edit"] * 5, {})])
    batch = {(r.trace_id, r["index"]) for r in cliffs.detect_cliffs(t).collect()}
    assert any(abs(i - 24) <= 4 for _, i in batch) and not any(k == "b" for k, _ in batch)
    rows = [("a", k, x) for k, x in enumerate(atoms)]
    for part in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{part}.json").write_text("".join(json.dumps(dict(zip(("trace_id", "seq", "atom"), r))) + "\n" for r in rows[part * 16 : part * 16 + 16]))
    stream = spark.readStream.schema("trace_id string, seq long, atom string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert {(r.trace_id, r["index"]) for r in run(monitors.stream_cliffs(stream), "cliffs_out")} == batch
    acts = run(monitors.stream_guard(stream, scoring.Spec((), (scoring.Penalty("f", 1.0, forbid_sequence=("run_test", "edit")),))), "guard_out")
    assert len(acts) == 48 and sum(r.verdict == "block" for r in acts) >= 1
    fired = run(monitors.stream_first_firing(stream, "edit run_test "), "fire_out")
    twin = monitors.first_firing(t.where("trace_id = 'a'"), "edit run_test ").collect()
    assert [(r.trace_id, r.step) for r in fired] == [(r.trace_id, r.step) for r in twin] == [("a", 25)]


def test_streams_put_late_files_in_order(spark, tmp_path):
    atoms = ["search_repo", "read_file"] * 12 + ["edit", "run_test"] * 12
    t = traces(spark, [("a", "x", None, atoms, {})])
    (tmp_path / "in").mkdir()
    # the last actions come first, and some come twice
    for k, (lo, hi) in enumerate(((30, 48), (0, 16), (10, 32))):
        f = tmp_path / "in" / f"{k}.json"
        f.write_text("".join(json.dumps({"trace_id": "a", "seq": i, "atom": atoms[i]}) + "\n" for i in range(lo, hi)))
        os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema("trace_id string, seq long, atom string").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    assert {(r.trace_id, r["index"]) for r in run(monitors.stream_cliffs(stream), "late_cliffs")} == {(r.trace_id, r["index"]) for r in cliffs.detect_cliffs(t).collect()}
    assert [r.step for r in run(monitors.stream_first_firing(stream, "edit run_test "), "late_fire")] == [25]
    acts = run(monitors.stream_guard(stream, scoring.Spec((), (scoring.Penalty("f", 1.0, forbid_sequence=("run_test", "edit")),)), "warn"), "late_guard")
    assert [(r.seq, r.atom, r.verdict) for r in acts] == [(i, a, "warn" if a == "edit" and i > 24 else "allow") for i, a in enumerate(atoms)]
    # numbers with gaps: every micro-batch as it comes
    assert len(run(monitors.stream_guard(stream, scoring.Spec((), ()), first=None), "gaps_guard")) == 56


def test_guard_modes():
    s = scoring.Spec((), (scoring.Penalty("s", 1.0, max_run=2),))
    g = monitors.Guard(s)
    assert [g.step("edit")[0] for _ in range(3)] == ["allow", "allow", "block"]
    g = monitors.Guard(s, "steer")
    assert [g.step("edit")[1] for _ in range(3)] == ["edit", "edit", "run_test"]
    with pytest.raises(ValueError):
        monitors.Guard(s, "zzz")


def say(role, content=None, **more):
    return {"role": role, "content": content, **more}


def tool(name, arguments=None):
    return {"function": {"name": name} | ({"arguments": arguments} if arguments is not None else {})}


def acts(*commands):
    return {"actions": [dict(command=c) for c in commands]}


def payload(outer, inner, **more):
    return {"type": outer, "payload": dict(type=inner, **more)}


ADAPTED = {
    "swe-agent": ({"actions": [{"action": "open", "thought": "x"}, {"action": "edit"}, 5, {"action": None}]}, ["think", "read_file", "edit", "other"]),
    "gumtree": ({"actions": [dict(action="insert-node", node_type="Call"), dict(action="move-tree"), dict(action="zz")]}, ["ast_insert:Call", "ast_move:?", "other"]),
    "mini-swe-agent": ({"info": {"exit_status": "Limits"}, "messages": [say("assistant", "hm", extra=acts("cd a && grep x", "cat <<EOF > f", "python -m pytest"))]}, ["think", "search_repo", "edit", "run_test", "error"]),
    "openhands": ({"messages": [say("assistant", "a", tool_calls=[tool("bash", '{"command":"rm x"}'), tool("editor", {"command": "view"})])]}, ["think", "delete_file", "read_file"]),
    "function-xml": ({"messages": [dict(role="ai", content="so <function=bash><parameter=cmd>grep a</parameter></function> <function=finish></function>")]}, ["think", "search_repo", "submit"]),
    "react-text": ({"messages": [dict(role="ai", text="do\n```sh\n# c\ncat a\n```\n")]}, ["think", "read_file"]),
    "prompt-completion": ({"prompt": [say("user")], "completion": [say("assistant", "ok", tool_calls=[tool("runTests")]), say("tool", "Error: no")]}, ["prompt_ai", "think", "run_test", "error"]),
    "spine": ({"spine": " edit  run_test "}, ["edit", "run_test"]),
    "swe-agent-traj": ({"trajectory": [{"action": "str_replace_editor view /a", "thought": "t"}, {"action": "git status"}]}, ["think", "read_file", "version_control"]),
    "swe-smith": ({"messages": json.dumps([say("assistant", thought="t", action="cd /x && find . | head"), say("assistant", action="")])}, ["think", "search_repo", "error"]),
    "swe-smith-native": ({"messages": [say("assistant", action="cd /x && find . | head"), say("assistant", action="foo bar")]}, ["pipe:find", "other:foo"]),
    "claude-code": ({"events": [dict(type="user", message=say("user", "hello")), dict(type="assistant", message=say("assistant", [dict(type="tool_use", name="Bash", input=dict(command="pip install x"))])), dict(type="file-history-snapshot")]}, ["prompt_ai", "package", "edit"]),
    "codex": ({"events": [payload("event_msg", "user_message", message="hi"), payload("response_item", "function_call", name="shell", arguments='{"cmd":"cat a"}')]}, ["prompt_ai", "read_file"]),
    "gemini-cli": ({"events": [dict(type="user", content=[dict(text="hi")]), dict(type="gemini", toolCalls=[dict(name="grep_search")])]}, ["prompt_ai", "search_repo"]),
    "opencode": ({"events": [dict(info=say("user"), parts=[dict(type="text", text="q")]), dict(info=say("assistant"), parts=[dict(type="tool", tool="Edit")])]}, ["prompt_ai", "edit"]),
    "cursor-companion": ({"events": [{"type": "prompt_with_edit"}, {"details": '{"type":"file_open"}', "type": ""}, {"type": "zzz"}]}, ["prompt_ai", "edit", "read_file", "other"]),
    "cursor-vscdb": ({"events": [dict(kind="prompt"), dict(kind="ai", tool="read_file"), dict(kind="ai")]}, ["prompt_ai", "read_file", "other"]),
    "agentless": ({"actions": [{"phase": "repair", "reasoning": "r"}]}, ["think", "edit"]),
    "dars": ({"actions": [{"tool": "reason"}]}, ["think"]),
    "moatless": ({"actions": [{"action": "Finish", "thoughts": ""}]}, ["submit"]),
}


def test_adapters(spark):
    assert set(ADAPTED) == set(adapters.list_adapters())
    rows = [(n, json.dumps(dict(trace_id="t", agent="a", group=None, **r))) for n, (r, _) in ADAPTED.items()]
    for n, s in rows:
        df = spark.createDataFrame([(s,), ('{"trace_id":"e","messages":3,"events":null}',)], "s string").select(F.parse_json("s").alias("raw"))
        got = adapters.canonicalize(df, n).collect()
        assert got[0].atoms == ADAPTED[n][1] and got[0].group is None and got[1].atoms == [], n
    with pytest.raises(KeyError):
        adapters.get_adapter("zzz")
    with pytest.raises(ValueError):
        adapters.register_adapter("spine", adapters.spine)


def test_files_and_ingest(spark, corpus, tmp_path):
    t = traces(spark, corpus)
    files.write_traces(t, str(tmp_path / "t"))
    back = files.read_traces(spark, str(tmp_path / "t"))
    assert sorted((r.trace_id, tuple(r.atoms)) for r in back.collect()) == sorted((x[0], tuple(x[3])) for x in corpus)
    v = bpe.fit_bpe(t, 8)
    files.write_fingerprints(bpe.encode(t, v), str(tmp_path / "f"))
    assert files.read_fingerprints(spark, str(tmp_path / "f")).where(F.col("vocab_spec") == v.spec).count() == 24
    files.write_spines(t, "d1", str(tmp_path / "s"))
    assert files.read_spines(spark, str(tmp_path / "s"), "d1").count() == 24
    (tmp_path / "raw.jsonl").write_text("".join(json.dumps({"instance_id": f"i{k}", "history": [say("assistant", "x", tool_calls=[tool("finish")])]}) + "\n" for k in range(3)))
    got, plan = ingest.ingest(spark, str(tmp_path / "raw.jsonl"))
    assert plan.adapter == "openhands" and plan.turns_field == "history"
    assert [(r.trace_id, r.agent, r.atoms) for r in got.orderBy("trace_id").collect()][0] == ("i0", "raw", ["think", "submit"])
    with pytest.raises(ValueError):
        ingest.plan(ingest.read_any(spark, str(tmp_path / "f")))


def test_session_rework(spark):
    ev = [("s", k, *x) for k, x in enumerate([("prompt", None, None), ("ai", "write", "f"), ("ai", "write", "f"), ("ai", "edit_file", "f"), ("prompt", None, None), ("ai", "write", "g"), ("ai", "write", None)])]
    r = ingest.session_rework(spark.createDataFrame(ev, "session string, pos int, kind string, tool string, file string")).first()
    assert (r.prompts, r.edits, r.rework_prompts, r.re_edits) == (2, 4, 1, 2) and r.rework_ratio == 0.5


def test_probe(spark, corpus):
    t = traces(spark, corpus)
    r = learn.leave_one_group_out(bpe.encode(t, bpe.fit_bpe(t, 8)))
    assert r["accuracy"] > 0.9 and set(r["by_group"]) == {"g0", "g1", "g2"} == set(r["confusion"])
    assert sum(n for own in r["confusion"].values() for n in own.values()) == t.count()
    with pytest.raises(ValueError):
        learn.umap_project(bpe.encode(t, bpe.fit_bpe(t, 8)), n_neighbors=1000)


def test_entry_point(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 16
    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 50


def test_mean_divergence_is_over_all_rows(spark):
    r = np.random.RandomState(3)
    m = np.concatenate([r.dirichlet([9, 9, 1], 2000), np.tile([0.0, 0.0, 1.0], (100, 1))])
    df = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(m)], "idx long, distribution array<double>")
    want = sum(curate.divergences(m, x).sum() for x in m) / (2100 * 2099)
    assert curate.mean_divergence(df) == pytest.approx(want, abs=1e-12)
    assert curate.mean_divergence(df.where("idx < 30"), block=7) == pytest.approx(sum(curate.divergences(m[:30], x).sum() for x in m[:30]) / 870)
    assert curate.mean_divergence(df.where("idx < 1")) == curate.mean_divergence(df.where("idx < 0")) == 0.0


def test_every_group_is_left_out_once(spark):
    class Zero:
        def fit(self, _):
            return self

        def transform(self, df):
            return df.withColumn("prediction", F.lit(0.0))

    t = traces(spark, [(f"t{k}", f"a{k % 3}", f"g{k}", ["x", "y"][: 1 + k % 2] * 2, {}) for k in range(102)])
    r = learn.leave_one_group_out(bpe.encode(t, bpe.fit_bpe(t, 4)), classifier=Zero)
    assert len(r["by_group"]) == 102 and r["n_classes"] == 3 and r["accuracy"] == pytest.approx(1 / 3)
