"""Every command, in the session of the tests."""

import json
import sys
import types

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from tracewright import cli
from tracewright.plans import adapter_cases
from tracewright.sources import adapters, bridge, files

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    p = tmp_path_factory.mktemp("cli")
    t = bridge.traces(spark, SF).where("size(atoms) > 0")
    files.write_traces(t, f"{p}/traces.jsonl")
    adapter_cases.records(t, "swe-agent").select(F.to_json("raw").alias("value")).write.text(f"{p}/raw.jsonl")
    return str(p)


@pytest.fixture
def run(place, capsys):
    def call(*argv: str) -> list[str]:
        capsys.readouterr()
        assert cli.main([a.replace("@", place + "/") for a in argv]) == 0
        return capsys.readouterr().out.strip().split("\n")

    return call


def test_adapters_are_listed(run):
    assert run("list-adapters") == adapters.list_adapters() and "openhands" in adapters.list_adapters()


def test_from_records_to_divergence(spark, place, run):
    run("canonicalize", "@raw.jsonl", "@canonical.jsonl", "--adapter", "swe-agent")
    assert files.read_traces(spark, f"{place}/canonical.jsonl").count() == spark.read.text(f"{place}/raw.jsonl").count()
    run("fit-bpe", "@traces.jsonl", "@vocab.json", "--vocab-size", "12")
    tree = run("vocab-tree", "@vocab.json")
    assert len(tree) > 4 and any("edit" in x for x in tree)
    run("encode", "@traces.jsonl", "@vocab.json", "@prints.jsonl")
    assert files.read_fingerprints(spark, f"{place}/prints.jsonl").count() == files.read_traces(spark, f"{place}/traces.jsonl").count()
    grid = [json.loads(x) for x in run("jsd", "@prints.jsonl", "--group-by", "agent")]
    assert len(grid) == 16 and all(r["jsd"] == 0 for r in grid if r["row"] == r["col"])
    probe = json.loads(run("probe", "@prints.jsonl")[0])
    assert set(probe["by_group"]) == {"g0", "g1", "g2"} == set(probe["confusion"]) and 0 <= probe["accuracy"] <= 1


def test_projection(place, run, monkeypatch):
    class Plane:
        def __init__(self, **options):
            self.options = options

        def fit_transform(self, m):
            return np.asarray(m)[:, :2]

    monkeypatch.setitem(sys.modules, "umap", types.SimpleNamespace(UMAP=Plane))
    run("fit-bpe", "@traces.jsonl", "@v2.json", "--vocab-size", "10")
    run("encode", "@traces.jsonl", "@v2.json", "@p2.jsonl")
    rows = [json.loads(x) for x in run("umap", "@p2.jsonl", "--n-neighbors", "2", "--granularity", "group")]
    assert [r["label"] for r in rows] == ["g0", "g1", "g2"] and all(0 <= r["x"] <= 1 for r in rows)
    with pytest.raises(ValueError):
        cli.main(["umap", f"{place}/p2.jsonl", "--n-neighbors", "3", "--granularity", "group"])


def test_patterns_and_questions(place, run):
    with open(f"{place}/rules.yaml", "w") as f:
        yaml.safe_dump({"rules": [{"name": "tests", "pattern": "run_test "}, {"name": "streak", "pattern": "(edit ){3,}", "must_hold": False}]}, f)
    got = {r["rule"]: r for r in map(json.loads, run("match-patterns", "@traces.jsonl", "@rules.yaml"))}
    assert set(got) == {"tests", "streak"} and all(r["fails"] <= r["n"] for r in got.values())
    *shown, rate = map(json.loads, run("grep", "@traces.jsonl", "(edit ){2,}", "--show", "3"))
    assert len(shown) == min(3, rate["hits"]) and all("edit edit" in r["spine"] for r in shown)
    assert json.loads(run("ask", "@traces.jsonl", "Starts by reading")[-1])["n"] == rate["n"]


def test_reports(run):
    parts = run("compare", "@traces.jsonl", "agent_0", "agent_1")
    assert json.loads(parts[0])["jsd_nats"] >= 0
    assert {x[2:] for x in run("report", "@traces.jsonl", "--vocab-size", "12") if x.startswith("# ")} == {"overview", "atom_mix", "procedures", "agents", "divergence"}
    floor = json.loads(run("floor", "@traces.jsonl", "--condition", "resolved", "--vocab-size", "10", "--draws", "5")[0])
    assert floor["n_draws"] == 5 and "false" in floor["cells"]


def test_curated_subset_is_written(spark, place, run):
    text = run("curate", "@traces.jsonl", "--vocab-size", "12", "--target-size", "3", "--output", "@subset.jsonl")[0]
    got = files.read_traces(spark, f"{place}/subset.jsonl")
    assert "3 chosen" in text and got.select("trace_id").distinct().count() == 3


def test_watching_a_folder(spark, place, run):
    steps = files.read_traces(spark, f"{place}/traces.jsonl").select("trace_id", F.posexplode("atoms").alias("seq", "atom"))
    steps.coalesce(1).write.json(f"{place}/live")
    run("watch", "@live", "@state", "--pattern", "edit ", "--output", "@fired", "--once")
    want = files.read_traces(spark, f"{place}/traces.jsonl").where("array_contains(atoms, 'edit')").count()
    assert spark.read.json(f"{place}/fired").count() == want
