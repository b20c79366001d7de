"""Readers and writers of trajectories, fingerprints and spines."""

from __future__ import annotations

import glob
import itertools
import json
import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bridge


def scratch(spark: SparkSession) -> str:
    """A new folder's name below spark.checkpoint.dir, the folder that all machines share; on one machine without that setting, below a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir isn't set: on a cluster it must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tracewright-")
    return f"{found.rstrip('/')}/tracewright-{uuid.uuid4().hex}"


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, as the session's file systems resolve it."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(p).toString()


def file_system(uri: str):
    """(pyarrow's file system, path in it) of a qualified path, for workers."""
    import pyarrow.fs

    if uri.startswith("file:"):
        return pyarrow.fs.LocalFileSystem(), local(uri)
    return pyarrow.fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def local(uri: str) -> str:
    """The path of a file: URI."""
    return re.sub("^file:/*", "/", uri)


def write_files(rows: DataFrame, folder: str) -> int:
    """One file of UTF-8 text per row (name, value) in a folder that all machines share; each task writes its rows. Their number."""
    uri = qualified(rows.sparkSession, folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, at = file_system(uri)
        fs.create_dir(at, recursive=True)
        for f in frames:
            for name, value in zip(f["name"], f["value"]):
                with fs.open_output_stream(f"{at}/{name}") as out:
                    out.write(value.encode())
            yield pd.DataFrame({"n": [len(f)]})

    return rows.select("name", "value").mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def _found(pattern: str) -> Iterator[str]:
    """Local files that a pattern names, and those below folders that it names; hidden ones are left out."""
    shown = lambda name: not name.startswith(("_", "."))
    for p in glob.iglob(pattern):
        if not os.path.isdir(p):
            if shown(os.path.basename(p)):
                yield p
            continue
        for at, folders, names in os.walk(p):
            folders[:] = filter(shown, folders)
            yield from (f"{at}/{x}" for x in names if shown(x))


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): whole files of UTF-8 text, file being a URI. Many small local files are listed by one task and read by all, without a plan of them on the driver; other file systems are read by Spark."""
    uri = qualified(spark, path)
    if not uri.startswith("file:") or "{" in uri:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    pattern = local(uri)

    def names(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _ in frames:
            found = _found(pattern)
            while part := list(itertools.islice(found, 10_000)):
                yield pd.DataFrame({"path": part})

    def values(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple[str, str]] = []
        size = 0
        for f in frames:
            for p in f["path"]:
                text = Path(p).read_bytes().decode("utf-8", "replace")
                out.append(("file://" + re.sub(r'[\x00-\x20"#%<>?\[\\\]^`{|}\x7f]', lambda m: f"%{ord(m[0]):02X}", p), text))
                size += len(text)
                if size > 1 << 22:
                    yield pd.DataFrame(out, columns=["file", "value"])
                    out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=["file", "value"])

    listed = spark.range(1, numPartitions=1).mapInPandas(names, "path string")
    return listed.repartition(4 * spark.sparkContext.defaultParallelism).mapInPandas(values, "file string, value string")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as (raw VARIANT, _ord); blank lines are skipped, malformed ones raise."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.parse_json("value").alias("raw"), F.monotonically_increasing_id().alias("_ord"))


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Canonical trajectories from JSON lines (trace_id, agent, atoms, group?, metadata?)."""
    df = spark.read.schema("trace_id string, agent string, atoms array<string>, `group` string, metadata map<string,string>").option("mode", "FAILFAST").json(path)
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return df.select("trace_id", "agent", "group", F.coalesce("atoms", F.array().cast("array<string>")).alias("atoms"), F.coalesce("metadata", empty).alias("metadata"), F.monotonically_increasing_id().alias("_ord"))


def write_traces(traces: DataFrame, path: str, mode: str = "error") -> None:
    """JSON lines; null groups and empty metadata are left out."""
    meta = F.when(F.size("metadata") > 0, F.col("metadata"))
    traces.select(F.to_json(F.struct("trace_id", "agent", "atoms", "group", meta.alias("metadata")), {"ignoreNullFields": "true"}).alias("value")).write.mode(mode).text(path)


def read_fingerprints(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("trace_id string, agent string, `group` string, counts array<bigint>, vocab_spec string").option("mode", "FAILFAST").json(path)


def write_fingerprints(fps: DataFrame, path: str, mode: str = "error") -> None:
    fps.select(F.to_json(F.struct("trace_id", "agent", "group", "counts", "vocab_spec"), {"ignoreNullFields": "true"}).alias("value")).write.mode(mode).text(path)


def write_json(path: str | Path, payload, indent: int = 2) -> None:
    Path(path).write_text(json.dumps(payload, indent=indent, ensure_ascii=False) + "\n")


def read_json(path: str | Path):
    return json.loads(Path(path).read_text())


SPINE_COLUMNS = tuple("dataset trace_id agent task spine outcome cot_tokens".split())


def write_spines(traces: DataFrame, dataset: str, path: str, task_field: str = "instance_id", mode: str = "append") -> None:
    """The spine store: Parquet by dataset, every column a string."""
    from .adapters import outcome

    rows = traces.select(F.lit(dataset).alias("dataset"), "trace_id", "agent", F.coalesce(F.try_element_at("metadata", F.lit(task_field)), F.lit("")).alias("task"), F.array_join("atoms", " ").alias("spine"), outcome(F.col("metadata")).alias("outcome"), F.coalesce(F.try_element_at("metadata", F.lit("cot_tokens")), F.lit("")).alias("cot_tokens"))
    rows.write.mode(mode).partitionBy("dataset").parquet(path)


def read_spines(spark: SparkSession, path: str, dataset: str | None = None) -> DataFrame:
    """Trajectories from the spine store; one dataset reads its partition only."""
    df = spark.read.parquet(path)
    if dataset is not None:
        df = df.where(F.col("dataset") == dataset)
    meta = F.create_map(F.lit("dataset"), F.col("dataset").cast("string"), F.lit("task"), "task", F.lit("outcome"), "outcome", F.lit("cot_tokens"), "cot_tokens")
    return df.select("trace_id", "agent", F.lit(None).cast("string").alias("group"), F.filter(F.split("spine", " "), lambda a: a != "").alias("atoms"), meta.alias("metadata"), F.monotonically_increasing_id().alias("_ord"))


def read_run_arm(spark: SparkSession, run_dir: str, arm: str, grades: DataFrame | None = None) -> DataFrame:
    """Trajectories of one arm of a run folder: arms/<arm>/<instance>[.r<n>].traj.json, with grades by instance where given."""
    from .adapters import canonicalize

    stem = F.url_decode(F.replace(F.regexp_extract("file", r"/([^/]+)\.traj\.json$", 1), F.lit("+"), F.lit("%2B")))
    files = read_files(spark, f"{run_dir}/arms/{arm}/*.traj.json").select(F.parse_json("value").alias("raw"), F.struct(F.monotonically_increasing_id().alias("n"), stem.alias("stem")).alias("_ord"))
    base = canonicalize(files, "mini-swe-agent")  # hands _ord on as it is
    rows = base.select(F.col("_ord.stem").alias("trace_id"), F.lit(arm).alias("agent"), "group", "atoms", "metadata", F.col("_ord.n").alias("_ord"), F.regexp_replace("_ord.stem", r"\.r\d+$", "").alias("instance_id"))
    rows = rows.join(grades, "instance_id", "left") if grades is not None else rows.withColumn("resolved", F.lit(None).cast("boolean"))
    extra = F.map_from_arrays(F.array(F.lit("instance_id"), F.lit("resolved")), F.array("instance_id", F.coalesce(F.col("resolved").cast("string"), F.lit(""))))
    return rows.select("trace_id", "agent", "group", "atoms", F.map_concat(F.map_filter("metadata", lambda k, v: ~k.isin("instance_id", "resolved")), extra).alias("metadata"), "_ord")


def empty_traces(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], bridge.SCHEMA)


# ---------------------------------------------------------------- run manifests
def build_manifest(spec: dict, instances: list[str], **settings) -> dict:
    """A run's manifest with the digest of its spec."""
    import hashlib

    body = json.dumps(spec, sort_keys=True, separators=(",", ":"))
    return {"spec": spec, "spec_sha256": hashlib.sha256(body.encode()).hexdigest(), "instances": sorted(instances), **settings}


def read_manifest(path: str | Path) -> dict:
    """Refuses a manifest whose spec isn't the one that was digested."""
    m = read_json(path)
    if build_manifest(m["spec"], m["instances"])["spec_sha256"] != m["spec_sha256"]:
        raise ValueError("the spec differs from the manifest's digest")
    return m
