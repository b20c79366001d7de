"""Automatic ingestion: look at a file's columns and first rows, choose an adapter, canonicalise."""

from __future__ import annotations

import json
import os
import sqlite3
from collections.abc import Iterator
from contextlib import closing
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import files
from .adapters import anonymous_id, canonicalize, hashed_path, list_adapters

TURN_FIELDS = tuple("messages trajectory traj history conversations steps".split())
ID_FIELDS = ("trace_id", "trajectory_id", "traj_id", "run_id", "instance_id", "id")
AGENT_FIELDS = ("agent", "model", "model_name", "model_name_or_path", "scaffold")
GROUP_FIELDS = ("group", "family", "split")


@dataclass(frozen=True)
class Plan:
    adapter: str
    confidence: float
    trace_id_field: str | None
    agent_field: str | None
    group_field: str | None
    turns_field: str | None

    def summary(self) -> str:
        return f"adapter {self.adapter} ({self.confidence:.2f}); id {self.trace_id_field}, agent {self.agent_field}, group {self.group_field}, turns {self.turns_field}"


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """A local JSON-lines, Parquet, CSV or ORC source as records with a VARIANT column raw."""
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind in ("parquet", "orc", "csv"):
        df = spark.read.option("header", True).format(kind).load(path)
        return df.select(F.parse_json(F.to_json(F.struct("*"))).alias("raw"), F.monotonically_increasing_id().alias("_ord"))
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(F.try_parse_json("value").alias("raw"), F.monotonically_increasing_id().alias("_ord")).where("raw is not null")


def introspect(records: DataFrame, rows: int = 5) -> list[dict]:
    """The first rows, as objects."""
    return [json.loads(r[0]) for r in records.select(F.to_json("raw")).limit(rows).collect()]


def _turns(row: dict) -> tuple[str | None, list]:
    for f in TURN_FIELDS:
        v = row.get(f)
        if isinstance(v, str):
            try:
                v = json.loads(v)
            except ValueError:
                continue
        if isinstance(v, list) and any(isinstance(x, dict) for x in v):
            return f, v
    return None, []


def sniff(rows: list[dict]) -> list[tuple[str, float]]:
    """(adapter, confidence), best first; ties keep the order of the checks."""
    row = rows[0] if rows else {}
    turns = [t for t in _turns(row)[1] if isinstance(t, dict)]
    keys = {k for t in turns for k in t}
    said = " ".join(str(t.get("content") or t.get("text") or "") for t in turns[:20])
    model = [t for t in turns if t.get("role") in ("assistant", "ai")]
    found = [
        ("openhands", 0.95 if any(t.get("tool_calls") for t in model) else 0.4 if "tool_calls" in keys else 0.0),
        ("mini-swe-agent", 0.95 if any(isinstance(t.get("extra"), dict) and "actions" in t["extra"] for t in turns) else 0.0),
        ("swe-agent-traj", 0.9 if {"action", "observation"} <= keys else 0.0),
        ("swe-agent", 0.9 if isinstance(row.get("actions"), list) else 0.45 if "actions" in row else 0.0),
        ("swe-smith", 0.7 if model and any("action" in t for t in model) else 0.0),
        ("function-xml", 0.85 if "<function=" in said else 0.0),
        ("react-text", 0.8 if "```" in said else 0.0),
        ("spine", 0.95 if isinstance(row.get("spine"), str) else 0.4 if "spine" in row else 0.0),
        ("prompt-completion", 0.9 if "prompt" in row and "completion" in row else 0.45 if "completion" in row else 0.0),
    ]
    return sorted([f for f in found if f[1] > 0], key=lambda f: -f[1])


def plan(records: DataFrame, adapter: str | None = None, *, group_field: str | None = None, agent_field: str | None = None, trace_id_field: str | None = None) -> Plan:
    rows = introspect(records)
    names = {k for r in rows for k in r}
    guesses = sniff(rows)
    if adapter is None and not guesses:
        raise ValueError(f"no adapter fits fields {sorted(names)}; name one of {list_adapters()}")
    pick = lambda given, options: given or next((o for o in options if o in names), None)
    turns = _turns(rows[0])[0] if rows else None
    chosen = (adapter, 1.0) if adapter else guesses[0]
    return Plan(chosen[0], chosen[1], pick(trace_id_field, ID_FIELDS), pick(agent_field, AGENT_FIELDS), pick(group_field, GROUP_FIELDS), turns)


def ingest(spark: SparkSession, path: str, limit: int | None = None, adapter: str | None = None, **fields) -> tuple[DataFrame, Plan]:
    """Trajectories and the plan. Ids that are missing are made from row numbers, agents from the file's name; turns under any known field are read as messages."""
    records = read_any(spark, path)
    p = plan(records, adapter, **fields)
    if limit is not None:
        records = records.limit(limit)
    target = "trajectory" if p.adapter == "swe-agent-traj" else "messages"
    if p.turns_field and p.turns_field != target:
        raw = F.parse_json(F.concat(F.lit('{"'), F.lit(target), F.lit('":'), F.coalesce(F.to_json(F.try_variant_get("raw", f"$.{p.turns_field}", "variant")), F.lit("null")), F.lit(","), F.substring(F.to_json("raw"), 2, 1 << 30)))
        records = records.withColumn("raw", raw)
    t = canonicalize(records, p.adapter, p.trace_id_field or "trace_id", p.agent_field or "agent", p.group_field or "group")
    name = Path(path).stem
    return t.withColumn("trace_id", F.when(F.col("trace_id") == "", F.col("_ord").cast("string")).otherwise(F.col("trace_id"))).withColumn("agent", F.when(F.col("agent") == "", name).otherwise(F.col("agent"))), p


def discover(catalog: DataFrame, min_downloads: int = 0) -> DataFrame:
    """A catalogue's datasets (id, downloads, ...), each once, most downloaded first."""
    w = Window.partitionBy("id").orderBy(F.desc("downloads"))
    return catalog.where(F.col("downloads") >= min_downloads).withColumn("r", F.row_number().over(w)).where("r = 1").drop("r").orderBy(F.desc("downloads"), "id")


def load_transcript(spark: SparkSession, path: str, agent: str = "claude-code", anonymize: bool = True) -> DataFrame:
    """One record per transcript file (JSON lines) with its events in the file's order; lines that don't parse are skipped."""
    lines = files.read_files(spark, path).select("file", F.filter(F.transform(F.split("value", r"\r\n|\r|\n"), lambda x: F.try_parse_json(x)), lambda v: v.isNotNull()).alias("v")).where(F.size("v") > 0)
    sid = F.array_max(F.transform("v", lambda v: F.try_variant_get(v, "$.sessionId", "string")))
    got = lines.select("file", F.transform("v", lambda v: F.to_json(v)).alias("events"), sid.alias("sid"))
    ident = F.coalesce("sid", F.col("file"))
    ident = anonymous_id(ident) if anonymize else ident
    head = F.to_json(F.struct(ident.alias("trace_id"), F.lit(agent).alias("agent")))
    body = F.concat(F.expr("substring(head, 1, length(head) - 1)"), F.lit(',"events":['), F.array_join("events", ","), F.lit("]}"))
    return got.withColumn("head", head).select(F.parse_json(body).alias("raw"), F.monotonically_increasing_id().alias("_ord"))


# ---------------------------------------------------------------- the editor's SQLite store
_TABLE = "cursorDiskKV"
#: rows of a store that one task reads
_ROWS = 1_000_000


def _stores(spark: SparkSession, path: str | Path) -> list[str]:
    """A store, or the stores in a folder, where the workers can open them: on a cluster a store outside the shared folder is copied there."""
    paths = sorted(map(str, Path(path).glob("*.vscdb"))) if Path(path).is_dir() else [str(path)]
    place = files.scratch(spark)
    shared = files.local(place.rsplit("/", 1)[0])
    out = []
    for i, p in enumerate(map(os.path.abspath, paths)):
        if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
            if not place.startswith("file:"):
                raise ValueError("an SQLite store is opened as a file: spark.checkpoint.dir must be a mounted folder")
            if not p.startswith(shared + "/"):
                os.makedirs(files.local(place), exist_ok=True)
                with closing(_open(p)) as con, closing(sqlite3.connect(copy := f"{files.local(place)}/{i}.vscdb")) as to:
                    con.backup(to)
                p = copy
        out.append(p)
    return out


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{quote(path)}?mode=ro", uri=True)


def _rows(spark: SparkSession, path: str | Path) -> DataFrame:
    """(store, key, value) of the headers and messages. Tasks read ranges of row numbers; nothing passes through the driver."""
    work = []
    for p in _stores(spark, path):
        with closing(_open(p)) as con:
            try:
                lo, hi = con.execute(f"select min(rowid), max(rowid) from {_TABLE}").fetchone()
            except sqlite3.OperationalError:  # a table without row numbers is read by one task
                con.execute(f"select 1 from {_TABLE} limit 1")
                work.append((p, 0, -1))
                continue
        work += [(p, at, min(at + _ROWS - 1, hi)) for at in range(lo, hi + 1, _ROWS)] if lo is not None else []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for p, lo, hi in f.itertuples(index=False):
                with closing(_open(p)) as con:
                    found = con.execute(f"select key, value from {_TABLE}" + (f" where rowid between {lo} and {hi}" if lo <= hi else ""))
                    while part := found.fetchmany(10_000):
                        own = [(p, k, v if isinstance(v, str) else (v or b"").decode("utf-8", "replace")) for k, v in part if isinstance(k, str) and k.startswith(("composerData:", "bubbleId:"))]
                        yield pd.DataFrame(own, columns=["store", "key", "value"])

    jobs = spark.createDataFrame(work, "store string, lo long, hi long")
    return jobs.repartition(max(1, len(work))).mapInPandas(run, "store string, key string, value string")


def read_state_store(spark: SparkSession, path: str | Path, agent: str = "cursor") -> DataFrame:
    """(session, pos, kind, tool, file): the events of each session, from headers joined with their messages; of one store, or of all stores (*.vscdb) of a folder.

    Only structure leaves the store: tool names and hashed paths, no text.
    """
    rows = _rows(spark, path)
    heads = rows.where(F.col("key").startswith("composerData:")).select("store", F.substring_index("key", ":", -1).alias("session"), F.try_parse_json("value").alias("v"))
    order = heads.select("store", "session", F.posexplode(F.coalesce(F.try_variant_get("v", "$.fullConversationHeadersOnly", "array<variant>"), F.array().cast("array<variant>"))).alias("pos", "h")).select("store", "session", "pos", F.try_variant_get("h", "$.bubbleId", "string").alias("bubble"))
    bubbles = rows.where(F.col("key").startswith("bubbleId:")).select("store", F.split_part("key", F.lit(":"), F.lit(2)).alias("session"), F.split_part("key", F.lit(":"), F.lit(3)).alias("bubble"), F.try_parse_json("value").alias("b"))
    v = lambda p, t="string": F.try_variant_get("b", p, t)
    tool = F.regexp_replace(F.coalesce(v("$.toolFormerData.name"), v("$.toolFormerData.tool")), r"(?<=.)_v\d+$", "")
    params = F.try_variant_get("b", "$.toolFormerData.params", "variant")
    params = F.when(F.schema_of_variant(params) == "STRING", F.try_parse_json(F.try_variant_get(params, "$", "string"))).otherwise(params)
    target = F.coalesce(F.try_variant_get(params, "$.targetFile", "string"), F.try_variant_get(params, "$.relativeWorkspacePath", "string"))
    blocks = F.size(F.coalesce(v("$.codeBlocks", "array<variant>"), F.array().cast("array<variant>"))) > 0
    said = F.coalesce(v("$.text"), F.lit("")) != ""
    kind = F.when(v("$.type", "int") == 1, "prompt").when(F.coalesce(tool, F.lit("")) != "", "ai").when(blocks, "ai").when(said, "think").otherwise("ai")
    events = order.join(bubbles, ["store", "session", "bubble"])
    return events.select("session", F.lit(agent).alias("agent"), "pos", kind.alias("kind"), F.when(kind == "ai", F.coalesce(F.nullif(tool, F.lit("")), F.when(blocks, F.lit("_codeblock")))).alias("tool"), F.when(kind == "ai", hashed_path(target)).alias("file"))


def session_rework(events: DataFrame) -> DataFrame:
    """Per session: prompts, attributable edits, re-edits of a file, prompts whose run re-edits, and both ratios."""
    edit = F.col("tool").isin(*"apply_patch edit_file edit_notebook search_replace write".split()) & F.col("file").isNotNull() & (F.col("kind") != "prompt")
    run = F.sum((F.col("kind") == "prompt").cast("int")).over(Window.partitionBy("session").orderBy("pos"))
    again = F.row_number().over(Window.partitionBy("session", "file", "is_edit").orderBy("pos")) > 1
    e = events.withColumn("is_edit", F.coalesce(edit, F.lit(False))).withColumn("run", run).withColumn("again", F.col("is_edit") & again)
    runs = e.groupBy("session", "run").agg(F.sum((F.col("kind") == "prompt").cast("long")).alias("prompts"), F.sum(F.col("is_edit").cast("long")).alias("edits"), F.sum(F.col("again").cast("long")).alias("re_edits"))
    out = runs.groupBy("session").agg(F.sum("prompts").alias("prompts"), F.sum("edits").alias("edits"), F.sum((F.col("re_edits") > 0).cast("long")).alias("rework_prompts"), F.sum("re_edits").alias("re_edits"))
    ratio = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return out.withColumn("rework_ratio", ratio("rework_prompts", "prompts")).withColumn("re_edit_ratio", ratio("re_edits", "edits"))


def panel_sessions(records: DataFrame) -> DataFrame:
    """Transcript records as prompt-anchored turns: (trace_id, turn, seq), turn 0 being what precedes the first prompt."""
    t = canonicalize(records, "claude-code")
    rows = t.select("trace_id", F.posexplode("atoms").alias("pos", "atom"))
    turn = F.sum((F.col("atom") == "prompt_ai").cast("int")).over(Window.partitionBy("trace_id").orderBy("pos"))
    return rows.withColumn("turn", turn).groupBy("trace_id", "turn").agg(F.array_sort(F.collect_list(F.struct("pos", "atom"))).alias("x")).select("trace_id", "turn", F.filter("x.atom", lambda a: a != "prompt_ai").alias("seq"))
