"""Trajectories from the driver's tables.

traces: one per user of events, ordered by time and id. session_traces: one per user and
day. chat_traces: one per conversation. All have (trace_id, agent, group, atoms, metadata,
_ord); metadata is a map of strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "trace_id string, agent string, `group` string, atoms array<string>, metadata map<string,string>, _ord long"


def event_atom() -> Column:
    even = F.get_json_object("props", "$.k").cast("int") % 2 == 0
    kind = F.col("event_type")
    pick = lambda a, b: F.when(even, F.lit(a)).otherwise(F.lit(b))
    return (
        F.when(kind == "view", pick("read_file", "search_repo"))
        .when(kind == "click", pick("edit", "run_test"))
        .when(kind == "signup", pick("think", "prompt_ai"))
        .when(kind == "purchase", pick("submit", "edit"))
        .when(kind == "error", F.lit("error"))
        .otherwise(F.lit("other"))
    )


def event_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: one row per action, without any grouping of trajectories."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.concat(F.lit("u"), "user_id").alias("trace_id"),
        F.concat(F.lit("agent_"), F.col("user_id") % 4).alias("agent"),
        F.concat(F.lit("g"), F.col("user_id") % 3).alias("group"),
        "user_id", "ts", "event_id", "value", event_atom().alias("atom"),
    )


def _gather(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per key. The atoms are an output of the aggregation: taken out of the sorted structs by a later projection, they would be taken out again wherever a lambda reads them. The number of partitions is given, since adaptive execution would merge these few bytes, on which much is computed, into one task."""
    rows = rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *keys)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", "atom"))), lambda x: x["atom"])
    return rows.groupBy(*keys).agg(ordered.alias("atoms"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"), F.count("*").alias("n"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gather(event_atoms(spark, sf_dir), "trace_id", "agent", "group", "user_id")
    meta = F.create_map(F.lit("resolved"), (F.col("last_value") > 100).cast("string"), F.lit("instance_id"), F.concat(F.lit("i"), F.col("user_id") % 25))
    return g.select("trace_id", "agent", "group", "atoms", meta.alias("metadata"), F.col("user_id").alias("_ord"))


def session_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_atoms(spark, sf_dir).withColumn("day", F.to_date("ts"))
    g = _gather(rows, "trace_id", "agent", "group", "user_id", "day")
    meta = F.create_map(F.lit("day"), F.col("day").cast("string"))
    ident = F.concat("trace_id", F.lit("@"), F.col("day").cast("string"))
    order = F.col("user_id") * 100000 + F.datediff("day", F.lit("1970-01-01").cast("date"))
    return g.select(ident.alias("trace_id"), "agent", "group", "atoms", meta.alias("metadata"), order.alias("_ord"))


def chat_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    atom = F.when(F.col("role") == "user", "prompt_ai").when(F.col("role") == "assistant", "think").otherwise("other")
    g = c.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", atom.alias("atom")))), lambda x: x["atom"]).alias("atoms"))
    return g.select(F.concat(F.lit("c"), "conv_id").alias("trace_id"), F.concat(F.lit("agent_"), F.col("conv_id") % 4).alias("agent"), F.lit(None).cast("string").alias("group"), "atoms", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("metadata"), F.col("conv_id").alias("_ord"))


#: The same views in DuckDB SQL, as common table expressions.
EVENT_SQL = """ev AS (
  SELECT 'u' || user_id AS trace_id, 'agent_' || (user_id % 4) AS agent, 'g' || (user_id % 3) AS grp, user_id, ts, event_id, value,
    CASE WHEN event_type = 'view' THEN CASE WHEN k % 2 = 0 THEN 'read_file' ELSE 'search_repo' END
         WHEN event_type = 'click' THEN CASE WHEN k % 2 = 0 THEN 'edit' ELSE 'run_test' END
         WHEN event_type = 'signup' THEN CASE WHEN k % 2 = 0 THEN 'think' ELSE 'prompt_ai' END
         WHEN event_type = 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'submit' ELSE 'edit' END
         WHEN event_type = 'error' THEN 'error' ELSE 'other' END AS atom
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""
TRACE_SQL = EVENT_SQL + """, tr AS (
  SELECT trace_id, agent, grp, user_id, list(atom ORDER BY ts, event_id) AS atoms,
    arg_max(value, (ts, event_id)) > 100 AS resolved, 'i' || (user_id % 25) AS instance_id
  FROM ev GROUP BY ALL), sp AS (SELECT *, array_to_string(atoms, ' ') || ' ' AS spine, len(atoms) AS n FROM tr)"""
SESSION_SQL = EVENT_SQL + """, ses AS (
  SELECT trace_id || '@' || CAST(CAST(ts AS DATE) AS VARCHAR) AS trace_id, agent, grp, user_id, CAST(ts AS DATE) AS day, list(atom ORDER BY ts, event_id) AS atoms
  FROM ev GROUP BY ALL)"""
