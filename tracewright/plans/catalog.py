"""Registered queries of the trajectory operators, with the DuckDB SQL of each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import distributions as D
from ..functions import sequences as S
from ..operators import bpe, cliffs, compare, curate, divergence, floor, lineage, patterns, scoring, stats, studies, summary
from ..sources import bridge
from ..sources.bridge import EVENT_SQL, SESSION_SQL, TRACE_SQL
from . import adapter_cases, round_trips

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "jsd_matrix_by_agent"
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ATOMS = ("edit", "error", "prompt_ai", "read_file", "run_test", "search_repo", "submit", "think")
#: A vocabulary with given merges, so that encoding itself can be stated in SQL.
FIXED = bpe.Vocabulary(ATOMS, (("edit", "error"), ("error", "edit"), ("edit", "run_test"), ("edit▁error", "edit"), ("search_repo", "read_file"), ("error", "error")))
A, B = "agent_0", "agent_1"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _r(c: str, digits: int = 6):
    return F.round(F.col(c), digits).alias(c)


def _chars() -> dict[str, str]:
    return {t: chr(0xE000 + i) for i, t in enumerate(FIXED.tokens())}


def _encoded_sql() -> str:
    """Spines as characters with the fixed merges applied; only replacements."""
    ch = _chars()
    first = "array_to_string(list_transform(atoms, lambda a: CASE a " + " ".join(f"WHEN '{a}' THEN '{ch[a]}'" for a in ATOMS) + " ELSE '' END), '')"
    for a, b in FIXED.merges:
        first = f"replace({first}, '{ch[a]}{ch[b]}', '{ch[a + bpe.SEPARATOR + b]}')"
    return f"{TRACE_SQL}, en AS (SELECT *, {first} AS enc FROM tr)"


def _long_sql() -> str:
    """(trace_id, agent, grp, token_id, c, p): counts and shares of every token, also of absent ones."""
    tokens = " UNION ALL ".join(f"SELECT {i} AS token_id, '{c}' AS ch, '{t}' AS token" for i, (t, c) in enumerate(_chars().items()))
    return f"""{_encoded_sql()}, tok AS ({tokens}), lg AS (
  SELECT trace_id, agent, grp, resolved, token_id, token, length(enc) - length(replace(enc, ch, '')) AS c,
    CASE WHEN length(enc) = 0 THEN 1.0 / {FIXED.size} ELSE (length(enc) - length(replace(enc, ch, ''))) / length(enc) END AS p FROM en, tok)"""


def _fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(bridge.traces(spark, sf_dir), FIXED)


def _term(p: str, q: str) -> str:
    m = f"(({p} + {q}) / 2)"
    return f"((CASE WHEN {p} > 0 THEN {p} * ln({p} / {m}) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * ln({q} / {m}) ELSE 0 END) / 2)"


# ---------------------------------------------------------------- sources
@query("traces", f"WITH {TRACE_SQL} SELECT trace_id, agent, grp AS \"group\", array_to_string(atoms, ' ') AS spine, n AS n_atoms, resolved FROM sp")
def traces_(spark, sf):
    t = bridge.traces(spark, sf)
    return t.select("trace_id", "agent", "group", F.array_join("atoms", " ").alias("spine"), F.size("atoms").cast("long").alias("n_atoms"), (F.col("metadata")["resolved"] == "true").alias("resolved"))


@query("session_traces", f"WITH {SESSION_SQL} SELECT trace_id, agent, array_to_string(atoms, ' ') AS spine FROM ses")
def sessions_(spark, sf):
    return bridge.session_traces(spark, sf).select("trace_id", "agent", F.array_join("atoms", " ").alias("spine"))


@query("chat_traces", """SELECT 'c' || conv_id AS trace_id, string_agg(CASE role WHEN 'user' THEN 'prompt_ai' WHEN 'assistant' THEN 'think' ELSE 'other' END, ' ' ORDER BY turn) AS spine FROM conversations GROUP BY conv_id""")
def chats_(spark, sf):
    return bridge.chat_traces(spark, sf).select("trace_id", F.array_join("atoms", " ").alias("spine"))


@query("event_atoms", f"WITH {EVENT_SQL} SELECT agent, atom, count(*) AS n FROM ev GROUP BY ALL")
def event_atoms_(spark, sf):
    """Counted without gathering trajectories."""
    return bridge.event_atoms(spark, sf).groupBy("agent", "atom").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- patterns
@query("grep_edit_runs", f"WITH {TRACE_SQL} SELECT trace_id FROM sp WHERE regexp_matches(spine, '(edit ){{3,}}')")
def grep_(spark, sf):
    return patterns.grep(bridge.traces(spark, sf), "(edit ){3,}").select("trace_id")


@query("hit_rate_by_agent", f"WITH {TRACE_SQL} SELECT agent, count(*) AS n, CAST(count(*) FILTER (WHERE regexp_matches(spine, 'error error ')) AS BIGINT) AS hits, round(avg(CAST(regexp_matches(spine, 'error error ') AS DOUBLE)), 6) AS rate FROM sp GROUP BY agent")
def hit_rate_(spark, sf):
    return patterns.hit_rate(bridge.traces(spark, sf), "error error ", "agent").select("agent", "n", "hits", _r("rate"))


RULES = [
    patterns.Pattern("no_long_edit_runs", "(edit ){4,}", must_hold=False),
    patterns.Pattern("tests_somewhere", "run_test "),
    patterns.Pattern("test_then_submit", "run_test .* submit"),
    patterns.Pattern("starts_with_error", "^error ", must_hold=False),
]


def _rule_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT '{p.name}' AS rule, trace_id, regexp_matches(spine, '{p.pattern}') <> {str(p.must_hold).lower()} AS bad FROM sp" for p in RULES)
    return f"WITH {TRACE_SQL}, rb AS ({rows}) "


@query("match_patterns", _rule_sql() + "SELECT rule, count(*) AS n, CAST(count(*) FILTER (WHERE bad) AS BIGINT) AS fails, round(1 - count(*) FILTER (WHERE bad) / count(*), 6) AS pass_rate FROM rb GROUP BY rule")
def match_(spark, sf):
    return patterns.match_patterns(bridge.traces(spark, sf), RULES).select("rule", "n", "fails", _r("pass_rate"))


@query("pattern_violations", _rule_sql() + "SELECT trace_id, rule FROM rb WHERE bad")
def violations_(spark, sf):
    return patterns.violations(bridge.traces(spark, sf), RULES)


@query("ask_canned", f"WITH {TRACE_SQL} SELECT trace_id FROM sp WHERE len(regexp_extract_all(spine, '^(read_file )')) > 0")
def ask_(spark, sf):
    return patterns.grep(bridge.traces(spark, sf), patterns.ask("Starts by reading")).select("trace_id")


@query("first_rule_firing", f"WITH {TRACE_SQL}, f AS (SELECT trace_id, n, min(i) AS i FROM (SELECT trace_id, n, atoms, unnest(range(3, n + 1)) AS i FROM sp) WHERE atoms[i] = 'edit' AND atoms[i - 1] = 'edit' AND atoms[i - 2] = 'edit' GROUP BY trace_id, n) SELECT trace_id, CAST(i - 1 AS BIGINT) AS step, CAST(n - i AS BIGINT) AS atoms_saved FROM f")
def first_firing_(spark, sf):
    """The first step at which a forbidden pattern has occurred, and the atoms after it."""
    from ..streaming.monitors import first_firing

    return first_firing(bridge.traces(spark, sf), "(edit ){3,}")


# ---------------------------------------------------------------- vocabularies
def _fit_parts(merges: int, where: str = "true") -> list[str]:
    """Merges by repeated counting in SQL: the characters of tokens are numbered as they are learned. b has the merges, a the tokens, e the encoded trajectories."""
    parts = [TRACE_SQL, f"a0 AS MATERIALIZED (SELECT a AS token, chr(57344 + CAST(row_number() OVER (ORDER BY a) - 1 AS INTEGER)) AS ch, row_number() OVER (ORDER BY a) - 1 AS token_id FROM (SELECT DISTINCT unnest(atoms) AS a FROM tr WHERE {where}))"]
    parts.append(f"e0 AS MATERIALIZED (SELECT trace_id, agent, string_agg(ch, '' ORDER BY i) AS enc FROM (SELECT trace_id, agent, unnest(atoms) AS token, generate_subscripts(atoms, 1) AS i FROM tr WHERE {where}) JOIN a0 USING (token) GROUP BY trace_id, agent)")
    for k in range(merges):
        parts.append(f"p{k} AS (SELECT substring(enc, i, 1) AS l, substring(enc, i + 1, 1) AS r FROM (SELECT enc, unnest(range(1, length(enc))) AS i FROM e{k}))")
        parts.append(f"b{k} AS MATERIALIZED (SELECT x.token AS lt, y.token AS rt, p.l, p.r, p.n FROM (SELECT l, r, count(*) AS n FROM p{k} GROUP BY l, r) p JOIN a{k} x ON x.ch = p.l JOIN a{k} y ON y.ch = p.r ORDER BY n DESC, lt, rt LIMIT 1)")
        parts.append(f"a{k + 1} AS MATERIALIZED (SELECT * FROM a{k} UNION ALL SELECT lt || '▁' || rt, chr({57344 + 100 + k}), {1000 + k} FROM b{k})")
        parts.append(f"e{k + 1} AS MATERIALIZED (SELECT trace_id, agent, replace(enc, l || r, chr({57344 + 100 + k})) AS enc FROM e{k}, b{k})")
    return parts


def _fit_sql(merges: int = 6) -> str:
    rows = " UNION ALL ".join(f'SELECT {k} AS step, lt AS "left", rt AS "right" FROM b{k}' for k in range(merges))
    return f"WITH {', '.join(_fit_parts(merges))} {rows}"


@query("fit_bpe", _fit_sql())
def fit_(spark, sf):
    v = bpe.fit_bpe(bridge.traces(spark, sf), len(ATOMS) + 6)
    return spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(v.merges)], "step int, left string, right string")


@query("encode", f"WITH {_long_sql()} SELECT trace_id, token, CAST(c AS BIGINT) AS n FROM lg WHERE c > 0")
def encode_(spark, sf):
    long = bpe.long_form(_fps(spark, sf))
    return long.join(F.broadcast(FIXED.frame(spark).select("token_id", "token")), "token_id").select("trace_id", "token", "n")


@query("tokenize_lengths", f"WITH {_encoded_sql()} SELECT trace_id, length(enc) AS n_tokens FROM en")
def tokenize_(spark, sf):
    return bpe.tokenize(bridge.traces(spark, sf), FIXED).select("trace_id", F.size("tokens").cast("long").alias("n_tokens"))


@query("fingerprint_entropy", f"WITH {_long_sql()} SELECT trace_id, CAST(sum(c) AS BIGINT) AS total, round(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END), 6) AS entropy FROM lg GROUP BY trace_id")
def entropy_(spark, sf):
    return bpe.with_entropy(_fps(spark, sf)).select("trace_id", "total", _r("entropy"))


# ---------------------------------------------------------------- divergence and statistics
def _matrix_sql(by: str, extra: str = "") -> str:
    return f"""WITH {_long_sql()}, m AS (SELECT {by} AS g, token_id, avg(p) AS p FROM lg {extra} GROUP BY 1, 2)
SELECT a.g AS "row", b.g AS col, round(CASE WHEN a.g = b.g THEN 0 ELSE greatest(0, sum({_term('a.p', 'b.p')}) / ln(2)) END, 6) AS jsd FROM m a JOIN m b USING (token_id) GROUP BY a.g, b.g"""


@query("jsd_matrix_by_agent", _matrix_sql("agent"))
def jsd_agent_(spark, sf):
    return divergence.jsd_matrix(_fps(spark, sf), "agent").select("row", "col", _r("jsd"))


@query("jsd_matrix_by_group", _matrix_sql("grp"))
def jsd_group_(spark, sf):
    return divergence.jsd_matrix(_fps(spark, sf), "group").select("row", "col", _r("jsd"))


@query("jsd_matrix_pooled", f"""WITH {_long_sql()}, c AS (SELECT agent AS g, token_id, sum(c) AS c FROM lg GROUP BY 1, 2), m AS (SELECT g, token_id, c / sum(c) OVER (PARTITION BY g) AS p FROM c)
SELECT a.g AS "row", b.g AS col, round(CASE WHEN a.g = b.g THEN 0 ELSE sum({_term('a.p', 'b.p')}) / ln(2) END, 6) AS jsd FROM m a JOIN m b USING (token_id) GROUP BY a.g, b.g""")
def jsd_pooled_(spark, sf):
    return divergence.jsd_matrix(_fps(spark, sf), "agent", mode="micro").select("row", "col", _r("jsd"))


@query("atom_frequencies", f"""WITH {TRACE_SQL}, x AS (SELECT agent AS g, unnest(atoms) AS atom FROM tr), c AS (SELECT g, atom, count(*) AS n FROM x GROUP BY ALL), t AS (SELECT agent AS g, count(*) AS n_trajectories, CAST(sum(len(atoms)) AS BIGINT) AS n_atoms_total FROM tr GROUP BY 1)
SELECT g, atom, n, round(n / n_trajectories, 6) AS rate, rank, n_trajectories, n_atoms_total FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY n DESC, atom) AS rank FROM c) JOIN t USING (g) WHERE rank <= 5""")
def atom_freq_(spark, sf):
    return stats.atom_frequencies_per_group(bridge.traces(spark, sf), 5, "agent").select("g", "atom", "n", _r("rate"), "rank", "n_trajectories", "n_atoms_total")


@query("effective_vocab_size", f"WITH {_long_sql()}, m AS (SELECT grp AS g, token_id, avg(p) AS p FROM lg GROUP BY 1, 2) SELECT g, round(exp(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)), 6) AS effective_vocab_size FROM m GROUP BY g")
def effective_(spark, sf):
    return stats.effective_vocab_size_per_group(_fps(spark, sf)).select("g", _r("effective_vocab_size"))


@query("entropies_per_group", f"""WITH {_long_sql()}, e AS (SELECT agent AS g, trace_id, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS h FROM lg GROUP BY 1, 2)
SELECT g, count(*) AS n, round(quantile_cont(h, 0.5), 6) AS median, round(quantile_cont(h, 0.25), 6) AS q1, round(quantile_cont(h, 0.75), 6) AS q3, round(min(h), 6) AS min, round(max(h), 6) AS max FROM e GROUP BY g""")
def entropies_(spark, sf):
    return stats.entropies_per_group(_fps(spark, sf), "agent").select("g", "n", *[_r(c) for c in ("median", "q1", "q3", "min", "max")])


def _discriminative_sql(order: str) -> str:
    return f"""WITH {_long_sql()}, m AS (SELECT token_id, token, coalesce(avg(p) FILTER (WHERE agent = '{A}'), 0) AS p_a, coalesce(avg(p) FILTER (WHERE agent = '{B}'), 0) AS p_b FROM lg GROUP BY 1, 2),
s AS (SELECT *, ln((p_a + 1e-6) / (p_b + 1e-6)) AS log_odds, {_term('p_a', 'p_b')} AS jsd_contribution FROM m)
SELECT token, round(p_a, 6) AS p_a, round(p_b, 6) AS p_b, round(log_odds, 6) AS log_odds, round(jsd_contribution, 9) AS jsd_contribution FROM s ORDER BY abs({order}) DESC, token_id LIMIT 5"""


@query("discriminative_log_odds", _discriminative_sql("log_odds"))
def disc_(spark, sf):
    d = stats.discriminative_procedures(_fps(spark, sf), FIXED, A, B, 5, group_by="agent")
    return d.select("token", _r("p_a"), _r("p_b"), _r("log_odds"), _r("jsd_contribution", 9))


@query("discriminative_jsd", _discriminative_sql("jsd_contribution"))
def disc_jsd_(spark, sf):
    d = stats.discriminative_procedures(_fps(spark, sf), FIXED, A, B, 5, ranking="jsd_contribution", group_by="agent")
    return d.select("token", _r("p_a"), _r("p_b"), _r("log_odds"), _r("jsd_contribution", 9))


@query("concentration", f"""WITH {_long_sql()}, m AS (SELECT agent AS g, token_id, avg(p) AS p FROM lg GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY p, token_id) AS i, count(*) OVER (PARTITION BY g) AS n FROM m)
SELECT g, round(sum(p * p), 6) AS hhi, round(2 * sum(i * p) / (max(n) * sum(p)) - (max(n) + 1) / max(n), 6) AS gini FROM r GROUP BY g""")
def concentration_(spark, sf):
    return stats.concentration(_fps(spark, sf), "agent").select("g", _r("hhi"), _r("gini"))


@query("action_mix", f"WITH {EVENT_SQL}, c AS (SELECT agent AS g, atom, count(*) AS n FROM ev GROUP BY ALL) SELECT g, atom, n, round(n / sum(n) OVER (PARTITION BY g), 6) AS share FROM c")
def mix_(spark, sf):
    return stats.action_mix(bridge.traces(spark, sf)).select("g", "atom", "n", _r("share"))


@query("profile", f"""WITH {TRACE_SQL} SELECT agent AS g, count(*) AS n_traces, round(avg(n), 6) AS mean_length, quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, round(1 - count(DISTINCT spine) / count(*), 6) AS exact_dup_rate FROM sp GROUP BY agent""")
def profile_(spark, sf):
    return stats.profile(bridge.traces(spark, sf)).select("g", "n_traces", _r("mean_length"), "p10", "p50", "p90", _r("exact_dup_rate"))


# ---------------------------------------------------------------- lineage
def _side(spark, sf, agent):
    return bridge.traces(spark, sf).where(F.col("agent") == agent)


@query("lineage_vocabulary", f"""WITH {TRACE_SQL}, s AS (SELECT DISTINCT agent, unnest(atoms) AS atom FROM tr WHERE agent IN ('{A}', '{B}')), c AS (SELECT atom, bool_or(agent = '{A}') AS p, bool_or(agent = '{B}') AS c FROM s GROUP BY atom)
SELECT round(count(*) FILTER (WHERE p AND c) / count(*), 6) AS jaccard, coalesce(string_agg(atom, ',' ORDER BY atom) FILTER (WHERE p AND NOT c), '') AS parent_only, coalesce(string_agg(atom, ',' ORDER BY atom) FILTER (WHERE c AND NOT p), '') AS child_only FROM c""")
def lin_vocab_(spark, sf):
    d = lineage.vocabulary_axis(_side(spark, sf, A), _side(spark, sf, B))
    return d.select(_r("jaccard"), F.array_join("parent_only", ",").alias("parent_only"), F.array_join("child_only", ",").alias("child_only"))


_ATOM_ENTROPY = f"""WITH {TRACE_SQL}, x AS (SELECT trace_id, agent, unnest(atoms) AS atom FROM tr), c AS (SELECT trace_id, agent, atom, count(*) AS n FROM x GROUP BY ALL), q AS (SELECT *, n / sum(n) OVER (PARTITION BY trace_id) AS p FROM c), e AS (SELECT trace_id, agent, -sum(p * ln(p)) AS h FROM q GROUP BY ALL) """


@query("lineage_entropy", _ATOM_ENTROPY + f"""SELECT round(avg(h) FILTER (WHERE agent = '{A}') - avg(h) FILTER (WHERE agent = '{B}'), 6) AS entropy_drop, round(avg(h) FILTER (WHERE agent = '{A}'), 6) AS parent_mean, round(avg(h) FILTER (WHERE agent = '{B}'), 6) AS child_mean,
 round(quantile_cont(h, 0.5) FILTER (WHERE agent = '{A}'), 6) AS parent_median, round(quantile_cont(h, 0.5) FILTER (WHERE agent = '{B}'), 6) AS child_median FROM e""")
def lin_entropy_(spark, sf):
    d = lineage.entropy_axis(_side(spark, sf, A), _side(spark, sf, B))
    return d.select(*[_r(c) for c in d.columns])


def _conditional_sql(k: int) -> str:
    prefix = "array_to_string(atoms[i - %d : i - 1], ' ')" % k
    return f"""WITH {TRACE_SQL}, x AS (SELECT agent, {prefix} AS prefix, atoms[i] AS nxt FROM (SELECT agent, atoms, unnest(range({k + 1}, len(atoms) + 1)) AS i FROM tr WHERE agent IN ('{A}', '{B}'))),
w AS (SELECT prefix, nxt, count(*) FILTER (WHERE agent = '{A}') AS p, count(*) FILTER (WHERE agent = '{B}') AS c FROM x GROUP BY ALL), s AS (SELECT *, sum(p) OVER (PARTITION BY prefix) AS np, sum(c) OVER (PARTITION BY prefix) AS nc FROM w),
d AS (SELECT prefix, max(np) AS np, max(nc) AS nc, CASE WHEN max(np) > 0 AND max(nc) > 0 THEN greatest(0, sum({_term('(p / greatest(np, 1))', '(c / greatest(nc, 1))')}) / ln(2)) END AS jsd FROM s GROUP BY prefix) """


@query("lineage_conditional", _conditional_sql(1) + "SELECT round(sum(jsd * np) FILTER (WHERE jsd IS NOT NULL) / sum(np) FILTER (WHERE jsd IS NOT NULL), 6) AS conditional_jsd, count(jsd) AS shared_prefixes, CAST(count(*) FILTER (WHERE nc = 0) AS BIGINT) AS parent_only_prefixes, CAST(count(*) FILTER (WHERE np = 0) AS BIGINT) AS child_only_prefixes FROM d")
def lin_cond_(spark, sf):
    d = lineage.conditional_axis(_side(spark, sf, A), _side(spark, sf, B))
    return d.select(_r("conditional_jsd"), "shared_prefixes", "parent_only_prefixes", "child_only_prefixes")


@query("conditional_prefixes_k2", _conditional_sql(2) + "SELECT prefix, CAST(np AS BIGINT) AS parent_n, CAST(nc AS BIGINT) AS child_n, round(jsd, 6) AS jsd FROM d")
def lin_prefix_(spark, sf):
    return lineage.conditional_prefixes(_side(spark, sf, A), _side(spark, sf, B), 2).select("prefix", "parent_n", "child_n", _r("jsd"))


@query("lineage_outcome", f"""WITH {TRACE_SQL}, x AS (SELECT DISTINCT agent, resolved, unnest(atoms) AS atom FROM tr WHERE agent IN ('{A}', '{B}')), s AS (SELECT resolved, atom, count(*) AS sides FROM x GROUP BY ALL),
j AS (SELECT round(coalesce(count(*) FILTER (WHERE resolved AND sides = 2) / nullif(count(*) FILTER (WHERE resolved), 0), 1), 6) AS pass_vocab_jaccard, round(coalesce(count(*) FILTER (WHERE NOT resolved AND sides = 2) / nullif(count(*) FILTER (WHERE NOT resolved), 0), 1), 6) AS fail_vocab_jaccard FROM s)
SELECT CAST(count(*) FILTER (WHERE agent = '{A}' AND resolved) AS BIGINT) AS parent_pass_n, CAST(count(*) FILTER (WHERE agent = '{A}' AND NOT resolved) AS BIGINT) AS parent_fail_n, CAST(count(*) FILTER (WHERE agent = '{B}' AND resolved) AS BIGINT) AS child_pass_n, CAST(count(*) FILTER (WHERE agent = '{B}' AND NOT resolved) AS BIGINT) AS child_fail_n, any_value(pass_vocab_jaccard) AS pass_vocab_jaccard, any_value(fail_vocab_jaccard) AS fail_vocab_jaccard FROM tr, j""")
def lin_outcome_(spark, sf):
    d = lineage.outcome_axis(_side(spark, sf, A), _side(spark, sf, B), "resolved")
    return d.select("parent_pass_n", "parent_fail_n", "child_pass_n", "child_fail_n", _r("pass_vocab_jaccard"), _r("fail_vocab_jaccard"))


@query("transitions", f"WITH {TRACE_SQL} SELECT atoms[i - 1] AS prefix, atoms[i] AS next, count(*) AS n FROM (SELECT atoms, unnest(range(2, len(atoms) + 1)) AS i FROM tr) GROUP BY ALL")
def transitions_(spark, sf):
    return lineage.transitions(bridge.traces(spark, sf))


def _floor_sql() -> str:
    """Each axis between every two of three scaffolds, by the axes' own SQL with the scaffolds in the agents' place."""
    rows = []
    for a, b in (("s0", "s1"), ("s0", "s2"), ("s1", "s2")):
        for axis, name, value in (("vocabulary", "lineage_vocabulary", "jaccard"), ("entropy", "lineage_entropy", "entropy_drop"), ("conditional", "lineage_conditional", "conditional_jsd")):
            own = SQL[name].replace("'agent_' || (user_id % 4)", "'s' || (user_id % 3)").replace(A, a).replace(B, b)
            rows.append(f"SELECT '{axis}' AS axis, abs({value}) AS v FROM ({own})")
    return f"SELECT axis, round(min(v), 4) AS least, round(avg(v), 4) AS mean, round(max(v), 4) AS most FROM ({' UNION ALL '.join(rows)}) GROUP BY axis"


@query("noise_floor_metadata", _floor_sql())
def lineage_floor_(spark, sf):
    t = bridge.traces(spark, sf).withColumn("metadata", F.map_concat("metadata", F.create_map(F.lit("scaffold"), F.concat(F.lit("s"), F.col("_ord") % 3))))
    rows = [(r["axis"], float(r["min"]), float(r["mean"]), float(r["max"])) for r in lineage.noise_floor(t, "scaffold")]
    return spark.createDataFrame(rows, "axis string, least double, mean double, most double").select("axis", *[_r(c, 4) for c in ("least", "mean", "most")])


# ---------------------------------------------------------------- scoring
SPEC = scoring.Spec(
    (scoring.Phase("verification", 0.3, ("run_test",), min_count=5), scoring.Phase("look_first", 0.4, ("search_repo", "read_file"), "edit"), scoring.Phase("test_before_submit", 0.3, ("run_test",), "submit")),
    (scoring.Penalty("streak", 0.2, max_run=2), scoring.Penalty("double_error", 0.1, forbid_sequence=("error", "error", "error"))),
)
_SCORE_SQL = f"""WITH {TRACE_SQL}, f AS (SELECT *, CASE WHEN list_position(atoms, 'edit') > 0 THEN list_position(atoms, 'edit') ELSE n + 1 END AS ie, CASE WHEN list_position(atoms, 'submit') > 0 THEN list_position(atoms, 'submit') ELSE n + 1 END AS isub FROM sp),
sc AS (SELECT *, len(list_filter(atoms, lambda a: a = 'run_test')) >= 5 AS v, list_has_any(atoms[1 : ie - 1], ['search_repo', 'read_file']) AS l, list_contains(atoms[1 : isub - 1], 'run_test') AS t, regexp_matches(spine, '(edit ){{3,}}') AS s, regexp_matches(spine, '(^| )error error error ') AS d FROM f),
ra AS (SELECT *, CASE WHEN v THEN 0.3 ELSE 0 END + CASE WHEN l THEN 0.4 ELSE 0 END + CASE WHEN t THEN 0.3 ELSE 0 END - CASE WHEN s THEN 0.2 ELSE 0 END - CASE WHEN d THEN 0.1 ELSE 0 END AS raw FROM sc) """


@query("score", _SCORE_SQL + "SELECT trace_id, round(CAST(raw AS DOUBLE), 4) AS raw, round(CAST(greatest(0, least(1, raw)) AS DOUBLE), 4) AS score, concat_ws(',', CASE WHEN v THEN 'verification' END, CASE WHEN l THEN 'look_first' END, CASE WHEN t THEN 'test_before_submit' END) AS phases, concat_ws(',', CASE WHEN s THEN 'streak' END, CASE WHEN d THEN 'double_error' END) AS penalties FROM ra")
def score_(spark, sf):
    s = SPEC.score(bridge.traces(spark, sf))
    return s.select("trace_id", "raw", "score", F.array_join("satisfied_phases", ",").alias("phases"), F.array_join("triggered_penalties", ",").alias("penalties"))


@query("score_by_agent", _SCORE_SQL + "SELECT agent, round(avg(CAST(greatest(0, least(1, raw)) AS DOUBLE)), 6) AS mean_score FROM ra GROUP BY agent")
def score_agent_(spark, sf):
    return SPEC.score(bridge.traces(spark, sf)).groupBy("agent").agg(F.round(F.avg("score"), 6).alias("mean_score"))


@query("guard_check", f"WITH {TRACE_SQL} SELECT trace_id, concat_ws(',', CASE WHEN regexp_matches(spine, '(?:edit ){{3,}}') THEN 'streak' END, CASE WHEN regexp_matches(spine, '(?:^| )error error error(?: |$)') THEN 'double_error' END) AS violated FROM sp")
def guard_(spark, sf):
    return bridge.traces(spark, sf).select("trace_id", F.array_join(scoring.guard_violations(SPEC, F.col("atoms")), ",").alias("violated"))


@query("decode_mask", f"""WITH {TRACE_SQL} SELECT trace_id, array_to_string(list_filter({sorted(scoring.ATOMS)!r}, lambda a: NOT (a = 'edit' AND regexp_matches(spine, '(^| )edit edit $')) AND NOT (a = 'error' AND regexp_matches(spine, '(^| )error error $'))), ',') AS allowed FROM sp""")
def decode_(spark, sf):
    return bridge.traces(spark, sf).select("trace_id", F.array_join(scoring.allowed_next(SPEC, F.col("atoms")), ",").alias("allowed"))


@query("step_rewards", f"""WITH {TRACE_SQL}, x AS (SELECT trace_id, atoms, n, unnest(range(1, n + 1)) AS i FROM sp),
y AS (SELECT trace_id, i, atoms[i] AS a, atoms[i] = 'edit' AND i > 2 AND atoms[i - 1] = 'edit' AND atoms[i - 2] = 'edit' AS s3, atoms[i] = 'error' AND i > 2 AND atoms[i - 1] = 'error' AND atoms[i - 2] = 'error' AS e3 FROM x),
f AS (SELECT trace_id, coalesce(min(i) FILTER (WHERE a = 'edit'), 1000000000) AS ie, coalesce(min(i) FILTER (WHERE a = 'submit'), 1000000000) AS isub, coalesce(min(i) FILTER (WHERE a IN ('search_repo', 'read_file')), 1000000000) AS il, coalesce(min(i) FILTER (WHERE a = 'run_test'), 1000000000) AS it, coalesce(min(i) FILTER (WHERE s3), 1000000000) AS ist, coalesce(min(i) FILTER (WHERE e3), 1000000000) AS ierr FROM y GROUP BY trace_id),
g AS (SELECT trace_id, i, CASE WHEN count(*) FILTER (WHERE a = 'run_test') OVER (PARTITION BY trace_id ORDER BY i) >= 5 THEN 0.3 ELSE 0 END + CASE WHEN il <= i AND il < ie THEN 0.4 ELSE 0 END + CASE WHEN it <= i AND it < isub THEN 0.3 ELSE 0 END - CASE WHEN ist <= i THEN 0.2 ELSE 0 END - CASE WHEN ierr <= i THEN 0.1 ELSE 0 END AS raw FROM y JOIN f USING (trace_id)),
h AS (SELECT trace_id, i, round(CAST(greatest(0, least(1, raw)) AS DOUBLE), 4) AS score FROM g)
SELECT trace_id, CAST(i - 1 AS INTEGER) AS step, round(score - lag(score, 1, 0) OVER (PARTITION BY trace_id ORDER BY i), 6) AS reward FROM h""")
def steps_(spark, sf):
    return bridge.traces(spark, sf).select("trace_id", F.posexplode(scoring.step_rewards(SPEC, F.col("atoms"))).alias("step", "reward")).select("trace_id", "step", _r("reward"))


_WIN_SQL = f"""WITH {_long_sql()}, w0 AS (SELECT agent, trace_id, resolved, atoms, spine, list_position(atoms, 'edit') AS ie, list_position(atoms, 'submit') AS isub, n FROM sp),
w1 AS (SELECT *, CASE WHEN ie > 0 THEN CAST(list_contains(atoms[ie + 1 : n], 'run_test') AS DOUBLE) END AS v, CASE WHEN isub > 0 THEN CAST(list_contains(atoms[1 : isub - 1], 'run_test') AS DOUBLE) END AS b, CASE WHEN ie > 0 THEN CAST(list_has_any(atoms[1 : ie - 1], ['search_repo', 'read_file']) AS DOUBLE) END AS x, list_max(list_transform(regexp_extract_all(spine, '(?:edit )+'), lambda q: len(q) // 5)) AS run FROM w0),
w2 AS (SELECT resolved, coalesce(avg(v), 0) AS v, coalesce(avg(b), 0) AS b, coalesce(avg(x), 0) AS x, quantile_cont(run, 0.9) AS cap FROM w1 GROUP BY resolved), wl AS (SELECT w.v AS wv, l.v AS lv, w.b AS wb, l.b AS lb, w.x AS wx, l.x AS lx, w.cap AS cap FROM w2 w LEFT JOIN w2 l ON NOT l.resolved WHERE w.resolved),
w3 AS (SELECT 'verification' AS name, 0.25 AS reward, wv AS w, lv AS l FROM wl UNION ALL SELECT 'validation_before_submit', 0.15, wb, lb FROM wl UNION ALL SELECT 'exploration', 0.1, wx, lx FROM wl),
w4 AS (SELECT name, reward FROM w3 WHERE CASE WHEN l IS NULL THEN w >= 0.65 ELSE w >= 0.5 AND w - l >= 0.15 END), w5 AS (SELECT * FROM w4 UNION ALL SELECT 'verification', 0.25 WHERE NOT EXISTS (SELECT * FROM w4)) """


@query("spec_from_winners", _WIN_SQL + "SELECT 'phase' AS part, name, CAST(reward AS DOUBLE) AS reward FROM w5 UNION ALL SELECT 'penalty', 'edit_streak:' || CAST(greatest(3, least(10, round_even(cap, 0))) AS INTEGER), 0.15 FROM wl WHERE cap IS NOT NULL")
def winners_(spark, sf):
    t = bridge.traces(spark, sf)
    s = scoring.Spec.from_winners(t, FIXED)
    rows = [("phase", p.name, p.reward) for p in s.phases] + [("penalty", f"{q.name}:{q.max_run}", q.reward) for q in s.penalties]
    return spark.createDataFrame(rows, "part string, name string, reward double")


@query("verify_arms", f"""WITH {_long_sql()}, c AS (SELECT token_id, sum(c) FILTER (WHERE resolved) AS t, sum(c) FILTER (WHERE agent IN ('agent_0', 'agent_1')) AS b, sum(c) FILTER (WHERE agent IN ('agent_2', 'agent_3')) AS a FROM lg GROUP BY token_id), p AS (SELECT coalesce(t, 0) / sum(t) OVER () AS t, coalesce(b, 0) / sum(b) OVER () AS b, coalesce(a, 0) / sum(a) OVER () AS a FROM c),
d AS (SELECT sum({_term('b', 't')}) / ln(2) AS jb, sum({_term('a', 't')}) / ln(2) AS ja FROM p), r AS (SELECT avg(CAST(CAST(resolved AS INTEGER) AS DOUBLE)) FILTER (WHERE agent IN ('agent_2', 'agent_3')) - avg(CAST(CAST(resolved AS INTEGER) AS DOUBLE)) FILTER (WHERE agent IN ('agent_0', 'agent_1')) AS delta FROM sp)
SELECT jb - ja > 1e-3 AS behavior_moved, round(jb, 6) AS jsd_before, round(ja, 6) AS jsd_after, round(delta, 6) AS outcome_delta, CASE WHEN NOT jb - ja > 1e-3 THEN 'weak_enforcement' WHEN delta > 0 THEN 'lever' ELSE 'epiphenomenal' END AS verdict FROM d, r""")
def verify_(spark, sf):
    t = bridge.traces(spark, sf)
    s = scoring.Spec.from_winners(t, FIXED)
    d = scoring.verify(t.where("agent in ('agent_0', 'agent_1')"), t.where("agent in ('agent_2', 'agent_3')"), s, FIXED)
    return d.select("behavior_moved", _r("jsd_before"), _r("jsd_after"), _r("outcome_delta"), "verdict")


@query("optimize_spec")
def optimize_(spark, sf):
    best, report = scoring.optimize(SPEC, bridge.traces(spark, sf))
    return spark.createDataFrame([(",".join(p.name for p in best.phases), report["edit_streak_cap"], float(report["best_val_score"]))], "phases string, cap int, val_score double")


# ---------------------------------------------------------------- comparison studies
def _smooth(src: str, over: str) -> str:
    return f"""n AS (SELECT unit, count(*) FILTER (WHERE agent = '{A}') AS na, count(*) FILTER (WHERE agent = '{B}') AS nb FROM ({src}) GROUP BY unit), v AS ({over}), k AS (SELECT unit, (coalesce(na, 0) + 1e-9) AS a, (coalesce(nb, 0) + 1e-9) AS b FROM v LEFT JOIN n USING (unit)), z AS (SELECT unit, a / sum(a) OVER () AS p, b / sum(b) OVER () AS q FROM k)"""


_UNI = "SELECT agent, unnest(atoms) AS unit FROM tr"
_BI = "SELECT agent, atoms[i] || '|' || atoms[i + 1] AS unit FROM (SELECT agent, atoms, unnest(range(1, len(atoms))) AS i FROM tr)"


@query("compare_unigram", f"WITH {TRACE_SQL}, {_smooth(_UNI, 'SELECT unnest(' + repr(list(compare.CANONICAL)) + ') AS unit')} SELECT round(sum({_term('p', 'q')}), 6) AS jsd_nats FROM z")
def cmp_uni_(spark, sf):
    return compare.unigram_jsd(bridge.traces(spark, sf), A, B).select(_r("jsd_nats"))


@query("compare_bigram", f"WITH {TRACE_SQL}, {_smooth(_BI, 'SELECT unit FROM n WHERE na + nb > 0')} SELECT round(sum({_term('p', 'q')}), 6) AS jsd_nats FROM z")
def cmp_bi_(spark, sf):
    return compare.bigram_jsd(bridge.traces(spark, sf), A, B).select(_r("jsd_nats"))


@query("bigram_signature", f"""WITH {TRACE_SQL}, {_smooth(_BI, 'SELECT unit FROM n WHERE na + nb > 0')}, r AS (SELECT unit AS bigram, CASE WHEN p > q THEN '{A}' ELSE '{B}' END AS side, p - q AS delta_p FROM z WHERE p <> q)
SELECT bigram, side, round(delta_p, 6) AS delta_p FROM (SELECT *, row_number() OVER (PARTITION BY side ORDER BY abs(delta_p) DESC, bigram) AS rank FROM r) WHERE rank <= 5""")
def signature_(spark, sf):
    return compare.bigram_signature(bridge.traces(spark, sf), A, B).select("bigram", "side", _r("delta_p"))


@query("positional_curve", f"""WITH {TRACE_SQL}, x AS (SELECT agent, i - 1 AS step, atoms[i] AS unit FROM (SELECT agent, atoms, unnest(range(1, least(len(atoms), 40) + 1)) AS i FROM tr WHERE agent IN ('{A}', '{B}'))),
re AS (SELECT step, count(*) FILTER (WHERE agent = '{A}') AS ra, count(*) FILTER (WHERE agent = '{B}') AS rb FROM x GROUP BY step), st AS (SELECT coalesce(min(step), 40) AS stop FROM re WHERE ra < 10 OR rb < 10),
u AS (SELECT step, unit FROM (SELECT DISTINCT step FROM x), (SELECT unnest({list(compare.CANONICAL)!r}) AS unit)), c AS (SELECT step, unit, count(*) FILTER (WHERE agent = '{A}') AS na, count(*) FILTER (WHERE agent = '{B}') AS nb FROM x GROUP BY ALL),
k AS (SELECT step, unit, coalesce(na, 0) + 1e-9 AS a, coalesce(nb, 0) + 1e-9 AS b FROM u LEFT JOIN c USING (step, unit)), z AS (SELECT step, a / sum(a) OVER (PARTITION BY step) AS p, b / sum(b) OVER (PARTITION BY step) AS q FROM k)
SELECT CAST(step AS INTEGER) AS step, round(sum({_term('p', 'q')}), 6) AS jsd_nats FROM z, st WHERE step < stop GROUP BY step""")
def positional_(spark, sf):
    return compare.positional_curve(bridge.traces(spark, sf), A, B).select("step", _r("jsd_nats"))


@query("decile_counts", f"WITH {TRACE_SQL} SELECT agent AS g, CAST(least(floor((i - 1) * 10 / len(atoms)), 9) AS INTEGER) AS decile, atoms[i] AS atom, count(*) AS n FROM (SELECT agent, atoms, unnest(range(1, len(atoms) + 1)) AS i FROM tr) GROUP BY ALL")
def decile_(spark, sf):
    return compare.decile_counts(bridge.traces(spark, sf))


@query("behavior_features", f"""WITH {TRACE_SQL}, f AS (SELECT *, CASE WHEN list_position(atoms, 'edit') > 0 THEN list_position(atoms, 'edit') ELSE n + 1 END AS ie, CASE WHEN list_position(atoms, 'search_repo') > 0 THEN list_position(atoms, 'search_repo') ELSE n + 1 END AS isr, atoms[1 : greatest(1, n // 3)] AS early, list_zip(atoms[1 : n - 1], atoms[2 : n]) AS steps FROM sp)
SELECT trace_id, agent, CAST(n AS INTEGER) AS n_steps, isr < ie AS search_first, CAST(len(list_filter(atoms[1 : ie - 1], lambda a: a = 'read_file')) AS INTEGER) AS reads_before_edit, CAST(coalesce(list_max(list_transform(regexp_extract_all(spine, '(?:edit )+'), lambda x: len(x) // 5)), 0) AS INTEGER) AS edit_run_max,
 round(CASE WHEN n > 0 THEN len(list_filter(early, lambda a: a = 'think')) / len(early) ELSE 0 END, 6) AS think_early_frac,
 round(CASE WHEN list_contains(atoms, 'error') THEN len(list_filter(steps, lambda s: s[1] = 'error' AND s[2] <> 'error')) / len(list_filter(atoms, lambda a: a = 'error')) ELSE 0 END, 6) AS error_recovery_rate,
 round(CASE WHEN n >= 2 THEN len(list_filter(steps, lambda s: (s[1] = 'edit' AND s[2] = 'run_test') OR (s[1] = 'run_test' AND s[2] = 'edit'))) / (n - 1) ELSE 0 END, 6) AS interleave_score FROM f""")
def behavior_(spark, sf):
    d = compare.behavior_features(bridge.traces(spark, sf))
    return d.select(*d.columns[:-3], *[_r(c) for c in d.columns[-3:]])


@query("out_of_distribution", f"""WITH {TRACE_SQL}, x AS (SELECT trace_id, agent, list_filter(atoms, lambda a: a <> 'think') AS atoms FROM tr), y AS (SELECT trace_id, agent, unnest(atoms) AS atom, len(atoms) AS n FROM x WHERE len(atoms) > 0), o AS (SELECT trace_id, agent, atom, count(*) / max(n) AS p FROM y GROUP BY ALL),
m AS (SELECT agent, atom, sum(p) / (SELECT count(*) FROM x w WHERE w.agent = o.agent AND len(w.atoms) > 0) AS q FROM o GROUP BY agent, atom), f AS (SELECT t.trace_id, t.agent, m.q, coalesce(o.p, 0) AS p FROM (SELECT DISTINCT trace_id, agent FROM o) t JOIN m USING (agent) LEFT JOIN o ON o.trace_id = t.trace_id AND o.atom = m.atom)
SELECT trace_id, agent AS g, round(greatest(0, sum({_term('p', 'q')}) / ln(2)), 6) AS jsd_bits FROM f GROUP BY trace_id, agent""")
def ood_(spark, sf):
    return compare.out_of_distribution(bridge.traces(spark, sf)).select("trace_id", "g", _r("jsd_bits"))


@query("nearest_group", f"""WITH {TRACE_SQL}, y AS (SELECT trace_id, agent, unnest(atoms) AS atom, len(atoms) AS n FROM tr WHERE len(atoms) > 0), o AS (SELECT trace_id, agent, atom, count(*) / max(n) AS p FROM y GROUP BY ALL),
m AS (SELECT agent AS other, atom, sum(p) / (SELECT count(*) FROM tr w WHERE w.agent = o.agent AND len(w.atoms) > 0) AS q FROM o GROUP BY agent, atom), v AS (SELECT DISTINCT atom FROM o), g AS (SELECT DISTINCT other FROM m),
f AS (SELECT t.trace_id, t.agent, g.other, coalesce(m.q, 0) AS q, coalesce(o.p, 0) AS p FROM (SELECT DISTINCT trace_id, agent FROM o) t JOIN g ON g.other <> t.agent CROSS JOIN v LEFT JOIN m ON m.other = g.other AND m.atom = v.atom LEFT JOIN o ON o.trace_id = t.trace_id AND o.atom = v.atom),
d AS (SELECT trace_id, agent, other, greatest(0, sum({_term('p', 'q')}) / ln(2)) AS d FROM f GROUP BY ALL) SELECT trace_id, agent AS g, arg_min(other, (d, other)) AS nearest, round(min(d), 6) AS jsd_bits FROM d GROUP BY trace_id, agent""")
def nearest_(spark, sf):
    return compare.nearest_group(bridge.traces(spark, sf)).select("trace_id", "g", "nearest", _r("jsd_bits"))


def _matched_sql() -> str:
    names = list(compare.PAIR_ALPHABET)
    mix = lambda x: f"list_transform({names!r}, lambda a: (len(list_filter({x}, lambda z: z = a)) + 1e-9))"
    share = lambda x: f"list_transform({x}, lambda c: c / list_sum({x}))"
    return f"""WITH {TRACE_SQL}, l AS (SELECT instance_id AS k, agent, arg_max(trace_id, user_id) AS trace_id, arg_max(atoms, user_id) AS atoms, arg_max(resolved, user_id) AS won FROM tr WHERE agent IN ('{A}', '{B}') GROUP BY 1, 2),
j AS (SELECT x.k, x.trace_id AS trace_a, y.trace_id AS trace_b, x.won AS resolved_a, y.won AS resolved_b, x.won = y.won AS same_outcome, len(x.atoms) AS len_a, len(y.atoms) AS len_b, {mix('x.atoms')} AS ca, {mix('y.atoms')} AS cb FROM l x JOIN l y ON x.k = y.k AND x.agent = '{A}' AND y.agent = '{B}'),
d AS (SELECT * EXCLUDE (ca, cb), list_sum(list_transform(list_zip({share('ca')}, {share('cb')}), lambda z: {_term('z[1]', 'z[2]')})) AS jsd FROM j),
c AS (SELECT quantile_cont(jsd, 0.25) AS q25, quantile_cont(jsd, 0.75) AS q75 FROM d),
s AS (SELECT d.*, CASE WHEN same_outcome AND jsd >= q75 THEN 'sodp' WHEN NOT same_outcome AND jsd <= q25 THEN 'dosp' ELSE '' END AS stratum FROM d, c) """


@query("matched_pairs", _matched_sql() + "SELECT k, trace_a, trace_b, resolved_a, resolved_b, same_outcome, round(jsd, 6) AS jsd, CAST(len_a AS INTEGER) AS len_a, CAST(len_b AS INTEGER) AS len_b, stratum FROM s")
def matched_(spark, sf):
    return compare.matched_pairs(bridge.traces(spark, sf), A, B).drop("lcs_ratio").withColumn("jsd", F.round("jsd", 6))


@query("matched_order")
def matched_order_(spark, sf):
    """Likeness of order within matched pairs; tested against a plain table of subsequence lengths."""
    return compare.matched_pairs(bridge.traces(spark, sf), A, B).select("k", "trace_a", "trace_b", "lcs_ratio")


@query("matched_summary", _matched_sql() + "SELECT count(*) AS n_matched, CAST(count(*) FILTER (WHERE resolved_a AND resolved_b) AS BIGINT) AS n_both_pass, CAST(count(*) FILTER (WHERE NOT resolved_a AND NOT resolved_b) AS BIGINT) AS n_both_fail, CAST(count(*) FILTER (WHERE resolved_a AND NOT resolved_b) AS BIGINT) AS n_a_only, CAST(count(*) FILTER (WHERE resolved_b AND NOT resolved_a) AS BIGINT) AS n_b_only, round(avg(jsd), 6) AS mean_jsd, round(quantile_cont(jsd, 0.25), 6) AS q25_jsd, round(quantile_cont(jsd, 0.75), 6) AS q75_jsd, CAST(count(*) FILTER (WHERE stratum = 'sodp') AS BIGINT) AS n_sodp, CAST(count(*) FILTER (WHERE stratum = 'dosp') AS BIGINT) AS n_dosp FROM s")
def matched_summary_(spark, sf):
    d = compare.matched_summary(compare.matched_pairs(bridge.traces(spark, sf), A, B))
    return d.select(*[_r(c) if c.endswith("jsd") else c for c in d.columns])


def _family(p, q):
    return [D.jsd(p, q).alias("jsd"), D.total_variation(p, q).alias("tv"), D.hellinger(p, q).alias("hellinger"), D.symmetric_kl(p, q).alias("kl"), D.cosine_distance(p, q).alias("cosine")]


@query("divergence_family", f"""WITH {_long_sql()}, m AS (SELECT token_id, avg(p) FILTER (WHERE agent = '{A}') AS p, avg(p) FILTER (WHERE agent = '{B}') AS q FROM lg GROUP BY 1)
SELECT round(sum({_term('p', 'q')}) / ln(2), 6) AS jsd, round(sum(abs(p - q)) / 2, 6) AS tv, round(sqrt(sum(pow(sqrt(p) - sqrt(q), 2)) / 2), 6) AS hellinger, round(sum((p - q) * ln((p + 1e-9) / (q + 1e-9))), 6) AS kl, round(1 - sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q))), 6) AS cosine FROM m""")
def family_(spark, sf):
    m = divergence.group_means(_fps(spark, sf), "agent").where(F.col("g").isin(A, B))
    # two vectors, one per group, of the vocabulary's length
    v = m.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("token_id", "p"))).alias("v"))
    one = v.agg(F.max(F.when(F.col("g") == A, F.col("v.p"))).alias("p"), F.max(F.when(F.col("g") == B, F.col("v.p"))).alias("q"))
    d = one.select(*_family(F.col("p"), F.col("q")))
    return d.select(*[_r(c) for c in d.columns])


@query("drift_by_third", f"""WITH {TRACE_SQL}, t AS (SELECT agent, 'early' AS third, atoms[1 : n // 3] AS x FROM sp UNION ALL SELECT agent, 'middle', atoms[n // 3 + 1 : n * 2 // 3] FROM sp UNION ALL SELECT agent, 'late', atoms[n * 2 // 3 + 1 : n] FROM sp)
SELECT third AS g, atom, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY third), 6) AS share FROM (SELECT third, unnest(x) AS atom FROM t) GROUP BY third, atom""")
def drift_(spark, sf):
    return stats.action_mix(summary.drift(bridge.traces(spark, sf)), "group").select("g", "atom", "n", _r("share"))


# ---------------------------------------------------------------- summaries
@query("autonomy_runlength", f"""WITH {TRACE_SQL}, x AS (SELECT agent, trace_id, atoms, unnest(range(1, len(atoms) + 1)) AS i FROM tr), y AS (SELECT agent, trace_id, atoms[i] AS a, count(*) FILTER (WHERE atoms[i] = 'prompt_ai') OVER (PARTITION BY trace_id ORDER BY i) AS seg FROM x),
r AS (SELECT agent, trace_id, seg, count(*) AS run FROM y WHERE a <> 'prompt_ai' GROUP BY ALL), s AS (SELECT agent, list_sort(list(run)) AS l FROM r GROUP BY agent)
SELECT agent, len(l) AS n_runs, round(list_avg(l), 6) AS mean, list_median(l) AS median, l[CAST(floor(len(l) * 0.9) AS INTEGER) + 1] AS p90, list_max(l) AS max FROM s""")
def autonomy_(spark, sf):
    d = summary.autonomy_runlength(bridge.traces(spark, sf), "agent")
    return d.select("agent", "n_runs", _r("mean"), F.col("median").cast("double").alias("median"), F.col("p90").cast("long").alias("p90"), F.col("max").cast("long").alias("max"))


@query("exact_duplicates", f"WITH {SESSION_SQL} SELECT agent, count(*) AS n_traces, count(DISTINCT array_to_string(atoms, ' ')) AS n_exact_unique, round(1 - count(DISTINCT array_to_string(atoms, ' ')) / count(*), 6) AS exact_duplicate_rate FROM ses GROUP BY agent")
def dup_(spark, sf):
    return curate.exact_duplicate_rate(bridge.session_traces(spark, sf), "agent").select("agent", "n_traces", "n_exact_unique", _r("exact_duplicate_rate"))


@query("curate")
def curate_(spark, sf):
    c = curate.curate(bridge.traces(spark, sf), vocab_size=24, near_dup_jsd=0.1)
    return spark.createDataFrame([(c.n_traces, c.n_exact_unique, c.n_near_clusters, len(c.subset), c.coverage_diverse, c.mean_jsd_diverse)], "n_traces long, n_exact_unique long, n_near_clusters long, subset long, coverage double, mean_jsd double")


@query("dataset_stats", _ATOM_ENTROPY + ", sz AS (SELECT count(*) AS n, count(DISTINCT agent) AS n_models, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS median_length, CAST(floor(quantile_cont(len(list_filter(atoms, lambda a: a = 'think')), 0.5)) AS BIGINT) AS median_think, round(1 - count(DISTINCT spine) / count(*), 6) AS dup_rate FROM sp) SELECT n, n_models, (SELECT round(avg(h / ln(2)), 6) FROM e) AS mean_entropy_bits, median_length, median_think, dup_rate FROM sz")
def dataset_stats_(spark, sf):
    return summary.dataset_stats(bridge.traces(spark, sf)).select("n", "n_models", _r("mean_entropy_bits"), "median_length", "median_think", _r("dup_rate"))


@query("top_procedures", f"""WITH {_long_sql()}, c AS (SELECT token_id, token, sum(c) AS n FROM lg GROUP BY ALL) SELECT token, CAST(n AS BIGINT) AS n, round(n / (SELECT sum(n) FROM c), 6) AS share FROM c WHERE token_id >= {len(ATOMS)} AND n > 0 ORDER BY n DESC, token LIMIT 5""")
def procedures_(spark, sf):
    return summary.top_procedures(_fps(spark, sf), FIXED, 5).select("token", "n", _r("share"))


def _variance_sql(factors: dict[str, str]) -> str:
    """Over all pairs where there are at most 800 trajectories, the operator's sample; the factors are columns of tr."""
    rows = " UNION ALL ".join(f"SELECT '{name}' AS factor, (SELECT coalesce(sum(s / m), 0) FROM (SELECT x.{c} AS v, sum(d2) AS s FROM d JOIN k x ON x.trace_id = i JOIN k y ON y.trace_id = j WHERE x.{c} IS NOT DISTINCT FROM y.{c} GROUP BY 1) w JOIN (SELECT {c} AS v, count(*) AS m FROM k GROUP BY 1) z ON w.v IS NOT DISTINCT FROM z.v) AS within" for name, c in factors.items())
    return f"""WITH {_long_sql()}, k AS (SELECT trace_id, {', '.join(factors.values())} FROM tr), d AS (SELECT a.trace_id AS i, b.trace_id AS j, pow(greatest(0, sum({_term('a.p', 'b.p')}) / ln(2)), 2) AS d2 FROM lg a JOIN lg b ON a.token_id = b.token_id AND a.trace_id < b.trace_id GROUP BY ALL), f AS ({rows})
SELECT factor, round(1 - within / (SELECT sum(d2) / (SELECT count(*) FROM k) FROM d), 6) AS r2 FROM f"""


@query("variance_decomposition", _variance_sql({"resolved": "resolved", "instance_id": "instance_id"}))
def variance_(spark, sf):
    return summary.variance_decomposition(_fps(spark, sf), ["resolved", "instance_id"]).select("factor", _r("r2"))


@query("report_agents", f"""WITH {', '.join(_fit_parts(8))}, x AS (SELECT trace_id, agent, length(enc) AS m, unnest(string_split(enc, '')) AS ch FROM e8), y AS (SELECT trace_id, agent, count(*) / any_value(m) AS p FROM x WHERE ch <> '' GROUP BY trace_id, agent, ch), h AS (SELECT trace_id, -sum(p * ln(p)) AS h FROM y GROUP BY trace_id)
SELECT agent, count(*) AS n_traces, quantile_cont(n, 0.5) AS median_length, round(avg(h), 6) AS mean_entropy, round(1 - count(DISTINCT spine) / count(*), 6) AS exact_dup_rate FROM sp JOIN h USING (trace_id) GROUP BY agent""")
def report_(spark, sf):
    d = summary.build_report(bridge.traces(spark, sf), vocab_size=16)["agents"]
    return d.select("agent", "n_traces", "median_length", _r("mean_entropy"), _r("exact_dup_rate"))


@query("measure_floor")
def floor_(spark, sf):
    return floor.floor_points(bridge.traces(spark, sf), "agent", FIXED)


_CLIFF_SQL = f"""WITH {TRACE_SQL}, pl AS (SELECT trace_id, p, atoms[p - 4 : p] AS b, atoms[p + 1 : p + 5] AS c FROM (SELECT trace_id, atoms, unnest(range(5, n - 5)) AS p FROM sp)),
nm AS (SELECT trace_id, p, b, c, unnest({list(ATOMS)!r}) AS a FROM pl), ct AS (SELECT trace_id, p, len(list_filter(b, lambda z: z = a)) / 5 AS x, len(list_filter(c, lambda z: z = a)) / 5 AS y FROM nm),
sc AS (SELECT trace_id, p, round(sum(CASE WHEN x > 0 THEN x * log2(2 * x / (x + y)) ELSE 0 END + CASE WHEN y > 0 THEN y * log2(2 * y / (x + y)) ELSE 0 END) / 2, 12) AS s FROM ct GROUP BY trace_id, p),
th AS (SELECT trace_id, p, s, quantile_cont(s, 0.9) OVER w AS t, row_number() OVER w AS k FROM sc WINDOW w AS (PARTITION BY trace_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
cl AS (SELECT trace_id, p, s, t FROM th WHERE k >= 5 AND s >= t - 1e-9) """


@query("cliffs", _CLIFF_SQL + 'SELECT trace_id, CAST(p AS INTEGER) AS "index", round(s, 6) AS jsd, round(t, 6) AS threshold FROM cl')
def cliffs_(spark, sf):
    return cliffs.detect_cliffs(bridge.traces(spark, sf)).select("trace_id", "index", _r("jsd"), _r("threshold"))


@query("cliff_summary", _CLIFF_SQL + """, pr AS (SELECT trace_id, i - 1 AS ix FROM (SELECT trace_id, atoms, unnest(range(1, n + 1)) AS i FROM sp) WHERE atoms[i] = 'prompt_ai'),
ne AS (SELECT cl.trace_id, p, bool_or(ix IS NOT NULL) AS near FROM cl LEFT JOIN pr ON pr.trace_id = cl.trace_id AND abs(p - ix) <= 1 GROUP BY ALL), ag AS (SELECT trace_id, count(*) AS nc, count(*) FILTER (WHERE NOT near) AS nh FROM ne GROUP BY trace_id)
SELECT trace_id, CAST(n AS INTEGER) AS n_actions, coalesce(nc, 0) AS n_cliffs, coalesce(nh, 0) AS n_hidden, round(nh / nc, 6) AS hidden_fraction, round(CASE WHEN n > 0 THEN 100 * coalesce(nc, 0) / n ELSE 0 END, 6) AS per_100_actions FROM sp LEFT JOIN ag USING (trace_id)""")
def cliff_summary_(spark, sf):
    d = cliffs.summarize_cliffs(bridge.traces(spark, sf))
    return d.select("trace_id", "n_actions", "n_cliffs", "n_hidden", _r("hidden_fraction"), _r("per_100_actions"))


# ---------------------------------------------------------------- sequence functions
@query("sequence_functions", f"""WITH {TRACE_SQL}, x AS (SELECT trace_id, atoms, n, spine, unnest(range(1, n + 1)) AS i FROM sp), y AS (SELECT trace_id, i, i - row_number() OVER (PARTITION BY trace_id ORDER BY i) AS isle FROM x WHERE atoms[i] = 'edit'), r AS (SELECT trace_id, max(c) AS m FROM (SELECT trace_id, isle, count(*) AS c FROM y GROUP BY ALL) GROUP BY trace_id)
SELECT trace_id, CAST(coalesce(m, 0) AS INTEGER) AS edit_run_max, regexp_matches(spine, '(^| )edit run_test ') AS edit_then_test, CAST(CASE WHEN list_position(atoms, 'submit') > 0 THEN list_position(atoms, 'submit') - 1 ELSE n END AS INTEGER) AS first_submit, CAST((SELECT count(*) FROM x WHERE x.trace_id = sp.trace_id AND atoms[i] = 'error' AND atoms[i + 1] = 'error') AS INTEGER) AS double_errors FROM sp LEFT JOIN r USING (trace_id)""")
def sequence_(spark, sf):
    a = F.col("atoms")
    return bridge.traces(spark, sf).select("trace_id", S.max_run(a, "edit").alias("edit_run_max"), S.contains_seq(a, ["edit", "run_test"]).alias("edit_then_test"), S.first_index(a, "submit").cast("int").alias("first_submit"), S.count_seq(a, ["error", "error"]).alias("double_errors"))


# ---------------------------------------------------------------- adapters, learning, streams
@query("adapter_action_list", f"WITH {TRACE_SQL} SELECT trace_id, spine FROM (SELECT trace_id, array_to_string(list_transform(atoms, lambda a: CASE a WHEN 'prompt_ai' THEN 'other' WHEN 'think' THEN 'other' WHEN 'error' THEN 'other' ELSE a END), ' ') AS spine FROM tr)")
def adapter_(spark, sf):
    """Trajectories written as raw action lists and read back through an adapter."""
    from ..sources.adapters import canonicalize

    names = {"edit": "str_replace", "run_test": "pytest", "read_file": "goto", "search_repo": "find_file", "submit": "exit", "think": "ponder", "prompt_ai": "wait", "error": "crash"}
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    raw = F.parse_json(F.to_json(F.struct("trace_id", "agent", F.transform("atoms", lambda a: F.struct(F.element_at(table, a).alias("action"))).alias("actions"))))
    return canonicalize(bridge.traces(spark, sf).select(raw.alias("raw")), "swe-agent").select("trace_id", F.array_join("atoms", " ").alias("spine"))


@query("cluster_embeddings")
def cluster_(spark, sf):
    from ..operators.learn import cluster_vectors

    e = spark.read.parquet(f"{sf}/embeddings.parquet")
    return cluster_vectors(e, k=8).groupBy("cluster", "label").agg(F.count("*").alias("n"))


@query("probe_agents")
def probe_(spark, sf):
    from ..operators.learn import leave_one_group_out

    r = leave_one_group_out(_fps(spark, sf))
    return spark.createDataFrame([(g, float(a)) for g, a in r["by_group"].items()], "fold string, accuracy double")


@query("paired_bootstrap")
def bootstrap_(spark, sf):
    from ..operators.learn import paired_bootstrap

    t = bridge.traces(spark, sf)
    r = paired_bootstrap(t.where(F.col("agent") == A), t.where(F.col("agent") == B), scoring.Spec.from_winners(t, FIXED), FIXED)
    return spark.createDataFrame([(r["n_instances"], r["behavior_move"], r["outcome_delta"])], "n_instances long, behavior_move double, outcome_delta double")


# ---------------------------------------------------------------- studies
@query("decile_divergence", f"""WITH {TRACE_SQL}, c AS (SELECT agent AS g, CAST(least(floor((i - 1) * 10 / len(atoms)), 9) AS INTEGER) AS decile, atoms[i] AS atom, count(*) AS n FROM (SELECT agent, atoms, unnest(range(1, len(atoms) + 1)) AS i FROM tr) GROUP BY ALL), p AS (SELECT *, n / sum(n) OVER (PARTITION BY g, decile) AS p FROM c),
v AS (SELECT DISTINCT atom FROM p), f AS (SELECT g, decile, v.atom, coalesce(p.p, 0) AS p FROM (SELECT DISTINCT g, decile FROM p) k CROSS JOIN v LEFT JOIN p USING (g, decile, atom))
SELECT a.decile, a.g AS "row", b.g AS col, round(greatest(0, sum({_term('a.p', 'b.p')}) / ln(2)), 6) AS jsd_bits FROM f a JOIN f b ON a.decile = b.decile AND a.atom = b.atom AND a.g < b.g GROUP BY ALL""")
def decile_div_(spark, sf):
    return studies.decile_divergence(bridge.traces(spark, sf)).select("decile", "row", "col", _r("jsd_bits"))


@query("rolling_mix", f"""WITH {TRACE_SQL}, e AS (SELECT trace_id, e, atoms[greatest(e - 39, 1) : e] AS tail FROM (SELECT trace_id, atoms, unnest(range(5, n + 1, 5)) AS e FROM sp)), x AS (SELECT trace_id, e, len(tail) AS m, unnest(tail) AS atom FROM e)
SELECT trace_id, e - 1 AS pos, atom, round(count(*) / max(m), 6) AS share FROM x GROUP BY trace_id, e, atom""")
def rolling_(spark, sf):
    return studies.rolling_mix(bridge.traces(spark, sf)).select("trace_id", "pos", "atom", _r("share"))


@query("pattern_difference", f"WITH {TRACE_SQL}, m AS (SELECT regexp_matches(spine, '(edit ){{2,}}') AS x, regexp_matches(spine, 'edit edit ') AS y FROM sp) SELECT CAST(count(*) FILTER (WHERE x AND y) AS BIGINT) AS both, CAST(count(*) FILTER (WHERE x AND NOT y) AS BIGINT) AS only_a, CAST(count(*) FILTER (WHERE y AND NOT x) AS BIGINT) AS only_b, CAST(count(*) FILTER (WHERE NOT x AND NOT y) AS BIGINT) AS neither FROM m")
def pattern_diff_(spark, sf):
    return studies.pattern_difference(bridge.traces(spark, sf), "(edit ){2,}", "edit edit ")


@query("metric_correlations", _ATOM_ENTROPY + """, m AS (SELECT n AS length, h AS entropy, CAST(CAST(resolved AS INTEGER) AS DOUBLE) AS outcome FROM sp JOIN e USING (trace_id))
SELECT 'length' AS a, 'entropy' AS b, round(corr(length, entropy), 6) AS r FROM m UNION ALL SELECT 'length', 'outcome', round(corr(length, outcome), 6) FROM m UNION ALL SELECT 'entropy', 'outcome', round(corr(entropy, outcome), 6) FROM m""")
def correlations_(spark, sf):
    return studies.metric_correlations(studies.trajectory_metrics(bridge.traces(spark, sf)), ("length", "entropy", "outcome")).select("a", "b", _r("r"))


@query("outcome_deciles", _ATOM_ENTROPY + """, cuts AS (SELECT quantile_cont(n, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM sp), m AS (SELECT len(list_filter(edges, lambda x: x < n)) AS bucket, resolved FROM sp, cuts)
SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n, round(avg(CAST(CAST(resolved AS INTEGER) AS DOUBLE)), 6) AS rate FROM m GROUP BY bucket""")
def deciles_(spark, sf):
    return studies.outcome_deciles(studies.trajectory_metrics(bridge.traces(spark, sf)), "length").select("bucket", "n", _r("rate"))


@query("task_controlled_jsd", f"""WITH {_long_sql()}, z AS (SELECT lg.*, instance_id AS k FROM lg JOIN (SELECT trace_id, instance_id FROM tr) USING (trace_id)), d AS (SELECT x.k, x.trace_id AS i, y.trace_id AS j, greatest(0, sum({_term('x.p', 'y.p')}) / ln(2)) AS d FROM z x JOIN z y ON x.k = y.k AND x.token_id = y.token_id AND x.agent = '{A}' AND y.agent = '{B}' GROUP BY ALL)
SELECT k, count(*) AS n_pairs, round(avg(d), 6) AS jsd_bits FROM d GROUP BY k""")
def controlled_(spark, sf):
    return studies.task_controlled_jsd(_fps(spark, sf), A, B).select("k", "n_pairs", _r("jsd_bits"))


@query("match_agents", f"""WITH {_long_sql()}, z AS (SELECT lg.*, instance_id AS k FROM lg JOIN (SELECT trace_id, instance_id FROM tr) USING (trace_id)), r AS (SELECT k, token_id, avg(p) AS p FROM z WHERE resolved GROUP BY k, token_id),
g AS (SELECT r.k, z.agent, r.token_id, any_value(r.p) AS p, avg(z.p) AS q FROM r JOIN z ON z.token_id = r.token_id AND z.k <> r.k GROUP BY r.k, z.agent, r.token_id), d AS (SELECT k, agent, greatest(0, sum({_term('p', 'q')}) / ln(2)) AS d FROM g GROUP BY k, agent)
SELECT k, arg_min(agent, (round(d, 9), agent)) AS agent, round(min(d), 6) AS jsd_bits FROM d GROUP BY k""")
def match_agents_(spark, sf):
    return studies.match_agents(_fps(spark, sf)).select("k", "agent", _r("jsd_bits"))


@query("length_strata", f"""WITH {TRACE_SQL}, r AS (SELECT agent AS g, trace_id, n, row_number() OVER (PARTITION BY agent ORDER BY n, trace_id) - 1 AS i, count(*) OVER (PARTITION BY agent) AS m FROM sp)
SELECT g, trace_id, CAST(n AS INTEGER) AS n FROM r WHERE i = 0 OR floor(i * 30 / m) <> floor((i - 1) * 30 / m)""")
def strata_(spark, sf):
    return studies.length_strata(bridge.traces(spark, sf))


@query("explore_compare", f"""WITH {', '.join(_fit_parts(8, f"agent IN ('{A}', '{B}')"))}, g AS (SELECT e.agent, a.token, a.token_id, avg((length(enc) - length(replace(enc, ch, ''))) / length(enc)) AS p FROM e8 e, a8 a GROUP BY ALL), m AS (SELECT token, token_id, max(p) FILTER (WHERE agent = '{A}') AS p_a, max(p) FILTER (WHERE agent = '{B}') AS p_b FROM g GROUP BY ALL)
SELECT token, round(p_a, 6) AS p_a, round(p_b, 6) AS p_b, round(ln((p_a + 1e-6) / (p_b + 1e-6)), 6) AS log_odds, round({_term('p_a', 'p_b')}, 9) AS jsd_contribution FROM m ORDER BY abs(ln((p_a + 1e-6) / (p_b + 1e-6))) DESC, token_id LIMIT 10""")
def explore_(spark, sf):
    d = studies.explore_compare(bridge.traces(spark, sf), A, B, vocab_size=16)["procedures"]
    return d.select("token", _r("p_a"), _r("p_b"), _r("log_odds"), _r("jsd_contribution", 9))


@query("explore_medians", f"WITH {TRACE_SQL} SELECT agent AS side, quantile_cont(n, 0.5) AS median_length, quantile_cont(len(list_filter(atoms, lambda a: a = 'think')), 0.5) AS median_think FROM sp WHERE agent IN ('{A}', '{B}') GROUP BY agent")
def explore_medians_(spark, sf):
    return studies.explore_compare(bridge.traces(spark, sf), A, B, vocab_size=16)["medians"]


adapter_cases.register(query)
round_trips.register(
    query, FIXED, RULES, SQL["match_patterns"], SPEC, SQL["score_by_agent"], _long_sql(), SQL["cliffs"],
)
