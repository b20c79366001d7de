"""Chat formatting by schema fingerprints.

Records of unlike layouts (message lists, prompt/completion pairs, instruction triples,
one row per turn) are told apart by a hash of their sorted nested field paths. The hash
selects a declarative mapping, which is compiled to column expressions that give
canonical turns (role, text). Tables are told apart by their schema (detect, to_turns),
JSON records of mixed layouts in one column each by its own (record_turns). Where the
hash of all paths is unknown, paths that no layout uses are left out of it; where that is
unknown too, the layout with the most paths among those that the record wholly holds is
taken, ties by name. Canonical turns are rendered with a reversible template and can be
parsed back.

Defined cases: a null text is the empty text; a null role is the role "null" spelled
as the empty string; rows with equal (conversation, turn) are ordered by role, then
text, and repeated rows all stay; a null conversation id is a conversation of its
own; very long texts are rendered whole, a conversation is read as a stream however many
turns it has; empty tables give empty results; extra columns and nested fields are
ignored; a layout that no mapping fits is refused with its paths (tables) or has the
layout null and no turns (records).
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

# ------------------------------------------------------------ schema fingerprints


_KINDS = {"tinyint": "whole", "smallint": "whole", "int": "whole", "bigint": "whole"}


def field_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths with their leaf kinds; array elements are written []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at + "[]")
    if isinstance(kind, T.MapType):
        return field_paths(kind.valueType, at + "{}")
    return [f"{at}:{_KINDS.get(kind.simpleString(), kind.simpleString())}"]


def fingerprint(paths: Iterable[str]) -> str:
    """Hash of the sorted paths."""
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def schema_fingerprint(schema: T.StructType) -> str:
    return fingerprint(field_paths(schema))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _messages(field: str, role: str, text: str, names: dict[str, str] | None = None) -> Callable[[], Column]:
    def build() -> Column:
        def one(m: Column) -> Column:
            r = m[role]
            for a, b in (names or {}).items():
                r = F.when(r == a, F.lit(b)).otherwise(r)
            return _turn(r, m[text])

        return F.coalesce(F.transform(F.filter(F.col(field), lambda m: m.isNotNull()), one), F.array().cast("array<struct<role:string,text:string>>"))

    return build


def _pair(user: str, assistant: str, context: str | None = None) -> Callable[[], Column]:
    def build() -> Column:
        ask = F.coalesce(F.col(user), F.lit(""))
        if context:
            more = F.coalesce(F.col(context), F.lit(""))
            ask = F.when(more != "", F.concat(ask, F.lit("\n\n"), more)).otherwise(ask)
        return F.array(_turn(F.lit("user"), ask), _turn(F.lit("assistant"), F.col(assistant)))

    return build


_S = T.StringType()


def _list_of(*names: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(n, _S) for n in names]))


def _shape(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


#: layout name -> (its fields, the mapping to turns); None: the rows are turns already
LAYOUTS: dict[str, tuple[T.StructType, Callable[[], Column] | None]] = {
    "messages": (_shape(messages=_list_of("role", "content")), _messages("messages", "role", "content")),
    "sharegpt": (_shape(conversations=_list_of("from", "value")), _messages("conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
    "prompt_completion": (_shape(prompt=_S, completion=_S), _pair("prompt", "completion")),
    "prompt_response": (_shape(prompt=_S, response=_S), _pair("prompt", "response")),
    "question_answer": (_shape(question=_S, answer=_S), _pair("question", "answer")),
    "instruction": (_shape(instruction=_S, input=_S, output=_S), _pair("instruction", "output", "input")),
    "instruction_plain": (_shape(instruction=_S, output=_S), _pair("instruction", "output")),
    "turn_rows": (_shape(turn=T.LongType(), role=_S, text=_S), None),
}
_PATHS = {name: frozenset(field_paths(shape)) for name, (shape, _) in LAYOUTS.items()}
_KNOWN = frozenset().union(*_PATHS.values())
#: fingerprint -> layout
MAPPINGS: dict[str, str] = {fingerprint(paths): name for name, paths in _PATHS.items()}


def layout_of(paths: Iterable[str]) -> str | None:
    """The layout that the fingerprint of some field paths selects."""
    paths = set(paths)
    found = MAPPINGS.get(fingerprint(paths)) or MAPPINGS.get(fingerprint(paths & _KNOWN))
    if found is None:
        held = sorted((-len(own), name) for name, own in _PATHS.items() if own <= paths)
        found = held[0][1] if held else None
    return found


def detect(schema: T.StructType) -> str:
    """The layout of a table."""
    found = layout_of(field_paths(schema))
    if found is None:
        raise ValueError(f"no mapping for the layout with fingerprint {schema_fingerprint(schema)}: {sorted(field_paths(schema))}")
    return found


def to_turns(df: DataFrame, id_column: str = "conv_id") -> DataFrame:
    """Rows of any known layout as (conv_id, turn, role, text), one row per turn."""
    build = LAYOUTS[detect(df.schema)][1]
    if build is None:
        return df.select(F.col(id_column).alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return df.select(F.col(id_column).alias("conv_id"), F.posexplode(build()).alias("turn", "m")).select("conv_id", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")


def _record_paths(described: str) -> list[str]:
    """Field paths of a record from its described schema, as OBJECT<a: STRING, b: ARRAY<OBJECT<c: STRING>>>; null leaves count as strings."""
    out: list[str] = []

    def read(i: int, at: str) -> int:
        if described.startswith("OBJECT<", i):
            i += len("OBJECT<")
            while described[i] != ">":
                name = ""
                if described[i] == "`":  # quoted names double their back quotes
                    i += 1
                    while described[i] != "`" or described[i + 1] == "`":
                        name += described[i]
                        i += 1 + (described[i] == "`")
                    i += 1
                else:
                    to = described.index(":", i)
                    name, i = described[i:to], to
                i = read(i + 2, f"{at}.{name}" if at else name)
                if described.startswith(", ", i):
                    i += 2
            return i + 1
        if described.startswith("ARRAY<", i):
            return read(i + len("ARRAY<"), at + "[]") + 1
        to = i
        while to < len(described) and described[to] not in ",>":
            to += 2 if described[to] == "(" else 1
            if described[to - 2] == "(":
                to = described.index(")", to - 1) + 1
        kind = described[i:to].lower()
        out.append(f"{at}:{'string' if kind == 'void' else _KINDS.get(kind, kind)}")
        return to

    read(0, "")
    return out


@lru_cache(maxsize=10_000)
def _described_layout(described: str) -> str | None:
    return layout_of(_record_paths(described))


def _record_layout(described: str | None) -> str | None:
    return None if described is None else _described_layout(described)


def record_turns(df: DataFrame, id_column: str, json_column: str) -> DataFrame:
    """JSON records of mixed layouts as (conv_id, layout, turn, role, text). One pass without a shuffle; records without a layout have one row without a turn."""
    layout = F.udf(_record_layout, "string", useArrow=True)
    rows = df.select(F.col(id_column).alias("conv_id"), F.expr(f"try_parse_json(`{json_column}`)").alias("v")).select("conv_id", layout(F.expr("schema_of_variant(v)")).alias("layout"), "v")
    none = F.array().cast("array<struct<role:string,text:string>>")
    turns = none
    for name, (shape, build) in LAYOUTS.items():
        if build is not None:
            fields = [F.expr(f"try_variant_get(v, '$.{f.name}', '{f.dataType.simpleString()}')").alias(f.name) for f in shape.fields]
            rows = rows.withColumn(f"at_{name}", F.when(F.col("layout") == name, F.struct(*fields)))
    parts = []
    for name, (_, build) in LAYOUTS.items():
        if build is not None:
            own = rows.where(F.col("layout") == name).select("conv_id", "layout", f"at_{name}.*")
            parts.append(own.select("conv_id", "layout", F.posexplode_outer(build()).alias("turn", "m")))
    parts.append(rows.where("layout is null or layout = 'turn_rows'").select("conv_id", "layout", F.posexplode_outer(turns).alias("turn", "m")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.select("conv_id", "layout", F.col("turn").cast("long").alias("turn"), "m.role", "m.text")


# ------------------------------------------------------------ the template
# A turn is "### <role>:\n<text></turn>\n". In roles and texts, "\", "#" and "<" get a
# backslash before them and, in roles, ":" and newline too, so no text can hold a bare
# control string and one left-to-right pass undoes the escapes.
_TEXT = str.maketrans({"\\": "\\\\", "#": "\\#", "<": "\\<"})
_ROLE = str.maketrans({"\\": "\\\\", "#": "\\#", "<": "\\<", ":": "\\:", "\n": "\\n"})


def escape(text: str, role: bool = False) -> str:
    return text.translate(_ROLE if role else _TEXT)


def unescape(text: str) -> str:
    parts, at = [], 0
    while (k := text.find("\\", at)) >= 0:
        parts.append(text[at:k])
        c = text[k + 1]
        parts.append("\n" if c == "n" else c)
        at = k + 2
    parts.append(text[at:])
    return "".join(parts)


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """(rendered turn, start, end): the escaped text stands at [start, end)."""
    head = f"### {escape(role, True)}:\n"
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def parse_turn(rendered: str) -> tuple[str, str]:
    """The inverse of render_turn."""
    if not rendered.startswith("### ") or not rendered.endswith("</turn>\n"):
        raise ValueError("not a rendered turn")
    at = 4
    while rendered[at] != ":":
        at += 2 if rendered[at] == "\\" else 1
    return unescape(rendered[4:at]), unescape(rendered[at + 2 : -len("</turn>\n")])


def parse_conversation(rendered: str) -> list[tuple[str, str]]:
    """All turns of a rendered conversation: a bare '<' only ever begins the end mark."""
    out, at = [], 0
    while at < len(rendered):
        k = at
        while rendered[k] != "<":
            k += 2 if rendered[k] == "\\" else 1
        k += len("</turn>\n")
        out.append(parse_turn(rendered[at:k]))
        at = k
    return out


# ------------------------------------------------------------ operators
FORMATTED = "conv_id long, turn long, role string, formatted string, text_start long, loss_start long, loss_end long"
END = "</turn>\n"


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
        done = [render_turn(r or "", t or "") for r, t in zip(cols["role"], cols["text"])]
        loss = [(r or "") == "assistant" for r in cols["role"]]
        yield pa.record_batch(
            {
                "conv_id": b.column(b.schema.get_field_index("conv_id")),
                "turn": b.column(b.schema.get_field_index("turn")),
                "role": pa.array([r or "" for r in cols["role"]], pa.string()),
                "formatted": pa.array([d[0] for d in done], pa.string()),
                "text_start": pa.array([d[1] for d in done], pa.int64()),
                "loss_start": pa.array([d[1] if m else None for d, m in zip(done, loss)], pa.int64()),
                "loss_end": pa.array([d[2] if m else None for d, m in zip(done, loss)], pa.int64()),
            }
        )


def format_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) rows rendered turn by turn, with the loss mask as a code-point span within the rendered turn.

    A conversation's training string is its rendered turns in the order of turn, joined
    by nothing. No shuffle is needed, however long a conversation is.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(_render), FORMATTED)


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams sorted rows; one conversation's state is two hashes and three counts, however many turns it has."""
    unset = object()
    now, state, out = unset, None, []

    def close() -> None:
        out.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) if out else [[]] * 6
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        rb = pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds)], names=names)
        out.clear()
        return rb

    for b in batches:
        ids, done, lo, hi = (b.column(b.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end"))
        for i, rendered, s, e in zip(ids, done, lo, hi):
            if now is unset or i != now:
                if now is not unset:
                    close()
                now, state = i, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            role, text = parse_turn(rendered)
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if s is not None:
                masked = unescape(rendered[s:e])
                state[2] += len(masked)
                state[3].update(masked.encode())
            state[4] += len(rendered)
        if out:
            yield flush()
    if now is not unset:
        close()
        yield flush()


def digest_conversations(formatted: DataFrame) -> DataFrame:
    """Reads the rendered turns back and digests each conversation; ties in turn go by role, then text."""
    rows = formatted.select("conv_id", "turn", "role", "formatted", "text_start", "loss_start", "loss_end").repartition("conv_id")
    # the text as it was before it was escaped
    body = F.substring(F.col("formatted"), F.col("text_start") + 1, F.length("formatted") - F.col("text_start") - len(END))
    rows = rows.withColumn("plain", F.regexp_replace(body, r"(?s)\\(.)", "$1"))
    return rows.sortWithinPartitions("conv_id", "turn", "role", "plain").drop("role", "turn", "plain", "text_start").mapInArrow(lean(_digest), DIGEST)
