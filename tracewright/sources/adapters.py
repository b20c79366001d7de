"""Raw agent logs to atoms: adapters as column expressions over a VARIANT record.

An adapter is a function from a column (the raw record, VARIANT) to a column of atoms.
Action-list adapters read one list of steps; event adapters turn transcripts into events
and map each event to an atom. Commands are classified by ordered patterns and dropped.
Lenient throughout: missing keys, lists that are no lists, elements that are no objects
and blank texts give no atoms (action-list adapters raise where the list is no list).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Adapter = Callable[[Column], Column]
_REGISTRY: dict[str, Adapter] = {}


def register_adapter(name: str, adapter: Adapter, overwrite: bool = False) -> None:
    if name in _REGISTRY and not overwrite:
        raise ValueError(f"adapter {name!r} exists")
    _REGISTRY[name] = adapter


def get_adapter(name: str) -> Adapter:
    if name not in _REGISTRY:
        raise KeyError(f"unknown adapter {name!r}; known: {', '.join(list_adapters())}")
    return _REGISTRY[name]


def list_adapters() -> list[str]:
    return sorted(_REGISTRY)


# ---------------------------------------------------------------- reading variants
NONE = F.array  # called where a session exists


def none() -> Column:
    return F.array().cast("array<string>")


def get(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def kind_of(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def text(v: Column, path: str) -> Column:
    """The string at path; null if what is there isn't a string."""
    return F.when(kind_of(v, path) == "STRING", get(v, path))


def filled(c: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s", " ")) != "", F.lit(False))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def items(v: Column, path: str) -> Column:
    """The objects of the list at path; a JSON string is parsed first; anything else is the empty list."""
    raw = F.try_variant_get(v, path, "variant")
    parsed = F.when(F.schema_of_variant(raw) == "STRING", F.try_parse_json(F.try_variant_get(raw, "$", "string"))).otherwise(raw)
    found = F.try_variant_get(parsed, "$", "array<variant>")
    return F.coalesce(F.filter(found, lambda x: F.coalesce(F.schema_of_variant(x).startswith("OBJECT"), F.lit(False))), F.array().cast("array<variant>"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: inside lambdas an expression is computed again wherever it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def per(list_: Column, one: Callable[[Column], Column]) -> Column:
    """Atoms of all elements, in order; one gives an array for each."""
    return F.flatten(F.transform(list_, one))


def some(cond: Column, atom: str | Column) -> Column:
    """The atom as an array of one, or none."""
    return F.when(F.coalesce(cond, F.lit(False)), F.array(F.lit(atom) if isinstance(atom, str) else atom)).otherwise(none())


def words(**groups: str) -> dict[str, str]:
    """name -> atom from atom="name name ..."."""
    return {n: atom for atom, names in groups.items() for n in names.split()}


def lookup(table: dict[str, str], key: Column, default: str = "other") -> Column:
    m = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(m, key), F.lit(default))


# ---------------------------------------------------------------- factories
def make_action_adapter(action_field: str, atom_map: dict[str, str], thought_field: str | None = None, actions_path: str = "$.actions", default_atom: str = "other") -> Adapter:
    def adapter(raw: Column) -> Column:
        def step(s: Column) -> Column:
            name = lookup(atom_map, F.coalesce(get(s, f"$.{action_field}"), F.lit("")), default_atom)
            think = some(filled(get(s, f"$.{thought_field}")), "think") if thought_field else none()
            return F.concat(think, F.array(name))

        there = F.try_variant_get(raw, actions_path, "variant")
        bad = there.isNotNull() & ~F.schema_of_variant(there).startswith("ARRAY")
        return F.when(bad, F.raise_error(F.concat(F.lit("not a list at "), F.lit(actions_path))).cast("array<string>")).otherwise(per(items(raw, actions_path), step))

    return adapter


Rule = tuple[Callable[[Column], Column], tuple[str, ...]]


def field_in(field: str, values: set[str]) -> Callable[[Column], Column]:
    """Whether the event's field is one of values, case aside."""
    low = sorted(v.lower() for v in values)
    return lambda e: F.coalesce(F.lower(get(e, f"$.{field}")).isin(*low), F.lit(False))


def field_truthy(*fields: str) -> Callable[[Column], Column]:
    def test(e: Column) -> Column:
        out = F.lit(False)
        for f in fields:
            out = out | F.coalesce(~F.lower(get(e, f"$.{f}")).isin("", "0", "0.0", "false", "[]", "{}", "null"), F.lit(False))
        return out

    return test


def any_of(*tests: Callable[[Column], Column]) -> Callable[[Column], Column]:
    def test(e: Column) -> Column:
        out = F.lit(False)
        for t in tests:
            out = out | t(e)
        return out

    return test


def make_event_adapter(rules: list[Rule], events_path: str = "$.events", default_atom: str = "other", dedupe_per_event: bool = True) -> Adapter:
    """Rules add their atoms in order; an event that none matches gives the default."""

    def adapter(raw: Column) -> Column:
        def event(e: Column) -> Column:
            got = F.flatten(F.array(*[F.when(test(e), F.array(*map(F.lit, atoms))).otherwise(none()) for test, atoms in rules]))
            got = F.array_distinct(got) if dedupe_per_event else got
            return F.when(F.size(got) > 0, got).otherwise(F.array(F.lit(default_atom)))

        return per(items(raw, events_path), event)

    return adapter


# ---------------------------------------------------------------- command classifiers
_COMMANDS = words(
    read_file="cat head tail less more view open bat",
    search_repo="grep rg ripgrep ag ack find locate fd",
    edit="sed awk patch ed",
    run_test="pytest unittest tox nose2 django-admin",
    run_code="python python3",
    create_file="mkdir touch",
    delete_file="rm rmdir",
    submit="submit MINI_SWE_AGENT_FINAL_OUTPUT",
)


def bash_atom(cmd: Column) -> Column:
    """First classifier: test runners, writes, patches, then the first word; leading cd chains are dropped."""
    s = strip(F.regexp_replace(strip(cmd), r"^(?:cd\s+\S+\s*(?:&&|;)\s*(?=\S))+", ""))
    return (
        F.when(~filled(cmd) | cmd.isNull(), "other")
        .when(s.rlike(r"\bpython\s+-m\s+(?:(?:pytest|unittest|nose2|tox)\b|django\s+test\b)"), "run_test")
        .when(s.rlike(r"<<\s*['\"]?\w|>\s*[-./\w]"), "edit")
        .when(s.rlike(r"\bgit\s+(?:diff|apply|format-patch)\b"), "submit")
        .otherwise(lookup(_COMMANDS, F.get(F.split(s, r"\s+"), F.lit(0))))
    )


_LEAD = r"(?:^|\s|;|&|\|)"


def _one_of(names: str) -> str:
    return "(?:" + "|".join(sorted(names.split(), key=lambda x: (-len(x), x))) + ")"


_PACKAGERS, _CHANGES = "apt apt-get brew bundle cargo conda gem go npm pip pip3 pipenv pnpm poetry uv yarn", "add install sync update upgrade"
_LINTERS = "black clippy eslint flake8 gofmt golangci-lint isort mypy prettier pylint pyright rubocop ruff tsc"
_KINDS: tuple[tuple[str, str], ...] = (
    ("run_test", _one_of("jest mocha pytest tox unittest vitest") + r"|(?:^|/|\s)tests?\b|npm (?:run )?test|" + _one_of("cargo go gradle make yarn") + " test"),
    ("version_control", _LEAD + _one_of("gh git hg svn") + r"\b"),
    ("package", r"\b" + _one_of(_PACKAGERS) + r"\b[^&;|]*\b" + _one_of(_CHANGES) + r"\b"),
    ("lint", r"\b" + _one_of(_LINTERS) + r"\b"),
    ("search_repo", _LEAD + _one_of("ack ag fd find grep rg") + r"\b"),
    ("run_code", _LEAD + r"(?:\./|(?:cargo|go) run|bun|deno|make|node|python|ruby)"),
)
_TERMINAL_KINDS = (*_KINDS, ("read_file", _LEAD + _one_of("bat cat Get-Content head less more nl sed tail") + r"\b"), ("search_repo", _LEAD + _one_of("Get-ChildItem ls Select-String tree") + r"\b"))


def command_kind(cmd: Column, kinds: tuple[tuple[str, str], ...] = _KINDS) -> Column:
    """Second classifier: ordered kinds, case aside; with _TERMINAL_KINDS also reading and listing."""
    c = F.coalesce(cmd, F.lit(""))
    out = F
    for atom, rx in kinds:
        out = out.when(c.rlike("(?i)" + rx), atom)
    return out.otherwise("other")


def terminal_atom(cmd: Column) -> Column:
    return command_kind(cmd, _TERMINAL_KINDS)


# ---------------------------------------------------------------- action lists
SWE_AGENT = words(edit="edit str_replace str_replace_editor", create_file="create", delete_file="delete", read_file="open goto view scroll_down scroll_up", search_repo="search_dir search_file find_file grep", run_test="run_test pytest", submit="submit exit")
register_adapter("swe-agent", make_action_adapter("action", SWE_AGENT, "thought"))
register_adapter("agentless", make_action_adapter("phase", words(localize="fault_localization file_localization line_localization", edit="repair patch_generation", run_test="regression_test reproduction_test", submit="submit"), "reasoning"))
register_adapter("dars", make_action_adapter("tool", words(localize="localize", read_file="read", edit="edit", run_test="test", search_repo="search", submit="submit", think="reason", error="error"), "thought"))
register_adapter("moatless", make_action_adapter("action", words(localize="FindCode FindClass FindFunction", search_repo="SemanticSearch", read_file="ViewCode", edit="RequestCodeChange StringReplace", create_file="CreateFile", run_test="RunTests", submit="Finish"), "thoughts"))

_TREE_OPS = words(ast_insert="insert-node insert-tree", ast_delete="delete-node delete-tree", ast_update="update-node", ast_move="move-node move-tree")


def gumtree(raw: Column) -> Column:
    def step(s: Column) -> Column:
        op = lookup(_TREE_OPS, F.coalesce(get(s, "$.action"), F.lit("")), "")
        node = strip(F.coalesce(get(s, "$.node_type"), F.lit("")))
        return F.array(F.when(op == "", "other").otherwise(F.concat(op, F.lit(":"), F.when(node == "", "?").otherwise(node))))

    return per(items(raw, "$.actions"), step)


def parse_jsondiff(raw: Column) -> Column:
    """A tree diff's actions as (action, node_type): the leading identifier of each tree label."""

    def one(a: Column) -> Column:
        found = F.regexp_extract(F.coalesce(get(a, "$.tree"), F.lit("")), r"^\s*([_A-Za-z][$.\w]*)", 1)
        return F.struct(F.coalesce(get(a, "$.action"), F.lit("")).alias("action"), F.when(found == "", "?").otherwise(found).alias("node_type"))

    return F.transform(items(raw, "$.actions"), one)


register_adapter("gumtree", gumtree)


# ---------------------------------------------------------------- message lists
def _assistant(m: Column, roles: tuple[str, ...] = ("assistant",)) -> Column:
    return F.coalesce(get(m, "$.role").isin(*roles), F.lit(False))


def mini_swe_agent(raw: Column) -> Column:
    def message(m: Column) -> Column:
        acts = per(items(m, "$.extra.actions"), lambda a: F.array(bash_atom(F.coalesce(get(a, "$.command"), F.lit("")))))
        return F.when(_assistant(m), F.concat(some(filled(text(m, "$.content")), "think"), acts)).otherwise(none())

    status = F.lower(F.coalesce(get(raw, "$.info.exit_status"), F.lit("")))
    failed = (status != "") & ~status.isin("submitted", "completed", "ok", "success")
    return F.concat(per(items(raw, "$.messages"), message), some(failed, "error"))


register_adapter("mini-swe-agent", mini_swe_agent)

_EDITOR = words(read_file="view open", create_file="create write", edit="str_replace insert append")
_BASH_NAMES = tuple("bash execute_bash execute_command run_bash".split())
_EDITORS = tuple("edit_file editor str_replace_based_edit_tool str_replace_editor".split())
_DONE_NAMES = ("finish", "submit", "complete")


def _tool(name: Column, shell: Column, editor: Column, editors: tuple[str, ...]) -> Column:
    n = F.lower(name)
    return F.when(n.isin(*_BASH_NAMES), bash_atom(shell)).when(n.isin(*editors), lookup(_EDITOR, F.lower(editor), "edit")).when(n.isin(*_DONE_NAMES), "submit").when(n == "think", "think").otherwise("other")


def openhands(raw: Column) -> Column:
    def call(c: Column) -> Column:
        name = F.coalesce(get(c, "$.function.name"), get(c, "$.name"), F.lit(""))
        args = F.coalesce(F.try_variant_get(c, "$.function.arguments", "variant"), F.try_variant_get(c, "$.arguments", "variant"))
        args = F.when(F.schema_of_variant(args) == "STRING", F.try_parse_json(F.try_variant_get(args, "$", "string"))).otherwise(args)
        cmd = F.coalesce(get(args, "$.command"), F.lit(""))
        return F.array(_tool(name, cmd, cmd, (*_EDITORS, "edit")))

    def message(m: Column) -> Column:
        return F.when(_assistant(m), F.concat(some(filled(text(m, "$.content")), "think"), per(items(m, "$.tool_calls"), call))).otherwise(none())

    return per(items(raw, "$.messages"), message)


register_adapter("openhands", openhands)


def _turn_text(m: Column) -> Column:
    c, t = text(m, "$.content"), text(m, "$.text")
    return F.when(filled(c), c).when(filled(t), t).otherwise("")


_BLOCK = r"(?s)<function=([^\s>]+)\s*>(.*?)</function>"


def function_xml(raw: Column) -> Column:
    def param(body: Column, name: str) -> Column:
        return strip(F.regexp_extract(body, rf"(?s)<parameter={name}\s*>(.*?)</parameter>", 1))

    def message(m: Column) -> Column:
        t = _turn_text(m)
        pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(_BLOCK), 1).alias("n"), F.regexp_extract_all(t, F.lit(_BLOCK), 2).alias("b"))

        def one(x: Column) -> Column:
            name, body = x["n"], x["b"]
            cmd = param(body, "command")
            shell = F.when(param(body, "cmd") != "", param(body, "cmd")).otherwise(cmd)
            return _tool(name, shell, cmd, (*_EDITORS, "file_editor"))

        atoms = F.concat(some(filled(F.regexp_replace(t, _BLOCK, "")), "think"), F.transform(pairs, one))
        return F.when(_assistant(m, ("assistant", "ai")) & filled(t), atoms).otherwise(none())

    return per(items(raw, "$.messages"), message)


register_adapter("function-xml", function_xml)


def react_text(raw: Column) -> Column:
    fence = r"(?s)```(?:py|python|console|shell|sh|bash)?\s*\n(.*?)```"

    def message(m: Column) -> Column:
        t = _turn_text(m)
        blocks = F.regexp_extract_all(t, F.lit(fence), 1)
        lines = F.transform(blocks, lambda b: F.get(F.filter(F.transform(F.split(b, "\n"), lambda x: strip(x)), lambda x: (x != "") & ~x.startswith("#")), F.lit(0)))
        cmds = F.transform(F.filter(lines, lambda x: x.isNotNull()), bash_atom)
        return F.when(_assistant(m, ("assistant", "ai")) & filled(t), F.concat(F.array(F.lit("think")), cmds)).otherwise(none())

    return per(items(raw, "$.messages"), message)


register_adapter("react-text", react_text)

_VERBS: tuple[tuple[str, str], ...] = (
    ("run_test", "test tests"),
    ("search_repo", "search find query lookup grep"),
    ("read_file", "read get fetch list view retrieve show load"),
    ("create_file", "create add new insert post make"),
    ("delete_file", "delete remove drop clear"),
    ("edit", "edit update write set modify patch put rename move"),
    ("run_code", "run execute exec invoke call"),
)


def tool_name_atom(name: Column) -> Column:
    """By the verbs among a name's words (camel or snake case); the first group that has one wins."""
    parts = F.transform(F.regexp_extract_all(name, F.lit(r"(\d+|[A-Z]+(?![a-z])|[A-Z]?[a-z]+)"), 1), lambda w: F.lower(w))
    out = F
    for atom, verbs in _VERBS:
        out = out.when(F.arrays_overlap(parts, F.array(*map(F.lit, verbs.split()))), atom)
    return out.otherwise("other")


def prompt_completion(raw: Column) -> Column:
    def call(c: Column) -> Column:
        return F.array(tool_name_atom(F.coalesce(text(c, "$.function.name"), get(c, "$.name"), F.lit(""))))

    def turn(m: Column) -> Column:
        role = get(m, "$.role")
        head = F.lower(F.substring(F.coalesce(get(m, "$.content"), F.lit("")), 1, 120))
        return (
            F.when(role == "user", F.array(F.lit("prompt_ai")))
            .when(role == "assistant", F.concat(some(filled(text(m, "$.content")), "think"), per(items(m, "$.tool_calls"), call)))
            .when((role == "tool") & head.rlike("error|exception|traceback|failed|not found"), F.array(F.lit("error")))
            .otherwise(none())
        )

    return F.concat(per(items(raw, "$.prompt"), lambda m: some(get(m, "$.role") == "user", "prompt_ai")), per(items(raw, "$.completion"), turn))


register_adapter("prompt-completion", prompt_completion)


def spine(raw: Column) -> Column:
    s = text(raw, "$.spine")
    return F.coalesce(F.filter(F.split(s, r"\s+"), lambda a: a != ""), none())


register_adapter("spine", spine)

_TRAJ_EDITOR = words(read_file="view open goto scroll_down scroll_up", edit="str_replace insert", create_file="create")


def swe_agent_traj(raw: Column) -> Column:
    def step(s: Column) -> Column:
        action = strip(text(s, "$.action"))
        tokens = F.split(action, r"\s+")
        head = F.get(tokens, F.lit(0))
        atom = F.when(head.isin("str_replace_editor", "str_replace_based_edit_tool"), lookup(_TRAJ_EDITOR, F.coalesce(F.get(tokens, F.lit(1)), F.lit("")), "edit")).when(head.rlike("^(?:submit|exit(?:_(?:context|cost|format))?)$"), "submit").otherwise(terminal_atom(action))
        return F.concat(some(filled(get(s, "$.thought")), "think"), some(filled(action), atom))

    return per(items(raw, "$.trajectory"), step)


register_adapter("swe-agent-traj", swe_agent_traj)

_NATIVE_TABLE = words(
    submit="submit",
    error="empty_or_error",
    read_file="str_replace_editor:view ls cat",
    create_file="str_replace_editor:create mkdir_touch echo_redirect",
    edit="str_replace_editor:str_replace str_replace_editor:insert str_replace_editor:undo",
    run_test="python:pytest python:script",
    search_repo="find grep",
    delete_file="rm",
    other="mv_cp permissions",
)
_NATIVE = {**SWE_AGENT, **_NATIVE_TABLE}


def native_action(action: Column) -> Column:
    """The native label of an action string, with its chain or pipe mark."""
    inner = lambda s: F.when(s.startswith("cd ") & s.contains("&&"), strip(F.regexp_replace(s, r"(?s)^cd .*?&&", ""))).otherwise(s)
    label = let(strip(action), lambda s: let(inner(s), _native_label))
    return F.when(filled(action), label).otherwise("empty_or_error")


def _native_label(inner: Column) -> Column:
    mark = F.when(inner.contains(" && "), "chain:").when(F.replace(inner, F.lit("||"), F.lit("")).contains("|"), "pipe:").otherwise("")
    cut = F.when(inner.contains(" && "), F.split_part(inner, F.lit(" && "), F.lit(1))).otherwise(F.split_part(inner, F.lit("|"), F.lit(1)))
    return F.concat(mark, let(strip(cut), _native_head))


def _native_head(h: Column) -> Column:
    first = F.get(F.split(h, r"\s+"), F.lit(0))
    sub = F.get(F.split(h, r"\s+"), F.lit(1))
    py = strip(F.regexp_replace(h, r"^python3?\s*", ""))
    return (
        F.when(h.isin(*SWE_AGENT), h)
        .when(h.startswith("str_replace_editor "), F.concat(F.lit("str_replace_editor:"), F.when(sub == "undo_edit", "undo").otherwise(sub)))
        .when(h.rlike(r"^python3? ") | (h == "python"), F.when(py.rlike(r"^(?:-m )?(?:pytest|unittest)"), "python:pytest").otherwise("python:script"))
        .when(h.startswith("pytest"), "python:pytest")
        .when(first == "find", "find")
        .when(first.isin("grep", "rg", "ag"), "grep")
        .when(first == "ls", "ls")
        .when(first.isin(*"cat head less more tail".split()) & sub.isNotNull(), "cat")
        .when(first == "rm", "rm")
        .when(first.isin("mkdir", "touch") & sub.isNotNull(), "mkdir_touch")
        .when(first.isin("mv", "cp") & sub.isNotNull(), "mv_cp")
        .when(first.isin("chmod", "chown") & sub.isNotNull(), "permissions")
        .when((first == "echo") & h.contains(">"), "echo_redirect")
        .when(first.isin(*SWE_AGENT), first)
        .otherwise(F.concat(F.lit("other:"), F.lower(F.when(first == "", "empty").otherwise(first))))
    )


def canonical_of_native(native: Column) -> Column:
    """Projection of native labels; what isn't known is other."""
    return lookup(_NATIVE_TABLE, F.regexp_replace(native, "^(?:chain|pipe):", ""))


def _swe_smith(layer: str) -> Adapter:
    def adapter(raw: Column) -> Column:
        def message(m: Column) -> Column:
            action = text(m, "$.action")
            name = text(m, "$.tool_calls[0].function.name")
            source = F.when(action.isNotNull(), action).when(F.coalesce(name, F.lit("")) != "", name)
            shown = native_action(source) if layer == "native" else lookup(_NATIVE, F.regexp_replace(native_action(source), "^(?:chain|pipe):", ""))
            return F.when(_assistant(m), F.concat(some(filled(text(m, "$.thought")), "think"), some(source.isNotNull(), shown))).otherwise(none())

        return per(items(raw, "$.messages"), message)

    return adapter


register_adapter("swe-smith", _swe_smith("canonical"))
register_adapter("swe-smith-native", _swe_smith("native"))

# ---------------------------------------------------------------- transcripts
_INJECTED = tuple(f"<{x}>" for x in "bash-stderr bash-stdout command-args command-message command-name local-command-stdout system-reminder task-notification".split())
_TRANSCRIPT_TOOLS = words(edit="edit write notebookedit multiedit", read_file="read notebookread", search_repo="grep glob websearch webfetch", think="todowrite exitplanmode")


def _typed(t: Column, injected: tuple[str, ...]) -> Column:
    s = strip(F.regexp_replace(t, r"^\s+", ""))
    ok = filled(t)
    for p in injected:
        ok = ok & ~s.startswith(p)
    return F.coalesce(ok, F.lit(False))


def claude_code(raw: Column) -> Column:
    def block(b: Column) -> Column:
        name = F.lower(F.coalesce(get(b, "$.name"), F.lit("")))
        atom = F.when(name == "bash", command_kind(get(b, "$.input.command"))).otherwise(lookup(_TRANSCRIPT_TOOLS, name))
        return some(get(b, "$.type") == "tool_use", atom)

    def line(e: Column) -> Column:
        kind = get(e, "$.type")
        blocks = items(e, "$.message.content")
        listed = F.coalesce(kind_of(e, "$.message.content").startswith("ARRAY"), F.lit(False))
        types = F.transform(blocks, lambda b: get(b, "$.type"))
        joined = F.array_join(F.transform(F.filter(blocks, lambda b: get(b, "$.type") == "text"), lambda b: F.coalesce(get(b, "$.text"), F.lit(""))), " ")
        said = F.when(listed, F.when(F.array_contains(types, "text") & ~F.coalesce(F.array_contains(types, "tool_result"), F.lit(False)), joined)).otherwise(text(e, "$.message.content"))
        return F.when(kind == "user", some(_typed(said, _INJECTED), "prompt_ai")).when((kind == "assistant") & listed, per(blocks, block)).when(kind == "file-history-snapshot", F.array(F.lit("edit"))).otherwise(none())

    return per(items(raw, "$.events"), line)


register_adapter("claude-code", claude_code)


def codex(raw: Column) -> Column:
    def line(e: Column) -> Column:
        p = F.try_variant_get(e, "$.payload", "variant")
        outer, inner = get(e, "$.type"), get(p, "$.type")
        name = F.lower(F.coalesce(get(p, "$.name"), F.lit("")))
        args = F.try_variant_get(p, "$.arguments", "variant")
        args = F.when(F.schema_of_variant(args) == "STRING", F.try_parse_json(F.try_variant_get(args, "$", "string"))).otherwise(args)
        cmd = F.coalesce(get(args, "$.cmd"), get(args, "$.command"), F.lit(""))
        mcp = (
            F.when(name.rlike("read|get_file_info|hover|definition"), "read_file")
            .when(name.rlike("write_file|replace|insert|create_file"), "edit")
            .when(name.rlike("search|find|list|symbol|diagnostic|grep"), "search_repo")
            .when(name.rlike("thinking|memory_read|state_"), "think")
            .otherwise("other")
        )
        called = F.when(name.isin("exec_command", "shell_command", "shell", "local_shell"), terminal_atom(cmd)).when(name.startswith("mcp_"), mcp).otherwise(lookup(words(edit="apply_patch", think="update_plan", run_code="write_stdin"), name))
        return F.when((outer == "event_msg") & (inner == "user_message"), some(filled(get(p, "$.message")), "prompt_ai")).when((outer == "response_item") & inner.isin("function_call", "custom_tool_call"), F.array(called)).otherwise(none())

    return per(items(raw, "$.events"), line)


register_adapter("codex", codex)

_SERENA = "find_symbol get_symbols_overview find_referencing_symbols"
_GEMINI = words(
    read_file="read_file mcp__filesystem__read_text_file read_memory mcp_serena_read_memory",
    search_repo=f"grep_search glob list_directory list_dir find_file google_web_search web_fetch search_for_pattern {_SERENA} mcp_serena_find_file " + " ".join("mcp_serena_" + x for x in _SERENA.split()),
    edit="replace write_file rename_symbol write_memory " + " ".join(p + x for p in ("", "mcp_serena_") for x in ("insert_after_symbol", "insert_before_symbol", "replace_symbol_body")),
    think="write_todos enter_plan_mode exit_plan_mode",
)


def gemini_cli(raw: Column) -> Column:
    events = items(raw, "$.events")
    # the first telling event decides between the native and the transcript layout
    tells = F.filter(F.transform(events, lambda e: F.when(get(e, "$.type") == "gemini", True).when(get(e, "$.type") == "assistant", False).when(get(e, "$.type") == "user", kind_of(e, "$.message").isNull())), lambda x: x.isNotNull())
    native = F.coalesce(F.get(tells, F.lit(0)), F.lit(False))

    def call(c: Column) -> Column:
        name = F.lower(F.coalesce(get(c, "$.name"), F.lit("")))
        return F.array(F.when(name.isin("run_shell_command", "shell"), terminal_atom(get(c, "$.args.command"))).otherwise(lookup(_GEMINI, name)))

    def message(m: Column) -> Column:
        parts = F.array_join(F.transform(items(m, "$.content"), lambda b: F.coalesce(get(b, "$.text"), F.lit(""))), " ")
        said = F.coalesce(text(m, "$.content"), parts)
        return F.when(get(m, "$.type") == "user", some(_typed(said, (" ".join(["You are an AI agent", "that brings", "the power of Gemini"]),)), "prompt_ai")).when(get(m, "$.type") == "gemini", per(items(m, "$.toolCalls"), call)).otherwise(none())

    return F.when(native, per(events, message)).otherwise(claude_code(raw))


register_adapter("gemini-cli", gemini_cli)


def opencode(raw: Column) -> Column:
    tools = words(read_file="read", search_repo="grep glob webfetch tavily_tavily-search web_search list", edit="edit write apply_patch", think="todowrite")

    def message(m: Column) -> Column:
        role = get(m, "$.info.role")

        def part(p: Column) -> Column:
            name = F.lower(F.coalesce(get(p, "$.tool"), F.lit("")))
            atom = F.when(name == "bash", terminal_atom(get(p, "$.state.input.command"))).otherwise(lookup(tools, name))
            return F.when((role == "user") & (get(p, "$.type") == "text"), some(filled(get(p, "$.text")), "prompt_ai")).when((role == "assistant") & (get(p, "$.type") == "tool"), F.array(atom)).otherwise(none())

        return per(items(m, "$.parts"), part)

    return per(items(raw, "$.events"), message)


register_adapter("opencode", opencode)


def cursor_companion(raw: Column) -> Column:
    def event(e: Column) -> Column:
        d = F.try_variant_get(e, "$.details", "variant")
        d = F.when(F.schema_of_variant(d) == "STRING", F.try_parse_json(F.try_variant_get(d, "$", "string"))).otherwise(d)

        def value(name: str) -> Column:
            own = get(e, f"$.{name}")
            return F.coalesce(F.when(own != "", own), get(d, f"$.{name}"))

        kind = F.lower(F.coalesce(value("type"), F.lit("")))
        on = lambda *names: F.greatest(*[F.coalesce(~F.lower(value(n)).isin("", "0", "0.0", "false", "[]", "{}", "null"), F.lit(False)) for n in names], F.lit(False))
        got = F.flatten(
            F.array(
                some(kind.isin("file_search", "search", "grep"), "search_repo"),
                some(kind.isin("file_open", "file_read") | on("context_files"), "read_file"),
                some(kind.isin("prompt", "ai_prompt", "llm_prompt", "prompt_with_edit"), "prompt_ai"),
                some(kind.isin(*"code_change edit entry_created file_change file_save prompt_with_edit".split()) | on("lines_added", "lines_removed"), "edit"),
                some(kind.isin("terminal", "terminal_command", "command_run"), "run_test"),
            )
        )
        return F.when(F.size(got) > 0, F.array_distinct(got)).otherwise(F.array(F.lit("other")))

    return per(items(raw, "$.events"), event)


register_adapter("cursor-companion", cursor_companion)

_CURSOR_TOOLS = words(read_file="read_file", search_repo="grep codebase_search glob_file_search list_dir rg web_search ripgrep_raw_search", edit="search_replace write apply_patch edit_notebook edit_file _codeblock", delete_file="delete_file", lint="read_lints", run_code="run_terminal_cmd run_terminal_command")


def cursor_vscdb(raw: Column) -> Column:
    def event(e: Column) -> Column:
        kind = F.lower(get(e, "$.kind"))
        return F.array(F.when(kind == "prompt", "prompt_ai").when(kind == "think", "think").otherwise(lookup(_CURSOR_TOOLS, F.lower(F.coalesce(get(e, "$.tool"), F.lit(""))))))

    return per(items(raw, "$.events"), event)


register_adapter("cursor-vscdb", cursor_vscdb)


# ---------------------------------------------------------------- canonicalize
def canonicalize(records: DataFrame, adapter: str | Adapter, trace_id_field: str = "trace_id", agent_field: str = "agent", group_field: str = "group", raw: str = "raw", metadata: tuple[str, ...] | None = None) -> DataFrame:
    """Trajectories from records with a VARIANT column raw.

    metadata names the top-level fields to keep (None keeps every scalar field but id and
    agent). A group that is present but null is null.
    """
    fn = get_adapter(adapter) if isinstance(adapter, str) else adapter
    v = F.col(raw)
    table = F.try_variant_get(v, "$", "map<string,variant>")
    strings = F.transform_values(table, lambda k, x: F.try_variant_get(x, "$", "string"))
    keep = (lambda k: k.isin(*metadata)) if metadata is not None else (lambda k: ~k.isin(trace_id_field, agent_field))
    return records.select(
        F.coalesce(get(v, f"$.{trace_id_field}"), F.lit("")).alias("trace_id"),
        F.coalesce(get(v, f"$.{agent_field}"), F.lit("")).alias("agent"),
        get(v, f"$.{group_field}").alias("group"),
        F.coalesce(fn(v), none()).alias("atoms"),
        F.map_filter(strings, lambda k, x: keep(k) & x.isNotNull()).alias("metadata"),
        (F.col("_ord") if "_ord" in records.columns else F.monotonically_increasing_id()).alias("_ord"),
    )


def anonymous_id(c: Column) -> Column:
    return F.substring(F.sha2(c.cast("binary"), 256), 1, 8)


def hashed_path(c: Column) -> Column:
    return F.substring(F.sha1(c.cast("binary")), 1, 12)


def outcome(metadata: Column) -> Column:
    """resolved, unresolved or '' from the first known outcome field."""
    v = F.coalesce(*[F.try_element_at(metadata, F.lit(k)) for k in "resolved is_resolved solved passed".split()])
    return F.when(v.isNull(), "").when(F.lower(v).isin("", "false", "0", "none", "null"), "unresolved").otherwise("resolved")


def reasoning_tokens(raw: Column) -> Column:
    """A quarter of the characters that the model's turns hold, turn by turn, rounded down."""
    model = F.filter(items(raw, "$.messages"), lambda m: _assistant(m, ("assistant", "ai", "model")))
    return F.aggregate(model, F.lit(0).cast("long"), lambda s, m: s + F.floor(F.length(F.coalesce(text(m, "$.content"), text(m, "$.thought"), F.lit(""))) / 4))
