"""One query per raw log format: trajectories written as raw records of the format and read back through its adapter.

Each format has a table of cases: a raw element as JSON, and the atoms that it stands for.
A trajectory's i-th action picks a case by its place and kind, so every case occurs in
many neighbourhoods, the lenient ones (missing keys, wrong kinds, blanks) included. The
SQL side never sees a raw record: it looks up what each case stands for.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import bridge
from ..sources.adapters import canonicalize
from ..sources.bridge import TRACE_SQL

ATOMS = ("edit", "error", "prompt_ai", "read_file", "run_test", "search_repo", "submit", "think")
Case = tuple[object, str]


def _steps(field: str, thought: str, names: dict[str, str]) -> list[Case]:
    """Action lists: every known name, unknown and null ones, thoughts, and elements that are no objects."""
    out: list[Case] = [({field: name}, atom) for name, atom in names.items()]
    some = next(iter(names.items()))
    return out + [
        ({field: "never heard of"}, "other"), ({field: None}, "other"), ({}, "other"), (7, ""), ("text", ""), (None, ""), ([1], ""),
        ({field: some[0], thought: "first look"}, f"think {some[1]}"), ({field: some[0], thought: " \t\n"}, some[1]), ({field: some[0], thought: None}, some[1]), ({thought: "only this"}, "think other"),
    ]


#: the first shell classifier: commands as an agent with bash as its only tool writes them
_BASH: list[tuple[str, str]] = [
    ("cat a.py", "read_file"), ("head -3 x", "read_file"), ("bat x", "read_file"), ("grep -rn foo .", "search_repo"), ("fd x", "search_repo"), ("find . -name x", "search_repo"),
    ("sed -i s/a/b/ f", "edit"), ("patch -p1", "edit"), ("pytest -q", "run_test"), ("python -m pytest tests", "run_test"), ("python -m django test", "run_test"), ("tox", "run_test"),
    ("python a.py", "run_code"), ("python3 -c 1", "run_code"), ("mkdir d", "create_file"), ("touch f", "create_file"), ("rm f", "delete_file"), ("rmdir d", "delete_file"),
    ("echo hi > f.txt", "edit"), ("cat <<'EOF' | python", "edit"), ("git diff", "submit"), ("git format-patch", "submit"), ("git status", "other"), ("submit", "submit"), ("MINI_SWE_AGENT_FINAL_OUTPUT", "submit"),
    ("cd /x && grep a", "search_repo"), ("cd /x ; cd y && cat f", "read_file"), ("cd only", "other"), ("", "other"), ("   ", "other"), ("ls", "other"), ("PYTEST", "other"), ("cd a && python -c 'x\ny'", "run_code"),
]
#: the second classifier, by kinds in order, case aside; the last three kinds only for terminals
_KINDS: list[tuple[str, str]] = [
    ("pytest -q", "run_test"), ("cd a/tests", "run_test"), ("go test ./...", "run_test"), ("npm run test", "run_test"), ("git status", "version_control"), ("ls; gh pr", "version_control"), ("digit x", "other"),
    ("pip install x", "package"), ("uv sync", "package"), ("go mod; update", "other"), ("cargo update", "package"), ("ruff check", "lint"), ("RUFF x", "lint"), ("grep a b", "search_repo"), ("cat x | rg y", "search_repo"),
    ("python a.py", "run_code"), ("make all", "run_code"), ("./run.sh", "run_code"), ("node x", "run_code"), ("echo hi", "other"), ("", "other"),
]
_TERMINAL: list[tuple[str, str]] = _KINDS + [("cat x", "read_file"), ("sed -n 1p f", "read_file"), ("Get-Content f", "read_file"), ("ls -la", "search_repo"), ("tree", "search_repo"), ("Select-String x", "search_repo")]
_EDITOR = {"view": "read_file", "open": "read_file", "create": "create_file", "write": "create_file", "str_replace": "edit", "insert": "edit", "append": "edit", "VIEW": "read_file", "odd": "edit", "": "edit"}


def _assistant(**more: object) -> dict:
    return {"role": "assistant", **more}


def _mini() -> list[Case]:
    out: list[Case] = [(_assistant(extra={"actions": [{"command": c}]}), a) for c, a in _BASH]
    return out + [
        (_assistant(content="hm", extra={"actions": [{"command": "cat f"}, {"command": "pytest"}, 3, {}]}), "think read_file run_test other"),
        (_assistant(content="only thought"), "think"), (_assistant(content="  ", extra={"actions": []}), ""), (_assistant(content="x", extra="no object"), "think"), (_assistant(content=None, extra={"actions": "none"}), ""),
        ({"role": "user", "content": "do it"}, ""), ({"content": "no role"}, ""), (5, ""), (None, ""),
    ]


def _call(name: object, arguments: object = None, wrap: bool = True) -> dict:
    body = {"name": name, "arguments": arguments}
    return {"function": body} if wrap else body


def _openhands() -> list[Case]:
    one = lambda c, a: (_assistant(tool_calls=[c]), a)
    out = [one(_call("execute_bash", json.dumps({"command": c})), a) for c, a in _BASH]
    out += [one(_call("str_replace_editor", {"command": c}), a) for c, a in _EDITOR.items()]
    return out + [
        one(_call("edit", "{}"), "edit"), one(_call("Run_Bash", {"command": "grep x"}, False), "search_repo"), one(_call("finish"), "submit"), one(_call("complete"), "submit"), one(_call("think"), "think"), one(_call("browse"), "other"), one({}, "other"),
        one(_call("bash", "{not json"), "other"), one(_call("bash", "[1]"), "other"), one("no object", ""), (_assistant(content="so", tool_calls=[_call("think"), 1, _call("submit")]), "think think submit"),
        (_assistant(content="words"), "think"), (_assistant(content=" ", tool_calls="none"), ""), ({"role": "tool", "content": "x"}, ""), (1, ""),
    ]


def _function_xml() -> list[Case]:
    f = lambda name, **p: f"<function={name}>" + "".join(f"<parameter={k}>{v}</parameter>" for k, v in p.items()) + "</function>"
    one = lambda t, a: (_assistant(content=t), a)
    shell = [(c, a) for c, a in _BASH if "<" not in c and ">" not in c]
    out = [one(f("execute_bash", command=c), a) for c, a in shell] + [one(f("file_editor", command=c), a) for c, a in _EDITOR.items()]
    return out + [
        one("Let me see.\n" + f("bash", command="cat f"), "think read_file"), one(f("bash", cmd="grep x", command="cat f"), "search_repo"), one(f("bash", cmd=" ", command="cat f"), "read_file"), one(f("bash") + " and " + f("submit"), "think other submit"),
        one("no call", "think"), one(" ", ""), ({"role": "ai", "text": f("think")}, "think"), ({"role": "assistant", "content": " ", "text": f("finish")}, "submit"), ({"role": "user", "content": f("bash", command="ls")}, ""),
        one(f("unknown"), "other"), one("<function=bash><parameter=command>\npytest\n</parameter>\n</function>", "run_test"), (_assistant(), ""), ("x", ""),
    ]


def _react() -> list[Case]:
    fence = lambda c, kind="bash": f"```{kind}\n{c}\n```"
    one = lambda t, a: (_assistant(content=t), a)
    out = [one(f"Now:\n{fence(c)}", f"think {a}") for c, a in _BASH if c.strip() and "\n" not in c]
    return out + [
        one(fence("# note\n\n  pytest\ncat f", "sh"), "think run_test"), one(fence("cat f", "") + "\nthen\n" + fence("rm f", "console"), "think read_file delete_file"), one(fence("cat f", "yaml"), "think"), one(fence("# only a note"), "think"),
        one("plain words", "think"), ({"role": "ai", "text": fence("git diff", "shell")}, "think submit"), ({"role": "user", "content": fence("ls")}, ""), (_assistant(content=""), ""), (_assistant(content=5), ""), (None, ""),
    ]


_TOOL_NAMES = {"run_tests": "run_test", "searchCode": "search_repo", "getFile": "read_file", "list_items": "read_file", "createIssue": "create_file", "delete_row": "delete_file", "updateRow": "edit", "renameHTTPFile": "edit", "execSQL": "run_code", "invoke": "run_code", "noop": "other", "latest": "other", "": "other", "findAndUpdate": "search_repo", "HTTPGet2": "read_file"}


def _completion() -> list[Case]:
    out: list[Case] = [(_assistant(tool_calls=[{"function": {"name": n}}]), a) for n, a in _TOOL_NAMES.items()]
    return out + [
        ({"role": "user", "content": "go"}, "prompt_ai"), (_assistant(content="thinking"), "think"), (_assistant(content="x", tool_calls=[{"name": "make_it"}, 4, {"function": {"name": 3}, "name": "view"}]), "think create_file read_file"),
        ({"role": "tool", "content": "Traceback (most recent call last)"}, "error"), ({"role": "tool", "content": "fine"}, ""), ({"role": "tool", "content": "x" * 120 + " error"}, ""), ({"role": "tool", "content": "File Not Found"}, "error"), ({"role": "system", "content": "error"}, ""), ({}, ""), (9, ""),
    ]


def _traj() -> list[Case]:
    out: list[Case] = [({"action": c}, a) for c, a in _TERMINAL if c]
    out += [({"action": f"str_replace_editor {op} f"}, a) for op, a in {"view": "read_file", "open": "read_file", "goto": "read_file", "scroll_up": "read_file", "str_replace": "edit", "insert": "edit", "create": "create_file", "odd": "edit"}.items()]
    return out + [
        ({"action": "str_replace_based_edit_tool"}, "edit"), ({"action": "submit"}, "submit"), ({"action": "exit_cost now"}, "submit"), ({"action": "exit_all"}, "other"), ({"action": " \n"}, ""), ({"action": None, "thought": "hm"}, "think"), ({"thought": "  "}, ""),
        ({"thought": "look", "action": "cat f", "observation": "x"}, "think read_file"), ({"action": 4}, ""), (3, ""),
    ]


#: (action, native label, canonical atom)
_NATIVE: list[tuple[str, str, str]] = [
    ("submit", "submit", "submit"), ("str_replace_editor view f", "str_replace_editor:view", "read_file"), ("str_replace_editor create f", "str_replace_editor:create", "create_file"), ("str_replace_editor undo_edit f", "str_replace_editor:undo", "edit"),
    ("str_replace_editor str_replace f", "str_replace_editor:str_replace", "edit"), ("str_replace_editor odd f", "str_replace_editor:odd", "other"), ("python -m pytest x", "python:pytest", "run_test"), ("python3 a.py", "python:script", "run_test"), ("python", "python:script", "run_test"),
    ("pytest x", "python:pytest", "run_test"), ("find . -name x", "find", "search_repo"), ("rg x", "grep", "search_repo"), ("ls", "ls", "read_file"), ("cat f", "cat", "read_file"), ("cat", "other:cat", "other"), ("rm f", "rm", "delete_file"), ("mkdir d", "mkdir_touch", "create_file"),
    ("mv a b", "mv_cp", "other"), ("chmod +x f", "permissions", "other"), ("echo x > f", "echo_redirect", "create_file"), ("echo x", "other:echo", "other"), ("cd /r && pytest", "pytest", "run_test"), ("cd /r && find . && ls", "chain:find", "search_repo"), ("find . | xargs grep x", "pipe:find", "search_repo"),
    ("ls || true", "ls", "read_file"), ("open f.py", "open", "read_file"), ("goto 3", "goto", "read_file"), ("edit 1:2", "edit", "edit"), ("search_dir x", "search_dir", "search_repo"), ("create", "create", "create_file"), ("WHAT now", "other:what", "other"),
]


def _smith(native: bool) -> list[Case]:
    pick = lambda n, c: n if native else c
    error = pick("empty_or_error", "error")
    out: list[Case] = [(_assistant(action=a), pick(n, c)) for a, n, c in _NATIVE]
    return out + [
        (_assistant(action=" ", thought="hm"), f"think {error}"), (_assistant(action="", thought=" "), error), (_assistant(thought="t", tool_calls=[{"function": {"name": "submit"}}]), "think submit"), (_assistant(tool_calls=[{"function": {"name": ""}}]), ""),
        (_assistant(tool_calls=[]), ""), (_assistant(action=None, tool_calls="x"), ""), ({"role": "user", "action": "ls"}, ""), (1, ""), (None, ""),
    ]


def _transcript() -> list[Case]:
    tool = lambda name, **i: {"type": "assistant", "message": {"content": [{"type": "tool_use", "name": name, "input": i}]}}
    said = lambda content: {"type": "user", "message": {"content": content}}
    out: list[Case] = [(tool("Bash", command=c), a) for c, a in _KINDS]
    names = {"Edit": "edit", "Write": "edit", "MultiEdit": "edit", "NotebookEdit": "edit", "Read": "read_file", "Grep": "search_repo", "Glob": "search_repo", "WebFetch": "search_repo", "TodoWrite": "think", "ExitPlanMode": "think", "Task": "other", "": "other"}
    out += [(tool(n), a) for n, a in names.items()]
    return out + [
        (said("please"), "prompt_ai"), (said("  "), ""), (said("<system-reminder>x"), ""), (said(" <bash-stdout>"), ""), (said([{"type": "text", "text": "do"}]), "prompt_ai"), (said([{"type": "text", "text": "do"}, {"type": "tool_result"}]), ""), (said([{"type": "image"}]), ""), (said(5), ""),
        ({"type": "file-history-snapshot"}, "edit"), ({"type": "assistant", "message": {"content": "text"}}, ""), ({"type": "assistant", "message": {"content": [{"type": "text", "text": "x"}, 3, {"type": "tool_use", "name": "Read"}, {"type": "tool_use", "name": "bash"}]}}, "read_file other"),
        ({"type": "user"}, ""), ({"type": "summary"}, ""), (2, ""), (None, ""),
    ]


def _codex() -> list[Case]:
    call = lambda name, a=None, kind="function_call": {"type": "response_item", "payload": {"type": kind, "name": name, "arguments": a}}
    out: list[Case] = [(call("shell", json.dumps({"cmd": c})), a) for c, a in _TERMINAL]
    names = {"apply_patch": "edit", "update_plan": "think", "write_stdin": "run_code", "mcp_fs_read": "read_file", "mcp_hover": "read_file", "mcp_write_file": "edit", "mcp_replace_x": "edit", "mcp_find": "search_repo", "mcp_symbols": "search_repo", "mcp_thinking": "think", "mcp_zzz": "other", "odd": "other", "": "other"}
    out += [(call(n), a) for n, a in names.items()]
    return out + [
        (call("exec_command", {"command": "git log"}), "version_control"), (call("Local_Shell", "{bad"), "other"), (call("apply_patch", "x", "custom_tool_call"), "edit"), (call("shell", {"cmd": "ls"}, "message"), ""),
        ({"type": "event_msg", "payload": {"type": "user_message", "message": "hi"}}, "prompt_ai"), ({"type": "event_msg", "payload": {"type": "user_message", "message": " "}}, ""), ({"type": "event_msg", "payload": {"type": "token_count"}}, ""), ({"type": "response_item", "payload": "x"}, ""), ({"type": "session_meta", "payload": {"id": "s"}}, ""), (1, ""),
    ]


def _gemini() -> list[Case]:
    call = lambda name, **a: {"type": "gemini", "toolCalls": [{"name": name, "args": a}]}
    out: list[Case] = [(call("run_shell_command", command=c), a) for c, a in _TERMINAL]
    names = {"read_file": "read_file", "mcp_serena_read_memory": "read_file", "glob": "search_repo", "google_web_search": "search_repo", "find_symbol": "search_repo", "mcp_serena_find_symbol": "search_repo", "replace": "edit", "write_file": "edit", "rename_symbol": "edit", "mcp_serena_replace_symbol_body": "edit", "write_todos": "think", "enter_plan_mode": "think", "odd": "other", "": "other"}
    out += [(call(n), a) for n, a in names.items()]
    return out + [
        ({"type": "user", "content": "go"}, "prompt_ai"), ({"type": "user", "content": [{"text": "go"}, {"text": "on"}]}, "prompt_ai"), ({"type": "user", "content": "  "}, ""), ({"type": "user", "content": []}, ""),
        ({"type": "gemini", "content": "words"}, ""), ({"type": "gemini", "toolCalls": [{"name": "glob"}, 5, {"name": "Shell", "args": {"command": "rm x"}}]}, "search_repo other"), ({"type": "info"}, ""), (4, ""),
    ]


def _opencode() -> list[Case]:
    tool = lambda name, **i: {"info": {"role": "assistant"}, "parts": [{"type": "tool", "tool": name, "state": {"input": i}}]}
    out: list[Case] = [(tool("bash", command=c), a) for c, a in _TERMINAL]
    names = {"read": "read_file", "grep": "search_repo", "WebFetch": "search_repo", "list": "search_repo", "edit": "edit", "apply_patch": "edit", "todowrite": "think", "odd": "other"}
    out += [(tool(n), a) for n, a in names.items()]
    return out + [
        ({"info": {"role": "user"}, "parts": [{"type": "text", "text": "go"}, {"type": "text", "text": " "}, {"type": "file"}]}, "prompt_ai"), ({"info": {"role": "assistant"}, "parts": [{"type": "text", "text": "x"}, 3, {"type": "tool", "tool": "read"}, {"type": "tool"}]}, "read_file other"),
        ({"info": {"role": "user"}, "parts": [{"type": "tool", "tool": "read"}]}, ""), ({"info": {"role": "assistant"}, "parts": "none"}, ""), ({"parts": [{"type": "text", "text": "x"}]}, ""), ({"info": "x", "parts": []}, ""), (1, ""),
    ]


_COMPANION: list[Case] = [
    ({"type": "grep"}, "search_repo"), ({"type": "FILE_SEARCH"}, "search_repo"), ({"type": "file_open"}, "read_file"), ({"type": "ai_prompt"}, "prompt_ai"), ({"type": "prompt_with_edit"}, "prompt_ai edit"), ({"type": "file_save"}, "edit"), ({"type": "terminal"}, "run_test"), ({"type": "odd"}, "other"), ({}, "other"),
    ({"type": "grep", "lines_added": 3}, "search_repo edit"), ({"type": "grep", "lines_added": 0, "lines_removed": 0}, "search_repo"), ({"type": "prompt", "context_files": ["a"]}, "read_file prompt_ai"), ({"type": "prompt", "context_files": []}, "prompt_ai"), ({"type": "", "details": {"type": "search"}}, "search_repo"),
    ({"details": "{\"type\": \"edit\", \"lines_added\": 2}"}, "edit"), ({"type": "grep", "details": {"type": "edit"}}, "search_repo"), ({"type": "grep", "details": "{bad"}, "search_repo"), ({"type": None, "details": {"context_files": "x"}}, "read_file"), (6, ""), ("x", ""),
]
_VSCDB: list[Case] = [({"kind": "ai", "tool": t}, a) for a, names in {"read_file": "read_file", "search_repo": "grep codebase_search glob_file_search list_dir rg web_search", "edit": "search_replace write apply_patch edit_file _codeblock", "delete_file": "delete_file", "lint": "read_lints", "run_code": "run_terminal_cmd run_terminal_command", "other": "odd"}.items() for t in names.split()] + [
    ({"kind": "prompt"}, "prompt_ai"), ({"kind": "think"}, "think"), ({"kind": "ai", "tool": "GREP"}, "search_repo"), ({"kind": "ai"}, "other"), ({}, "other"), (1, ""),
]
_TREE: list[Case] = [({"action": a, "node_type": "Call"}, f"{op}:Call") for a, op in {"insert-node": "ast_insert", "insert-tree": "ast_insert", "delete-node": "ast_delete", "delete-tree": "ast_delete", "update-node": "ast_update", "move-tree": "ast_move", "move-node": "ast_move"}.items()] + [
    ({"action": "insert-node"}, "ast_insert:?"), ({"action": "insert-node", "node_type": " "}, "ast_insert:?"), ({"action": "match", "node_type": "If"}, "other"), ({"node_type": "If"}, "other"), ({"action": "update-node", "node_type": " Name "}, "ast_update:Name"), (3, ""),
]

_SWE = {"edit": "edit", "str_replace": "edit", "str_replace_editor": "edit", "create": "create_file", "delete": "delete_file", "open": "read_file", "goto": "read_file", "scroll_down": "read_file", "scroll_up": "read_file", "search_dir": "search_repo", "search_file": "search_repo", "find_file": "search_repo", "grep": "search_repo", "run_test": "run_test", "pytest": "run_test", "submit": "submit", "exit": "submit"}
_AGENTLESS = {"fault_localization": "localize", "file_localization": "localize", "line_localization": "localize", "repair": "edit", "patch_generation": "edit", "regression_test": "run_test", "reproduction_test": "run_test", "submit": "submit"}
_DARS = {"localize": "localize", "read": "read_file", "edit": "edit", "test": "run_test", "search": "search_repo", "submit": "submit", "reason": "think", "error": "error"}
_MOATLESS = {"FindCode": "localize", "FindClass": "localize", "FindFunction": "localize", "SemanticSearch": "search_repo", "ViewCode": "read_file", "RequestCodeChange": "edit", "StringReplace": "edit", "CreateFile": "create_file", "RunTests": "run_test", "Finish": "submit"}

#: adapter -> (what stands before and after the elements, the cases, atoms before and after those of the cases, whether the list is a JSON string)
FORMATS: dict[str, tuple[str, str, list[Case], str, str, bool]] = {
    "swe-agent": ('"actions":[', "]", _steps("action", "thought", _SWE), "", "", False),
    "agentless": ('"actions":[', "]", _steps("phase", "reasoning", _AGENTLESS), "", "", False),
    "dars": ('"actions":[', "]", _steps("tool", "thought", _DARS), "", "", False),
    "moatless": ('"actions":[', "]", _steps("action", "thoughts", _MOATLESS), "", "", False),
    "gumtree": ('"actions":[', "]", _TREE, "", "", False),
    "mini-swe-agent": ('"info":{"exit_status":"LimitsExceeded"},"messages":[', "]", _mini(), "", "error", False),
    "openhands": ('"messages":[', "]", _openhands(), "", "", False),
    "function-xml": ('"messages":[', "]", _function_xml(), "", "", False),
    "react-text": ('"messages":[', "]", _react(), "", "", False),
    "prompt-completion": ('"prompt":[{"role":"system"},{"role":"user","content":"x"}],"completion":[', "]", _completion(), "prompt_ai", "", False),
    "swe-agent-traj": ('"trajectory":[', "]", _traj(), "", "", False),
    "swe-smith": ('"messages":', "", _smith(False), "", "", True),
    "swe-smith-native": ('"messages":', "", _smith(True), "", "", True),
    "claude-code": ('"events":[', "]", _transcript(), "", "", False),
    "codex": ('"events":[', "]", _codex(), "", "", False),
    "gemini-cli": ('"events":[{"type":"gemini"},', "]", _gemini(), "", "", False),
    "opencode": ('"events":[', "]", _opencode(), "", "", False),
    "cursor-companion": ('"events":[', "]", _COMPANION, "", "", False),
    "cursor-vscdb": ('"events":[', "]", _VSCDB, "", "", False),
}


def records(traces: DataFrame, adapter: str) -> DataFrame:
    """The trajectories as raw records of a format."""
    head, tail, cases, _, _, quoted = FORMATS[adapter]
    table = F.array(*[F.lit(json.dumps(c, ensure_ascii=False)) for c, _ in cases])
    number = lambda a, i: ((i * 3 + F.array_position(F.array(*map(F.lit, ATOMS)), a)) % len(cases) + 1).cast("int")
    elements = F.array_join(F.transform("atoms", lambda a, i: F.element_at(table, number(a, i))), ",")
    if quoted:
        elements = F.concat(F.lit('"['), F.regexp_replace(elements, r'(["\\])', r"\\$1"), F.lit(']"'))
    raw = F.concat(F.lit('{"trace_id":"'), "trace_id", F.lit('","agent":"'), "agent", F.lit(f'",{head}'), elements, F.lit(f"{tail}}}"))
    return traces.select(F.parse_json(raw).alias("raw"), "_ord")


def sql(adapter: str, head: str = "trace_id, agent", more: str = "") -> str:
    """What the cases stand for, as the column spine; head and more are further columns of tr."""
    _, _, cases, before, after, _ = FORMATS[adapter]
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    table = f"[{', '.join(quote(a) for _, a in cases)}]"
    kinds = f"[{', '.join(map(quote, ATOMS))}]"
    parts = f"list_filter(list_transform(atoms, lambda a, i: t[((i - 1) * 3 + list_position({kinds}, a)) % {len(cases)} + 1]), lambda x: x <> '')"
    whole = f"list_filter([{quote(before)}, array_to_string({parts}, ' '), {quote(after)}], lambda x: x <> '')"
    return f"WITH {TRACE_SQL} SELECT {head}, array_to_string({whole}, ' ') AS spine{more} FROM (SELECT *, {table} AS t FROM tr)"


def register(query: Callable) -> None:
    def add(adapter: str) -> None:
        @query("adapter_" + adapter.replace("-", "_"), sql(adapter))
        def run(spark, sf):
            t = canonicalize(records(bridge.traces(spark, sf), adapter), adapter)
            return t.select("trace_id", "agent", F.array_join("atoms", " ").alias("spine"))

    for adapter in FORMATS:
        add(adapter)
