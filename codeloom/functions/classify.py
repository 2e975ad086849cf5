"""Syntactic classes of call names: sinks, sanitizers, guards and sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Last name segments of dangerous calls; the first argument counts.
SINKS = {
    "sql-injection": ("execute", "executemany", "query", "raw", "executeRaw", "queryRawUnsafe"),
    "command-injection": ("exec", "execSync", "system", "popen"),
    "xss": ("send", "write", "html", "innerHTML"),
    "path-traversal": ("open", "readFile", "readFileSync", "read_to_string", "sendFile", "read_text"),
}
#: Calls that are command sinks if a shell is asked for.
SHELL_SINKS = ("run", "call", "Popen", "spawn", "spawnSync")
#: Calls that make a value safe, by category.
SANITIZERS = {
    "xss": ("escapeHtml", "escape_html", "sanitizeHtml", "sanitize_html", "escape"),
    "command-injection": ("quote",),
    "path-traversal": ("safe_path", "validate_path"),
    "sql-injection": ("parameterize", "parameterized_query"),
}
#: Calls that look like access checks.
GUARDS = {
    "authentication": ("authenticate", "require_auth", "login_required", "isAuthenticated"),
    "authorization": ("authorize", "check_permission", "requires_permission", "hasPermission"),
}
#: Expressions that bring in outside input, alone or followed by . or [.
SOURCES = (
    "req.body", "req.query", "req.params", "req.headers", "req.cookies",
    "request.args", "request.form", "request.json", "request.GET", "request.POST", "request.query", "request.body",
    "request.query_params", "request.headers", "request.cookies",
    "location.hash", "location.search", "window.location.hash", "window.location.search",
)
_SOURCE_STARTS = tuple(s + end for s in SOURCES for end in ".[")
#: Calls that bring in outside input.
SOURCE_CALLS = ("input", "request.get_json", "sys.stdin.read")


def sink_type(name: str, shell: bool = False) -> str | None:
    tail = name.replace("::", ".").rsplit(".", 1)[-1]
    for kind, tails in SINKS.items():
        if tail in tails or kind == "command-injection" and shell and tail in SHELL_SINKS:
            return kind
    return None


def _by_tail(name: str, table: dict[str, tuple[str, ...]]) -> str | None:
    tail = name.rsplit(".", 1)[-1]
    return next((kind for kind, tails in table.items() if tail in tails), None)


def sanitizer_type(name: str) -> str | None:
    return _by_tail(name, SANITIZERS)


def guard_type(name: str) -> str | None:
    return _by_tail(name, GUARDS)


def is_source(expression: str) -> bool:
    expression = "".join(expression.split())
    return expression in SOURCES or expression.startswith(_SOURCE_STARTS)


def is_source_call(name: str) -> bool:
    return name in SOURCE_CALLS or is_source(name)


def _tail(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def _case(tail: Column, table: dict[str, tuple[str, ...]]) -> Column:
    out = None
    for kind, tails in table.items():
        out = (F if out is None else out).when(tail.isin(*tails), kind)
    return out


def sink_type_col(name: Column, shell: Column) -> Column:
    tail = _tail(F.replace(name, F.lit("::"), F.lit(".")))
    return F.coalesce(_case(tail, SINKS), F.when(shell & tail.isin(*SHELL_SINKS), "command-injection"))


def sanitizer_type_col(name: Column) -> Column:
    return _case(_tail(name), SANITIZERS)


def guard_type_col(name: Column) -> Column:
    return _case(_tail(name), GUARDS)


def is_source_col(expression: Column) -> Column:
    names = "|".join(s.replace(".", r"\.") for s in SOURCES)
    return F.regexp_replace(expression, r"\s+", "").rlike(rf"^(?:{names})(?:\z|[.\[])")
