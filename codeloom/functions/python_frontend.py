"""One Python file as facts: symbols, imports, calls, annotations and flow hops.

A *hop* says that within one function a value can go from an origin (a parameter,
outside input, or the result of a call) to a target (the return value, a call's
argument or receiver, a dangerous call).  It carries the categories that made the value safe on
the way.  Hops are flow-sensitive: assignments replace, branches join, loops run to
a fixpoint.  How functions are connected is not known here; joins of all
files' facts find out.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from functools import cached_property

from codeloom.functions.classify import guard_type, is_source, is_source_call, sanitizer_type, sink_type
from codeloom.functions.identity import identity

MODULE = "<module>"
MAX_NODES, MAX_DEPTH = 20000, 128
_ROUTES = {"route", "get", "post", "put", "delete", "patch", "options", "head", "websocket"}
_APPS = {"flask": {"Flask", "Blueprint"}, "fastapi": {"FastAPI", "APIRouter"}}
Origin = str  # "param:0", "source:12:request.args", "result:3"
Env = dict[str, frozenset[Origin]]
NONE: frozenset[Origin] = frozenset()


@dataclass
class Facts:
    symbols: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    calls: list[dict] = field(default_factory=list)
    annotations: list[dict] = field(default_factory=list)
    hops: list[dict] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)


def dotted(node: ast.AST) -> str | None:
    """``a.b.c`` of names and attributes; None for anything else."""
    parts: list[str] = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return None
    return ".".join([node.id, *reversed(parts)])


def children(node: ast.AST) -> list[ast.AST]:
    """What ``ast.iter_child_nodes`` gives, as a list."""
    out = []
    for name in node._fields:
        value = getattr(node, name, None)
        if isinstance(value, ast.AST):
            out.append(value)
        elif isinstance(value, list):
            out += [v for v in value if isinstance(v, ast.AST)]
    return out


def clip(text: str, limit: int = 240) -> str:
    return " ".join(text.split())[:limit]


class _Frontend:
    def __init__(self, project: str, path: str, source: str) -> None:
        self.project, self.path, self.source = project, path, source
        self.facts = Facts()
        self.ordinals: dict[tuple[str, str], int] = {}
        self.apps: dict[str, str] = {}

    def symbol(self, node: ast.AST | None, name: str, qualified: str, kind: str, params: list[str]) -> str:
        key = (qualified, kind)
        ordinal = self.ordinals.get(key, 0)
        self.ordinals[key] = ordinal + 1
        sid = identity([self.project, self.path, MODULE] if node is None else [self.project, self.path, qualified, kind, ordinal])
        start, end = (node.lineno, node.end_lineno or node.lineno) if node is not None else (1, self.source.count("\n") + 1)
        self.facts.symbols.append({"id": sid, "name": name, "qualified": qualified, "kind": kind, "start_line": start, "end_line": end, "parameters": params})
        return sid

    def annotate(self, owner: str, kind: str, category: str, name: str, line: int) -> None:
        aid = identity([owner, line, kind, name])
        if all(a["id"] != aid for a in self.facts.annotations):
            self.facts.annotations.append({"id": aid, "owner": owner, "kind": kind, "category": category, "name": name, "line": line})

    def run(self) -> Facts:
        try:
            tree = ast.parse(self.source)
        except (SyntaxError, ValueError, RecursionError) as e:
            self.facts.notes.append(f"{self.path}: not parsed ({type(e).__name__})")
            return self.facts
        count, depth, level, found = 0, 0, [tree], []
        while level:  # level by level, as ast.walk does
            count += len(level)
            if count > MAX_NODES or depth > MAX_DEPTH:
                self.facts.notes.append(f"{self.path}: too large or too deep to analyse")
                return self.facts
            found += [n for n in level if isinstance(n, ast.Import | ast.ImportFrom)]
            level, depth = [c for n in level for c in children(n)], depth + 1
        self.imports(found)
        module = self.symbol(None, MODULE, MODULE, "module", [])
        _Function(self, module, "", []).body(tree.body)
        return self.facts

    @cached_property
    def lines(self) -> list[str]:
        """The source as the parser splits it, with the line ends."""
        return re.findall(r".*?(?:\r\n|\n|\r|$)", self.source)

    def segment(self, node: ast.expr) -> str:
        """What ``ast.get_source_segment`` gives, without splitting the source for every node."""
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            return self.lines[first].encode()[node.col_offset : node.end_col_offset].decode()
        return "".join([self.lines[first].encode()[node.col_offset :].decode(), *self.lines[first + 1 : last], self.lines[last].encode()[: node.end_col_offset].decode()])

    def imports(self, nodes: list[ast.AST]) -> None:
        for node in nodes:
            if isinstance(node, ast.Import):
                for a in node.names:
                    self.facts.imports.append({"module": a.name, "imported": None, "local": a.asname or a.name.split(".")[0], "line": node.lineno, "whole": a.asname is not None or "." not in a.name})
            elif isinstance(node, ast.ImportFrom):
                module = "." * node.level + (node.module or "")
                for a in node.names:
                    self.facts.imports.append({"module": module, "imported": a.name, "local": a.asname or a.name, "line": node.lineno, "whole": False})


class _Function:
    """Walks one function (or the module) with the origins that each name may hold."""

    def __init__(self, front: _Frontend, owner: str, scope: str, params: list[str], env: Env | None = None) -> None:
        self.front, self.owner, self.scope = front, owner, scope
        self.env: Env = {p: frozenset([f"param:{i}"]) for i, p in enumerate(params)} | (env or {})
        self.seen: set[tuple] = set()
        self.call_ids: dict[int, str] = {}

    # targets

    def hop(self, origins: frozenset[Origin], target: str, line: int, **more) -> None:
        for o in sorted(origins):
            key = (o, target)
            if key not in self.seen:
                self.seen.add(key)
                self.front.facts.hops.append({"owner": self.owner, "origin": o, "target": target, "line": line, "category": more.get("category"), "name": more.get("name"), "snippet": more.get("snippet")})

    def source(self, name: str, line: int) -> frozenset[Origin]:
        self.front.annotate(self.owner, "source", "input", name, line)
        return frozenset([f"source:{line}:{name}"])

    # names

    def lookup(self, name: str) -> frozenset[Origin]:
        while True:
            if name in self.env:
                return self.env[name]
            if "." not in name:
                return NONE
            name = name.rsplit(".", 1)[0]

    def assign(self, target: ast.AST, value: frozenset[Origin], node: ast.AST | None = None) -> None:
        if isinstance(target, ast.Tuple | ast.List):
            parts = node.elts if isinstance(node, ast.Tuple | ast.List) and len(node.elts) == len(target.elts) else None
            for n, t in enumerate(target.elts):
                self.assign(t, self.value(parts[n]) if parts else value)
        elif isinstance(target, ast.Starred):
            self.assign(target.value, value)
        elif isinstance(target, ast.Subscript):
            base = dotted(target.value)
            if base:
                self.env[base] = self.lookup(base) | value
        else:
            name = dotted(target)
            if name:
                for k in [k for k in self.env if k.startswith(name + ".")]:
                    del self.env[k]
                self.env[name] = value
                if name.rsplit(".", 1)[-1] in ("innerHTML", "outerHTML"):
                    self.hop(value, f"sink:xss:{target.lineno}:{name}", target.lineno, category="xss", name=name, snippet=name)

    # expressions

    def value(self, node: ast.AST | None) -> frozenset[Origin]:
        if node is None or isinstance(node, ast.Constant | ast.Lambda):
            return NONE
        name = dotted(node)
        if name is not None:
            return self.source(name, node.lineno) if is_source(name) else self.lookup(name)
        if isinstance(node, ast.Call):
            return self.call(node)
        if isinstance(node, ast.Subscript):
            base = dotted(node.value)
            if base and is_source(base):
                return self.source(base, node.lineno)
            return self.value(node.value) | self.value(node.slice)
        if isinstance(node, ast.NamedExpr):
            got = self.value(node.value)
            self.assign(node.target, got)
            return got
        if isinstance(node, ast.ListComp | ast.SetComp | ast.GeneratorExp | ast.DictComp):
            for g in node.generators:
                self.assign(g.target, self.value(g.iter))
            inner = [node.key, node.value] if isinstance(node, ast.DictComp) else [node.elt]
            return frozenset().union(*map(self.value, inner))
        out = NONE
        for child in children(node):
            if isinstance(child, ast.expr):
                out |= self.value(child)
        return out

    def call(self, node: ast.Call) -> frozenset[Origin]:
        name = dotted(node.func)
        receiver = NONE
        if name is None:
            if isinstance(node.func, ast.Attribute):
                receiver, name = self.value(node.func.value), node.func.attr
            else:
                receiver, name = self.value(node.func), "<expression>"
        elif "." in name:
            receiver = self.lookup(name.rsplit(".", 1)[0])
        line = node.lineno
        args = [self.value(a) for a in node.args]
        named = {k.arg or "**": self.value(k.value) for k in node.keywords}
        if is_source_call(name):
            return self.source(name, line)
        facts = self.front.facts
        shell = any(k.arg == "shell" and isinstance(k.value, ast.Constant) and k.value.value is True for k in node.keywords)
        snippet, sanitizer, category = clip(self.front.segment(node) or name), sanitizer_type(name), sink_type(name, shell)
        call_id = self.call_ids.get(id(node))
        if call_id is None:  # loops come here again
            call_id = self.call_ids[id(node)] = str(len(facts.calls))
            facts.calls.append({"call": call_id, "owner": self.owner, "scope": self.scope, "name": name, "line": line, "snippet": snippet, "sanitizer": sanitizer, "sink": category})
        guard = guard_type(name)
        if guard:
            self.front.annotate(self.owner, "security_guard", guard, name, line)
        if sanitizer:
            self.front.annotate(self.owner, "sanitizer", sanitizer, name, line)
        if category:
            self.front.annotate(self.owner, "security_sink", category, name, line)
            if args:
                self.hop(args[0], f"sink:{category}:{line}:{name}", line, category=category, name=name, snippet=snippet)
        for i, origins in enumerate(args):
            self.hop(origins, f"arg:{call_id}:{i}", line)
        for key, origins in named.items():
            self.hop(origins, f"arg:{call_id}:{key}", line)
        self.hop(receiver, f"arg:{call_id}:self", line)
        return frozenset([f"result:{call_id}"])

    # statements

    def body(self, statements: list[ast.stmt]) -> bool:
        """Walk a list; True if it ends in a return."""
        for s in statements:
            if self.statement(s):
                return True
        return False

    def branch(self, *bodies: list[ast.stmt]) -> bool:
        before, after, ends = dict(self.env), [], []
        for b in bodies:
            self.env = dict(before)
            ends.append(self.body(b))
            if not ends[-1]:
                after.append(self.env)
        self.env = {k: frozenset().union(*(e.get(k, NONE) for e in after)) for k in {k for e in after for k in e}} if after else before
        return all(ends)

    def loop(self, statements: list[ast.stmt]) -> None:
        for _ in range(8):
            before = dict(self.env)
            self.body(statements)
            for k, v in before.items():
                self.env[k] = self.env.get(k, NONE) | v
            if self.env == before:
                return
        self.front.facts.notes.append(f"{self.front.path}: a loop did not settle")

    def statement(self, s: ast.stmt) -> bool:
        if isinstance(s, ast.FunctionDef | ast.AsyncFunctionDef):
            self.function(s)
        elif isinstance(s, ast.ClassDef):
            qualified = f"{self.scope}.{s.name}" if self.scope else s.name
            self.front.symbol(s, s.name, qualified, "class", [])
            inner = _Function(self.front, self.owner, qualified, [])
            inner.env = dict(self.env)
            inner.call_ids = self.call_ids
            inner.body(s.body)
        elif isinstance(s, ast.Assign):
            value = self.value(s.value)
            for t in s.targets:
                self.assign(t, value, s.value)
                if isinstance(s.value, ast.Call) and isinstance(t, ast.Name):
                    self.front.apps[t.id] = dotted(s.value.func) or ""
        elif isinstance(s, ast.AnnAssign):
            if s.value is not None:
                self.assign(s.target, self.value(s.value))
        elif isinstance(s, ast.AugAssign):
            name = dotted(s.target)
            self.assign(s.target, (self.lookup(name) if name else NONE) | self.value(s.value))
        elif isinstance(s, ast.Return):
            self.hop(self.value(s.value), "return", s.lineno)
            return True
        elif isinstance(s, ast.If):
            self.value(s.test)
            return self.branch(s.body, s.orelse)
        elif isinstance(s, ast.For | ast.AsyncFor):
            self.assign(s.target, self.value(s.iter))
            self.loop(s.body)
            self.body(s.orelse)
        elif isinstance(s, ast.While):
            self.value(s.test)
            self.loop(s.body)
            self.body(s.orelse)
        elif isinstance(s, ast.With | ast.AsyncWith):
            for item in s.items:
                got = self.value(item.context_expr)
                if item.optional_vars is not None:
                    self.assign(item.optional_vars, got)
            return self.body(s.body)
        elif isinstance(s, ast.Try | ast.TryStar):
            self.branch(s.body + s.orelse, *[h.body for h in s.handlers] or [[]])
            return self.body(s.finalbody)
        elif isinstance(s, ast.Match):
            self.value(s.subject)
            return self.branch(*[c.body for c in s.cases], [])
        elif isinstance(s, ast.Raise):
            self.value(s.exc)
            return True
        else:
            for child in children(s):
                if isinstance(child, ast.expr):
                    self.value(child)
        return False

    def function(self, s: ast.FunctionDef | ast.AsyncFunctionDef) -> None:
        front = self.front
        qualified = f"{self.scope}.{s.name}" if self.scope else s.name
        args = [*s.args.posonlyargs, *s.args.args, *s.args.kwonlyargs]
        parent = next((x for x in reversed(front.facts.symbols) if x["qualified"] == self.scope and x["kind"] == "class"), None)
        if parent is not None and args and args[0].arg in ("self", "cls"):
            args = args[1:]
        names = [a.arg for a in args]
        sid = front.symbol(s, s.name, qualified, "method" if parent is not None else "function", names)
        inner = _Function(front, sid, qualified, names)
        for d in s.decorator_list:
            name = dotted(d.func if isinstance(d, ast.Call) else d)
            if name and guard_type(name):
                front.annotate(sid, "security_guard", guard_type(name), name, s.lineno)
            if name and isinstance(d, ast.Call) and "." in name:
                base, verb = name.rsplit(".", 1)
                framework = self.framework(front.apps.get(base, ""))
                if framework and verb in _ROUTES:
                    for a in args:
                        plain = a.annotation is None if framework == "flask" else a.annotation is not None and dotted(a.annotation) == "str"
                        if plain:
                            inner.env[a.arg] = inner.source(f"route parameter {a.arg}", s.lineno)
        inner.body(s.body)

    def framework(self, made: str) -> str | None:
        """The framework whose application the call of ``made`` gives, by the file's imports, renamed or not."""
        first, _, rest = made.partition(".")
        for i in self.front.facts.imports:
            name = i["imported"] or rest.rsplit(".", 1)[-1]
            root = i["module"].split(".")[0]
            if name in _APPS.get(root, ()) and first in (i["local"], i["module"].split(".")[0] if i["imported"] is None else i["local"]):
                return root
        return None


def extract(project: str, path: str, source: str) -> Facts:
    """All facts of one file; what cannot be analysed is a note, never a silent nothing."""
    return _Frontend(project, path, source).run()
