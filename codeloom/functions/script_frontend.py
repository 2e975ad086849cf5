"""JavaScript, TypeScript and Rust files as the same facts as Python files.

There is no grammar here: names, brackets and statements of the scanner in
``syntax`` give symbols, imports, calls and hops.  An assignment within a nested block
adds to what a name of an outer block may hold, as the block may not run.  Callbacks without a
name belong to the function they stand in.
"""

from __future__ import annotations

import re

from codeloom.functions.classify import guard_type, is_source, is_source_call, sanitizer_type, sink_type
from codeloom.functions.identity import identity
from codeloom.functions.python_frontend import MODULE, NONE, Facts, Origin, clip
from codeloom.functions.syntax import Syntax, SyntaxProblem, parse

_NAME = r"[A-Za-z_$][\w$]*"
_CHAIN = re.compile(rf"(?<![\w$.]){_NAME}(?:\s*(?:\?\.|\.|::)\s*{_NAME})*")
_ASSIGN = re.compile(rf"(?<![\w$.])(?:(const|let|var)\s+(?:mut\s+)?)?({_NAME}(?:\.{_NAME})*)\s*(?::\s*[\w$<>\[\]&:|, ]+?)?\s*(\+?)=(?![=>])")
_UNPACK = re.compile(r"(?:const|let|var)\s*[{\[]([^{}\[\]]*)[}\]]\s*=(?![=>])")
_EACH = re.compile(rf"\bfor\s*\(?\s*(?:(?:const|let|var)\s+)?({_NAME})\s+(?:of|in)\s+")
_RETURN = re.compile(r"(?<![\w$.])return\b")
_ROUTE = re.compile(rf"(?<![\w$.])({_NAME})\s*\.\s*(get|post|put|delete|patch|head|options|all|use|register)\s*\(")
_BOUND = re.compile(rf"(?:const|let|var)\s+({_NAME})\s*(?::[^=;]+)?=\s*")
_INLINE_FACTORY = re.compile(r"""require\(\s*['"](?:express|fastify)['"]\s*\)\s*(?:\.\s*Router\s*)?\(""")
_ARROW = re.compile(rf"(?:async\s*)?(?:\(([^()]*)\)|({_NAME}))\s*(?::[^=]+)?=>\s*")
_FUNCTION = re.compile(rf"(?:async\s+)?function\s*\*?\s*(?:{_NAME})?\s*\(([^()]*)\)\s*(?::[^{{]+)?(?={{)")
_NAMED = (
    ("function", re.compile(rf"\bfunction\s*\*?\s*({_NAME})\s*\(")),
    ("function", re.compile(rf"(?:const|let|var)\s+({_NAME})\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\(?[^=;{{}}]*\)?\s*=>\s*\Z)")),
    ("class", re.compile(rf"\b(?:class|interface)\s+({_NAME})")),
    ("function", re.compile(rf"\bfn\s+({_NAME})")),
    ("class", re.compile(rf"\b(?:struct|enum|trait)\s+({_NAME})")),
    ("class", re.compile(rf"\bimpl\b(?:\s*<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?({_NAME})")),
    ("method", re.compile(rf"^\s*(?:(?:public|private|protected|static|async|get|set|\*)\s+)*({_NAME})\s*\([^;]*\)\s*(?::[^{{;]+)?\Z", re.DOTALL)),
)
_DEFINES = re.compile(r"\s*(?::[^{;()]*)?(?:->[^{;]*)?\{")
_NOT_METHODS = {"if", "for", "while", "switch", "catch", "function", "with", "return", "match", "loop", "else"}


class _Frontend:
    def __init__(self, project: str, path: str, source: str, language: str) -> None:
        self.project, self.path, self.source, self.language = project, path, source, language
        self.facts = Facts()

    def run(self) -> Facts:
        try:
            self.tree: Syntax = parse(self.source, self.language)
        except (SyntaxProblem, RecursionError) as e:
            self.facts.notes.append(f"{self.path}: not parsed ({e})")
            return self.facts
        code = list(self.source)
        for a, b in self.tree.literals:
            for i in range(a, b):
                code[i] = " " if code[i] != "\n" else "\n"
        self.plain = self._without_template_text("".join(code))
        self.ends = {a: b for a, b in self.tree.contexts if self.plain[a] == "{"}
        self.params = {a: p for a, _, p in self.tree.functions}
        self.calls: dict[int, int] = {}
        for a, b in self.tree.nodes:
            if self.plain[b - 1] == ")" and not _DEFINES.match(self.plain, b):
                self.calls[a] = max(b, self.calls.get(a, 0))
        self.numbers: dict[tuple[int, int], str] = {}
        self._imports()
        self._walk()
        return self.facts

    def _without_template_text(self, plain: str) -> str:
        out, i, inside = list(plain), 0, []
        while i < len(plain):
            c = plain[i]
            if c == "`":
                if inside and inside[-1] == -1:
                    inside.pop()
                else:
                    inside.append(-1)
                out[i] = " "
            elif inside and inside[-1] == -1:
                if plain.startswith("${", i):
                    inside.append(1)
                    out[i] = "+"
                    out[i + 1] = " "
                    i += 1
                else:
                    out[i] = " " if c != "\n" else c
            elif inside:
                inside[-1] += (c == "{") - (c == "}")
                if not inside[-1]:
                    inside.pop()
                    out[i] = "+"
            i += 1
        return "".join(out)

    def line(self, at: int) -> int:
        return self.source.count("\n", 0, at) + 1

    # imports

    def _imports(self) -> None:
        text = self.source

        def add(module: str, imported: str | None, local: str, at: int) -> None:
            if not self.tree.in_literal(at, at + 1):
                self.facts.imports.append({"module": module, "imported": imported, "local": local, "line": self.line(at), "whole": imported is None})

        def members(names: str, module: str, at: int, renames: str) -> None:
            for part in names.split(","):
                m = re.match(rf"\s*(?:type\s+)?({_NAME})(?:\s*{renames}\s*({_NAME}))?\s*\Z", part)
                if m:
                    add(module, m[1], m[2] or m[1], at)

        if self.language == "rust":
            for m in re.finditer(r"\buse\s+([\w:]+?)(?:::\{([^}]*)\}|::(\w+)(?:\s+as\s+(\w+))?)?\s*;", self.plain):
                if m[2]:
                    members(m[2], m[1], m.start(), "as")
                elif m[3]:
                    add(m[1], m[3], m[4] or m[3], m.start())
            return
        quoted = r"""['"]([^'"]+)['"]"""
        for m in re.finditer(rf"\bimport\s+(?:type\s+)?([^;'\"]*?)\s*from\s*{quoted}", text):
            head, module = m[1], m[2]
            if star := re.search(rf"\*\s*as\s+({_NAME})", head):
                add(module, None, star[1], m.start())
            if braces := re.search(r"\{([^}]*)\}", head):
                members(braces[1], module, m.start(), "as")
            if default := re.match(rf"\s*({_NAME})", head):
                add(module, "default", default[1], m.start())
        for m in re.finditer(rf"(?:const|let|var)\s+(?:({_NAME})|\{{([^}}]*)\}})\s*=\s*require\(\s*{quoted}\s*\)", text):
            if m[1]:
                add(m[3], None, m[1], m.start())
            else:
                members(m[2], m[3], m.start(), ":")

    # symbols and flows

    def _symbol(self, name: str, qualified: str, kind: str, start: int, end: int, params: list[str]) -> str:
        same = sum(s["qualified"] == qualified and s["kind"] == kind for s in self.facts.symbols)
        sid = identity([self.project, self.path, MODULE] if kind == "module" else [self.project, self.path, qualified, kind, same])
        self.facts.symbols.append({"id": sid, "name": name, "qualified": qualified, "kind": kind, "start_line": self.line(start), "end_line": self.line(end), "parameters": params})
        return sid

    def _name_of(self, brace: int) -> tuple[str, str, int] | None:
        """Name, kind and start of what the block at ``brace`` defines."""
        head = max(self.plain.rfind(x, 0, brace) for x in ";{}") + 1
        text = self.plain[head:brace]
        for kind, pattern in _NAMED:
            m = pattern.search(text)
            if m and m[1] not in _NOT_METHODS and (kind != "method" or brace in self.params):
                return m[1], kind, head + len(text) - len(text.lstrip())
        return None

    def _walk(self) -> None:
        module = self._symbol(MODULE, MODULE, "module", 0, len(self.source), [])
        self._routes()
        # end, owner, scope, names, whether a named function begins here
        self.stack: list[dict] = [{"end": len(self.plain) + 1, "owner": module, "scope": "", "vars": {}, "function": True, "class": False}]
        self.seen: set[tuple] = set()
        events = {m.start(): ("set", m) for m in _ASSIGN.finditer(self.plain)}
        events |= {m.start(): ("unpack", m) for m in _UNPACK.finditer(self.plain)}
        events |= {m.start(): ("each", m) for m in _EACH.finditer(self.plain)}
        events |= {m.start(): ("return", m) for m in _RETURN.finditer(self.plain)}
        events |= {a: ("open", None) for a in self.ends}
        for a in self.calls:
            events.setdefault(a, ("call", None))
        for at in sorted(events):
            while at >= self.stack[-1]["end"]:
                self.stack.pop()
            kind, m = events[at]
            if kind == "open":
                self._enter(at)
            elif kind == "call":
                self.value(at, self.calls[at])
            else:
                stop = self._stop(m.end())
                got = self.value(m.end(), stop)
                if kind == "return":
                    self.hop(got, "return", at)
                elif kind == "unpack":
                    for name in re.findall(rf"({_NAME})\s*(?:=[^,]*)?(?:,|\Z)", m[1]):
                        self.stack[-1]["vars"][name] = got
                elif kind == "each":
                    self.stack[-1]["vars"][m[1]] = got
                else:
                    self._set(m, got, at)
            if at in self.calls and kind not in ("call", "open"):
                self.value(at, self.calls[at])

    # routes of web frameworks: what a handler's first parameter holds is outside input

    def _routes(self) -> None:
        """Ranges of handlers of proven Express and Fastify objects, with the name of the request in each."""
        self.requests: list[tuple[int, int, str]] = []
        if self.language == "rust":
            return
        made = {"express": {"default", None}, "fastify": {"default", None, "fastify", "Fastify"}}
        factories = {i["local"] for i in self.facts.imports if i["imported"] in made.get(i["module"], ())}
        routers = {i["local"] for i in self.facts.imports if i["module"] == "express" and i["imported"] == "Router"}
        members = {i["local"] for i in self.facts.imports if i["module"] == "express" and i["imported"] in ("default", None)}
        self.bound = {m[1]: m.end() for m in _BOUND.finditer(self.plain)}
        whole = (0, len(self.plain))
        apps: list[tuple[str, int, int]] = []
        for name, at in self.bound.items():
            m = re.compile(rf"(?:new\s+)?({_NAME})\s*(\.\s*Router\s*)?\(").match(self.plain, at)
            if _INLINE_FACTORY.match(self.source, at) or m and (m[1] in members if m[2] else m[1] in factories | routers):
                apps.append((name, *whole))
        done: set[tuple] = set()
        while len(apps) > len(done):
            for app in [a for a in apps if a not in done]:
                done.add(app)
                name, lo, hi = app
                apps += [(other, *whole) for other, at in self.bound.items() if re.compile(rf"{re.escape(name)}\s*(?:;|\n|\Z)").match(self.plain, at) and (other, *whole) not in apps]
                for m in _ROUTE.finditer(self.plain, lo, hi):
                    if m[1] == name:
                        for a, b in self._arguments(m.end() - 1):
                            got = self._function_at(a, b)
                            if got and m[2] == "register":
                                plugin = (got[2], got[0], got[1])
                                apps += [plugin] if plugin not in apps else []
                            elif got:
                                self.requests.append(got)

    def is_request(self, name: str, at: int) -> bool:
        """Whether ``name`` is a handler's request there, and no block within the handler has a variable of that name."""
        ends = [b for a, b, n in self.requests if n == name and a <= at < b]
        return bool(ends) and not any(name in f["vars"] and f["end"] < min(ends) for f in self.stack)

    def _arguments(self, opened: int) -> list[tuple[int, int]]:
        """Ranges of the arguments of a call, given its opening bracket."""
        out, depth, start = [], 0, opened + 1
        for i in range(opened, len(self.plain)):
            c = self.plain[i]
            depth += (c in "([{") - (c in ")]}")
            if depth == 0 or depth == 1 and c == ",":
                out.append((start, i))
                start = i + 1
            if depth == 0:
                break
        return out

    def _function_at(self, lo: int, hi: int) -> tuple[int, int, str] | None:
        """Body and first parameter of the function that an expression is, or names, over any number of aliases; none if they go round."""
        seen: set[str] = set()
        while True:
            while lo < hi and self.plain[lo].isspace():
                lo += 1
            if m := _ARROW.match(self.plain, lo, hi):
                params, body = m[1] if m[1] is not None else m[2], m.end()
            elif m := _FUNCTION.match(self.plain, lo, hi):
                params, body = m[1], m.end()
            elif (m := re.compile(rf"({_NAME})\s*\Z").match(self.plain[lo:hi])) and m[1] not in seen:
                seen.add(m[1])
                if m[1] in self.bound:
                    lo = self.bound[m[1]]
                    hi = self._stop(lo)
                    continue
                named = re.search(rf"(?:async\s+)?function\s*\*?\s*{re.escape(m[1])}\s*\(", self.plain)
                if not named:
                    return None
                lo, hi = named.start(), len(self.plain)
                continue
            else:
                return None
            first = re.match(rf"\s*({_NAME})", params)
            return (body, self.ends.get(body, hi), first[1]) if first else None

    def _enter(self, at: int) -> None:
        top, named = self.stack[-1], self._name_of(at)
        frame = {"end": self.ends[at], "owner": top["owner"], "scope": top["scope"], "vars": {}, "function": False, "class": False}
        params = self.params.get(at, [])
        if named:
            name, kind, start = named
            if kind == "method" and not top["class"] and self.language != "rust":
                named = None
        if named:
            qualified = f"{top['scope']}.{name}" if top["scope"] else name
            kind = "method" if kind == "function" and top["class"] else kind
            plain = [p for p in params if p not in ("self", "mut")]
            sid = self._symbol(name, qualified, kind, start, self.ends[at], plain)
            frame |= {"scope": qualified, "class": kind == "class"}
            if kind != "class":
                frame |= {"owner": sid, "function": True, "vars": {p: frozenset([f"param:{i}"]) for i, p in enumerate(plain)}}
        elif params:
            frame["vars"] = {p: NONE for p in params}
        self.stack.append(frame)

    def _set(self, m: re.Match, got: frozenset[Origin], at: int) -> None:
        declared, name, plus = m[1], m[2], m[3]
        frame = self.stack[-1]
        if not declared:
            for f in reversed(self.stack):
                if name in f["vars"] or f["function"]:
                    frame = f
                    break
        old = frame["vars"].get(name, NONE)
        if not declared and frame is not self.stack[-1] and "." not in name or plus:
            got = got | old
        for k in [k for k in frame["vars"] if k.startswith(name + ".")]:
            del frame["vars"][k]
        frame["vars"][name] = got
        self._fields(frame, name, m.end())
        if name.rsplit(".", 1)[-1] in ("innerHTML", "outerHTML"):
            line = self.line(at)
            self.hop(got, f"sink:xss:{line}:{name}", at, category="xss", name=name, snippet=name)

    def _fields(self, frame: dict, name: str, at: int) -> None:
        """What each field holds, where ``name`` is set to an object that lists all of them."""
        while at < len(self.plain) and self.plain[at].isspace():
            at += 1
        if self.language == "rust" or self.plain[at : at + 1] != "{":
            return
        fields = {}
        for a, b in self._arguments(at):
            m = re.compile(rf"\s*({_NAME})\s*:(?!:)").match(self.plain, a, b)
            if m:
                fields[f"{name}.{m[1]}"] = self.value(m.end(), b)
            elif self.plain[a:b].strip():
                return  # spread, computed or short: the object as a whole tells
        frame["vars"] |= fields

    def _stop(self, at: int) -> int:
        depth = 0
        for i in range(at, len(self.plain)):
            c = self.plain[i]
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if depth < 0:
                    return i
            elif depth == 0 and (c == ";" or c == "\n" and self.plain[at:i].strip() and not self.plain[at:i].rstrip().endswith(("+", "=", ",", ".", "?", ":", "&", "|", ">")) and not self.plain[i:].lstrip().startswith((".", "?", ":", "+", "&", "|"))):
                return i
        return len(self.plain)

    def lookup(self, name: str) -> frozenset[Origin]:
        crossed = False
        for f in reversed(self.stack):
            part = name
            while True:
                if part in f["vars"]:
                    got = f["vars"][part]
                    return frozenset(o for o in got if o.startswith("source:")) if crossed else got
                if "." not in part:
                    break
                part = part.rsplit(".", 1)[0]
            crossed = crossed or f["function"]
        return NONE

    def source_of(self, name: str, at: int) -> frozenset[Origin]:
        line = self.line(at)
        self._annotate("source", "input", name, line)
        return frozenset([f"source:{line}:{name}"])

    def name_value(self, name: str, at: int) -> frozenset[Origin]:
        first, _, rest = name.partition(".")
        if rest and is_source(f"req.{rest}") and self.is_request(first, at):
            return self.source_of(f"req.{rest}", at)
        return self.source_of(name, at) if is_source(name) else self.lookup(name)

    def value(self, lo: int, hi: int) -> frozenset[Origin]:
        """Origins of an expression."""
        out, at, rest = NONE, lo, []
        while at < hi:
            if at in self.ends and (at in self.params or re.search(r"=>\s*\Z", self.plain[lo:at])):
                at = self.ends[at]  # a callback's body comes later
            elif at in self.calls and self.calls[at] <= hi:
                out |= self.call(at, self.calls[at])
                at = self.calls[at]
            else:
                rest.append((at, self.plain[at]))
                at += 1
        text = "".join(c for _, c in rest)
        for m in _CHAIN.finditer(text):
            if not re.match(r"\s*(?::(?!:)|=>)", text[m.end() :]) or re.search(r"\?[^,;]*\Z", text[: m.start()]):
                out |= self.name_value(re.sub(r"\s|\?", "", m.group()), rest[m.start()][0])
        return out

    def call(self, lo: int, hi: int) -> frozenset[Origin]:
        depth, opened = 0, hi - 1
        for i in range(hi - 1, lo - 1, -1):
            depth += (self.plain[i] in ")]}") - (self.plain[i] in "([{")
            if depth == 0:
                opened = i
                break
        callee = re.sub(r"\s|\?|!|^new ", "", self.plain[lo:opened])
        receiver = NONE
        inner = max((b for a, b in self.tree.nodes if a == lo and b < hi and b <= opened), default=None)
        if inner is not None:  # a member of an earlier call's result
            receiver = self.call(lo, inner)
            callee = re.sub(r"\s|\?|!", "", self.plain[inner:opened]).lstrip(".") or "<expression>"
        name = callee.replace("::", ".") if self.language == "rust" else callee
        line = self.line(lo)
        args, start, depth = [], opened + 1, 0
        for i in range(opened + 1, hi):
            c = self.plain[i]
            if depth == 0 and (c == "," or i == hi - 1):
                if self.plain[start:i].strip() or c == ",":
                    args.append(self.value(start, i))
                start = i + 1
            depth += (c in "([{") - (c in ")]}")
        if is_source_call(name) or is_source("req." + name.partition(".")[2]) and self.is_request(name.partition(".")[0], lo):
            return self.source_of(name, lo)
        if inner is None and "." in name:
            receiver = self.name_value(name.rsplit(".", 1)[0], lo)
        key = (lo, hi)
        shell = bool(re.search(r"\bshell\s*:\s*true\b", self.plain[opened:hi]))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = str(len(self.facts.calls))
            frame = self.stack[-1]
            self.facts.calls.append({"call": number, "owner": frame["owner"], "scope": frame["scope"], "name": name.replace("this.", "self."), "line": line, "snippet": clip(self.source[lo:hi]), "sanitizer": sanitizer_type(name), "sink": sink_type(name, shell)})
        for kind, category in (("security_guard", guard_type(name)), ("sanitizer", sanitizer_type(name)), ("security_sink", sink_type(name, shell))):
            if category:
                self._annotate(kind, category, name, line)
        category = sink_type(name, shell)
        if category and args:
            self.hop(args[0], f"sink:{category}:{line}:{name}", lo, category=category, name=name, snippet=clip(self.source[lo:hi]))
        for i, origins in enumerate(args):
            self.hop(origins, f"arg:{number}:{i}", lo)
        self.hop(receiver, f"arg:{number}:self", lo)
        return frozenset([f"result:{number}"])

    def hop(self, origins: frozenset[Origin], target: str, at: int, **more) -> None:
        owner = self.stack[-1]["owner"]
        for o in sorted(origins):
            if (owner, o, target) not in self.seen:
                self.seen.add((owner, o, target))
                self.facts.hops.append({"owner": owner, "origin": o, "target": target, "line": self.line(at), "category": more.get("category"), "name": more.get("name"), "snippet": more.get("snippet")})

    def _annotate(self, kind: str, category: str, name: str, line: int) -> None:
        owner = self.stack[-1]["owner"]
        aid = identity([owner, line, kind, name])
        if all(a["id"] != aid for a in self.facts.annotations):
            self.facts.annotations.append({"id": aid, "owner": owner, "kind": kind, "category": category, "name": name, "line": line})


def extract_script(project: str, path: str, source: str, language: str) -> Facts:
    """All facts of one file; what does not scan is a note."""
    return _Frontend(project, path, source, language).run()
