"""Programming languages.  Python is read exactly; the others by declarations in masked text, which is approximate."""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass

from codeloom.sources.parsers.base import Key, Sink, arguments, block_end, masked

_VERBS = ("get", "post", "put", "delete", "patch", "head", "options")


# ---------------------------------------------------------------- Python
def python(sink: Sink) -> None:
    try:
        tree = ast.parse(sink.text)
    except (SyntaxError, ValueError, RecursionError):
        return
    functions: dict[str, Key] = {}

    def visibility(name: str) -> str:
        return "private" if name.startswith("__") and not name.endswith("__") else "protected" if name.startswith("_") and not name.startswith("__") else "public"

    def route(fn, key: Key) -> None:
        for d in fn.decorator_list:
            if isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and isinstance(d.args[0], ast.Constant) and isinstance(d.args[0].value, str):
                verbs = [d.func.attr.upper()] if d.func.attr in _VERBS else []
                if d.func.attr == "route":
                    named = next((k.value for k in d.keywords if k.arg == "methods"), None)
                    verbs = [e.value for e in named.elts if isinstance(e, ast.Constant)] if isinstance(named, (ast.List, ast.Tuple)) else ["GET"]
                for verb in verbs:
                    end = sink.node(("ApiEndpoint", f"{verb} {d.args[0].value}"), name=d.args[0].value, http_method=verb, http_path=d.args[0].value, file_ref=sink.path, start_line=fn.lineno)
                    sink.edge(sink.file, "EXPOSES", end)
                    sink.edge(end, "HANDLES", key)

    def visit(body, owner: Key, prefix: str, in_class: bool) -> None:
        for n in body:
            if isinstance(n, ast.ClassDef):
                bases = [ast.unparse(b) for b in n.bases]
                kind = "enum" if any(b.endswith("Enum") for b in bases) else "protocol" if any(b.endswith("Protocol") for b in bases) else "class"
                key = sink.child(owner, "Class", f"{prefix}{n.name}", name=n.name, kind=kind, start_line=n.lineno, end_line=n.end_lineno, visibility=visibility(n.name), decorators=",".join(map(ast.unparse, n.decorator_list)) or None, is_dataclass=any("dataclass" in ast.unparse(d) for d in n.decorator_list))
                for b in bases:
                    sink.edge(key, "EXTENDS", ("Class", b))
                visit(n.body, key, f"{prefix}{n.name}.", True)
            elif isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                marks = [ast.unparse(d) for d in n.decorator_list]
                a = n.args
                count = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
                key = sink.child(owner, "Method", f"{prefix}{n.name}", name=n.name, start_line=n.lineno, end_line=n.end_lineno, param_count=count, visibility=visibility(n.name), is_async=isinstance(n, ast.AsyncFunctionDef), is_test=n.name.startswith("test_"), is_constructor=n.name == "__init__", is_static="staticmethod" in marks, is_classmethod="classmethod" in marks, is_property="property" in marks, is_fixture=any("fixture" in m for m in marks), decorators=",".join(marks) or None)
                functions.setdefault(n.name, key)
                route(n, key)
                visit(n.body, key, f"{prefix}{n.name}.", False)
            elif isinstance(n, ast.Import):
                for a in n.names:
                    sink.edge(sink.file, "IMPORTS", sink.node(("Module", a.name), name=a.name))
            elif isinstance(n, ast.ImportFrom):
                name = "." * n.level + (n.module or "")
                sink.edge(sink.file, "IMPORTS", sink.node(("Module", name), name=name))
            elif in_class and isinstance(n, ast.AnnAssign) and isinstance(n.target, ast.Name):
                sink.child(owner, "Field", f"{prefix}{n.target.id}", name=n.target.id, type=ast.unparse(n.annotation), start_line=n.lineno)
            elif isinstance(n, (ast.If, ast.Try, ast.With)):
                visit(n.body, owner, prefix, in_class)

    visit(tree.body, sink.file, f"{sink.path}::", False)

    class Calls(ast.NodeVisitor):
        stack: list[str] = []

        def visit_FunctionDef(self, n):
            self.stack.append(n.name)
            self.generic_visit(n)
            self.stack.pop()

        visit_AsyncFunctionDef = visit_FunctionDef

        def visit_Call(self, n):
            name = n.func.attr if isinstance(n.func, ast.Attribute) else n.func.id if isinstance(n.func, ast.Name) else None
            if self.stack and name in functions and functions.get(self.stack[-1]) and name != self.stack[-1]:
                sink.edge(functions[self.stack[-1]], "CALLS", functions[name], confidence=0.7, call_site_line=n.lineno)
            self.generic_visit(n)

    Calls().visit(tree)


# ---------------------------------------------------------------- brace languages
@dataclass
class Dialect:
    """Patterns over masked text: named groups kind, name, bases, impls; name, recv; module."""

    types: str
    functions: str
    imports: str = r"(?!)"
    style: str = "c"
    labels: dict[str, str] | None = None
    package: str = r"(?!)"
    separator: str = "::"
    ticks: bool = False
    placeholders: bool = False


_JAVA_MODS = r"(?:(?:public|protected|private|static|final|abstract|synchronized|native|default|strictfp|sealed|non-sealed)\s+)*"
DIALECTS = {
    "java": Dialect(
        r"(?P<mods>(?:\b(?:public|protected|private|static|final|abstract|sealed)\s+)*)(?P<kind>@interface|\bclass|\binterface|\benum|\brecord)\s+(?P<name>\w+)[^{;]*?(?:\bextends\s+(?P<bases>[\w.<>, ]+?))?\s*(?:\bimplements\s+(?P<impls>[\w.<>, ]+?))?\s*\{",
        rf"(?P<mods>{_JAVA_MODS})(?:<[^<>]+>\s*)?(?P<type>[\w.]+(?:<[^;{{}}()]*>)?(?:\[\])*)\s+(?P<name>\w+)\s*(?P<open>\()|(?P<mods2>(?:(?:public|protected|private)\s+)?)(?P<ctor>\b[A-Z]\w*)\s*(?P<open2>\()",
        r"\bimport\s+(?:static\s+)?(?P<module>[\w.*]+)\s*;", package=r"\bpackage\s+([\w.]+)\s*;", separator=".", placeholders=True,
    ),
    "javascript": Dialect(r"\b(?P<kind>class)\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>[\w.]+))?\s*\{", r"\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*(?P<open>\()|\b(?:const|let|var)\s+(?P<name2>[\w$]+)\s*=\s*(?:async\s*)?(?P<open2>\()(?=[^()]*\)\s*=>)|(?<=[{};\n])\s*(?:static\s+|async\s+|get\s+|set\s+)*(?P<name3>[\w$]+)\s*(?P<open3>\()(?=[^()]*\)\s*\{)", r"(?:\bfrom|\brequire\s*\(|\bimport)\s*(?P<module>['\"])", ticks=True, placeholders=True),
    "go": Dialect(r"\btype\s+(?P<name>\w+)\s+(?P<kind>struct|interface)\s*\{", r"\bfunc\s+(?:\(\s*\w*\s*\*?(?P<recv>\w+)[^)]*\)\s*)?(?P<name>\w+)\s*(?P<open>\()", r"\bimport\s+(?:\w+\s+)?(?P<module>\")|(?<=[\n(])\s*(?:[\w.]+\s+)?(?P<module2>\")(?=[^\"\n]*\"\s*\n)", labels={"struct": "Struct", "interface": "Interface"}, package=r"\bpackage\s+(\w+)", separator=".", ticks=True),
    "rust": Dialect(r"\b(?P<kind>struct|enum|trait)\s+(?P<name>\w+)[^{;]*\{", r"\bfn\s+(?P<name>\w+)(?:<[^>]*>)?\s*(?P<open>\()", r"\buse\s+(?P<module>[\w:]+)", labels={"struct": "Struct", "enum": "Enum", "trait": "Trait"}),
    "c": Dialect(r"\b(?P<kind>struct|union|enum)\s+(?P<name>\w+)\s*\{", r"(?<=[\n;}])[ \t]*(?:[\w*]+[\s*]+)+(?P<name>\w+)\s*(?P<open>\()(?=[^;{}]*\)\s*\{)", labels={"struct": "Struct", "union": "Union", "enum": "Enum"}),
    "cpp": Dialect(r"\b(?P<kind>class|struct)\s+(?P<name>\w+)(?:\s*:\s*(?P<bases>[\w:<>, ]+?))?\s*\{", r"(?<=[\n;{}])[ \t]*(?:[\w:<>*&~]+[\s*&]+)*(?P<name>~?\w+)\s*(?P<open>\()(?=[^;{}]*\)[^;{}]*\{)", labels={"class": "Class", "struct": "Struct"}),
    "csharp": Dialect(r"\b(?P<kind>class|struct|interface|enum|record)\s+(?P<name>\w+)[^{;:]*(?::\s*(?P<bases>[\w.<>, ]+?))?\s*\{", r"(?:public|private|protected|internal|static|async|override|virtual|\s)+[\w<>\[\],.?]+\s+(?P<name>\w+)\s*(?P<open>\()(?=[^;{}]*\)\s*(?:\{|=>))", r"\busing\s+(?P<module>[\w.]+)\s*;", labels={"class": "Class", "struct": "Struct", "interface": "Interface", "enum": "Enum", "record": "Record"}, package=r"\bnamespace\s+([\w.]+)", separator="."),
    "kotlin": Dialect(r"\b(?P<kind>class|interface|object)\s+(?P<name>\w+)[^{\n]*\{", r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<name>\w+)\s*(?P<open>\()", r"\bimport\s+(?P<module>[\w.*]+)", labels={"class": "Class", "interface": "Interface", "object": "Class"}, package=r"\bpackage\s+([\w.]+)", separator="."),
    "php": Dialect(r"\b(?P<kind>class|interface|trait)\s+(?P<name>\w+)(?:\s+extends\s+(?P<bases>\w+))?(?:\s+implements\s+(?P<impls>[\w, ]+?))?\s*\{", r"\bfunction\s+(?P<name>\w+)\s*(?P<open>\()", r"\buse\s+(?P<module>[\w\\]+)\s*;", style="php", labels={"class": "Class", "interface": "Interface", "trait": "Trait"}),
    "solidity": Dialect(r"\b(?P<kind>contract|interface|library)\s+(?P<name>\w+)(?:\s+is\s+(?P<bases>[\w, ]+?))?\s*\{", r"\bfunction\s+(?P<name>\w+)\s*(?P<open>\()", r"\bimport\s+(?P<module>['\"])", labels={"contract": "Contract", "interface": "Interface", "library": "Contract"}),
}
DIALECTS["typescript"] = Dialect(
    r"\b(?P<kind>class|interface)\s+(?P<name>\w+)[^{;=]*?(?:\bextends\s+(?P<bases>[\w.<>, ]+?))?\s*(?:\bimplements\s+(?P<impls>[\w.<>, ]+?))?\s*\{", DIALECTS["javascript"].functions.replace(r"(?=[^()]*\)\s*\{)", r"(?=[^()]*\)\s*(?::[^{;=]+)?\{)"), DIALECTS["javascript"].imports, labels={"class": "Class", "interface": "Interface"}, ticks=True, placeholders=True,
)
_NOT_NAMES = set("if for while switch catch return new else do try throw function super this sizeof await typeof in of case with synchronized assert yield match use def fn func not and or instanceof delete void".split())
_CALL = re.compile(r"(?<![\w$.@])(?:(?P<scope>this|self)\s*\.\s*)?(?P<name>[A-Za-z_$][\w$]*)\s*\(|(?P<dot>\.)\s*(?P<member>[A-Za-z_$][\w$]*)\s*\(")


def braces(sink: Sink, language: str) -> None:
    """Types, functions, imports and calls of a language with braces."""
    d = DIALECTS[language]
    text = masked(sink.text, d.style, ticks=d.ticks)
    plain = masked(sink.text, d.style, strings=False, ticks=d.ticks)
    m = re.search(d.package, text)
    package = m[1] if m else ""
    base = f"{package}." if d.separator == "." and package else "" if d.separator == "." else f"{sink.path}::"
    if language == "go" and package:
        sink.node(("GoPackage", package), name=package)
    for m in re.finditer(d.imports, text):
        g = m.groupdict()
        which = "module" if g.get("module") else "module2"
        quoted = re.match(r"(['\"])([^'\"\n]+)\1", sink.text[m.start(which) :]) if g[which] in "'\"" else None
        name = quoted[2] if quoted else g[which]
        if name not in ("'", '"'):
            sink.edge(sink.file, "IMPORTS", sink.node(("Module", name), name=name))
    spans: list[tuple[int, int, Key, str]] = []

    def owner(at: int) -> tuple[Key, str]:
        inside = [s for s in spans if s[0] <= at < s[1]]
        return (inside[-1][2], inside[-1][3]) if inside else (sink.file, base)

    for m in re.finditer(d.types, text):
        top, prefix = owner(m.start("name"))
        kind = m["kind"].lstrip("@")
        label = (d.labels or {}).get(m["kind"], "Class")
        end = block_end(text, m.end() - 1)
        key = sink.child(top, label, prefix + m["name"], m.start("name"), name=m["name"], kind="annotation" if m["kind"] == "@interface" else kind, end_line=sink.line(end - 1), package=package or None)
        g = m.groupdict()
        for part in filter(None, re.split(r"\s*,\s*(?![^<]*>)", (g.get("bases") or "").strip())):
            part = re.sub(r"<.*", "", part).split()[-1]
            implements = language == "csharp" and re.match(r"I[A-Z]", part)
            sink.edge(key, "IMPLEMENTS" if implements else "EXTENDS", ("Class", part))
        for part in filter(None, re.split(r"\s*,\s*(?![^<]*>)", (g.get("impls") or "").strip())):
            sink.edge(key, "IMPLEMENTS", ("Class", re.sub(r"<.*", "", part)))
        spans.append((m.end(), end, key, f"{prefix}{m['name']}."))
    types = {k[2][1]: k for k in spans}
    methods: list[tuple[int, int, Key, str, int, Key]] = []
    for m in re.finditer(d.functions, text):
        g = m.groupdict()
        at = next(m.start(k) for k in ("open", "open2", "open3") if g.get(k))
        name = next((g[k] for k in ("name", "name2", "name3", "ctor") if g.get(k)), "")
        if name in _NOT_NAMES or (g.get("type") in _NOT_NAMES and g["type"] != "void"):
            continue
        top, prefix = owner(at)
        if g.get("type") in ("public", "protected", "private"):  # a constructor: no type stands before its name
            g |= {"ctor": name, "mods": g["type"], "type": None}
        params, after = arguments(text, at)
        tail = re.match(r"(?:\s*(?:->|=>|:)?\s*[\w.<>\[\]|&?,*: ()]*?|\s*throws [\w., ]+)\s*(\{|;|=>|=)", text[after:])
        if g.get("ctor") and (top[1].rsplit(".", 1)[-1] != name or not tail or tail[1] != "{"):
            continue
        if language == "java" and (top == sink.file or any(a < at < b for a, b, *_ in methods) or not tail):
            continue
        if g.get("recv") and f"{base}{g['recv']}" in types:
            top, prefix = types[f"{base}{g['recv']}"][2], f"{base}{g['recv']}."
        elif g.get("recv"):
            prefix = f"{base}{g['recv']}."
        ctor = bool(g.get("ctor")) or name in ("constructor", "__construct")
        shown = "<init>" if g.get("ctor") else name
        sig = f"({','.join(_type_of(p) for p in params)})" if language == "java" else ""
        end = block_end(text, after + tail.end(1) - 1) if tail and tail[1] == "{" else after
        mods = (g.get("mods") or g.get("mods2") or "").split()
        before = _marks(plain, text, m.start())
        key = sink.child(
            top, "Method", f"{prefix}{shown}{sig}", m.start("open" if g.get("open") else "open2" if g.get("open2") else "open3"), name=shown, signature=f"{shown}{sig}" if sig else None, param_count=len(params), end_line=sink.line(max(at, end - 1)), return_type=g.get("type"),
            visibility=next((v for v in ("public", "protected", "private") if v in mods), "package" if language == "java" else None), is_static="static" in mods or None, is_abstract="abstract" in mods or None, is_constructor=ctor,
            is_test=bool(re.search(r"@(?:Test|ParameterizedTest)\b", before)) or (language == "go" and bool(re.match(r"(?:Test|Benchmark|Example)(?![a-z])", name))), is_entry=True if language == "go" and name == "main" else None, is_queue_listener=bool(re.search(r"@(?:Kafka|Rabbit|Jms|Sqs)Listener\b", before)) or None, is_scheduled="@Scheduled" in before or None,
        )
        methods.append((after, end, key, shown, len(params), top))
        if language == "java":
            _spring(sink, before, key, top, spans, plain, text)
    for start, end, key, name, _, top in methods:
        for m in _CALL.finditer(text, start, end):
            callee = m["name"] or m["member"]
            if callee in _NOT_NAMES or any(a > start and a <= m.start() < b for a, b, *_ in methods):
                continue
            args, _ = arguments(text, m.end() - 1)
            line = sink.line(m.start())
            fits = [x for x in methods if x[3] == callee and (x[4] == len(args) or not d.placeholders) and (x[5] == top or not m["dot"])]
            if fits and fits[0][2] != key and not (m["dot"] and d.placeholders):
                sink.edge(key, "CALLS", fits[0][2], confidence=0.8 if language == "java" else 0.7, call_site_line=line)
            elif d.placeholders and not fits:
                created = re.search(r"\bnew\s+$", text[max(0, m.start() - 12) : m.start()])
                fq = f"unresolved.<init>.{callee}:{len(args)}" if created else f"unresolved.{callee}:{len(args)}"
                sink.edge(key, "CALLS", sink.node(("Method", fq), name="<init>" if created else callee), confidence=0.5, call_site_line=line)
            elif d.placeholders and m["dot"]:
                sink.edge(key, "CALLS", sink.node(("Method", f"unresolved.{callee}:{len(args)}"), name=callee), confidence=0.5, call_site_line=line)
    if language in ("javascript", "typescript"):
        _express(sink)


def _marks(source: str, blanked: str, at: int) -> str:
    """What stands before a declaration, back to the end of the one before it: its annotations, braces in these included."""
    depth = 0
    for i in range(at - 1, -1, -1):
        c = blanked[i]
        if c == ")":
            depth += 1
        elif c == "(":
            depth -= depth > 0
        elif c in "{};" and not depth:
            return source[i + 1 : at]
    return source[:at]


def _type_of(param: str) -> str:
    words = re.sub(r"@\w+(?:\([^)]*\))?|\bfinal\b", "", param).split()
    return " ".join(words[:-1]) if len(words) > 1 else param


_MAPPING = re.compile(r"@(Get|Post|Put|Delete|Patch|Request)Mapping\s*(?:\(([^)]*)\))?")


def _path(args: str | None) -> str:
    m = re.search(r"\"([^\"]*)\"", args or "")
    return m[1] if m else ""


def _spring(sink: Sink, before: str, key: Key, top: Key, spans, plain: str, blanked: str) -> None:
    """Endpoints by mapping annotations: the class's path, then the method's."""
    m = _MAPPING.search(before)
    if not m:
        return
    start = next((s[0] for s in spans if s[2] == top), 0)
    head = _marks(plain, blanked, blanked.rfind("class", 0, start))
    of_class = re.search(r"@RequestMapping\s*\(([^)]*)\)", head)
    verb = m[1].upper() if m[1] != "Request" else (re.search(r"RequestMethod\.(\w+)", m[2] or "") or [None, "GET"])[1]
    path = "/" + "/".join(p.strip("/") for p in (_path(of_class[1]) if of_class else "", _path(m[2])) if p.strip("/"))
    end = sink.node(("ApiEndpoint", f"{verb} {path}"), name=path, http_method=verb, http_path=path, framework="spring", file_ref=sink.path)
    sink.edge(top, "EXPOSES", end)
    sink.edge(end, "HANDLES", key)


_ROUTE = re.compile(r"\b(app|router|server|api)\s*\.\s*(get|post|put|delete|patch)\s*\(\s*(['\"`])(/[^'\"`]*)\3")
_FETCH = re.compile(r"\b(?:fetch|axios\s*\.\s*(get|post|put|delete|patch)|http\s*\.\s*(get|post|put|delete|patch))\s*\(\s*(['\"`])([^'\"`]+)\3")


def _express(sink: Sink) -> None:
    text = masked(sink.text, "c", strings=False, ticks=True)
    for m in _ROUTE.finditer(text):
        verb = m[2].upper()
        sink.edge(sink.file, "EXPOSES", sink.node(("ApiEndpoint", f"{verb} {m[4]}"), name=m[4], http_method=verb, http_path=m[4], framework="express", file_ref=sink.path, start_line=sink.line(m.start())))
    for m in _FETCH.finditer(text):
        verb = (m[1] or m[2] or "get").upper()
        sink.edge(sink.file, "CALLS_HTTP", sink.node(("HttpCall", f"{verb} {m[4]}"), name=m[4], http_method=verb, http_path=m[4], file_ref=sink.path, start_line=sink.line(m.start())))
    for m in re.finditer(r"(['\"`])\s*((?:SELECT|INSERT|UPDATE|DELETE|REPLACE|TRUNCATE|MERGE)\b[^'\"`]*)\1", text, re.I):
        from codeloom.sources.parsers.data import table_uses

        table_uses(sink, m[2])
