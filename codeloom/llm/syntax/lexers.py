"""Token streams for the grammars: names and offsets; where no token fits, the last name is ``ERROR``."""

from __future__ import annotations

import re
from collections.abc import Callable

Stream = tuple[list[str], list[int]]


ERROR = "$error"  # a name no grammar has: the parser reports its place
_ID = r"[^\W\d]\w*"
_C_COMMENT = r"//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/"


def _words(text: str) -> frozenset[str]:
    return frozenset(text.split())


def _master(**parts: str) -> re.Pattern[str]:
    return re.compile("|".join(f"(?P<{k}>{v})" for k, v in parts.items()), re.S)


def _run(pattern: re.Pattern[str], text: str, name: Callable[[str, str], str | None]) -> Stream:
    """The plain loop: ``name(kind, text)`` gives the token's name, None leaves it out."""
    kinds, at, pos, match = [], [], 0, pattern.match
    n = len(text)
    while pos < n:
        m = match(text, pos)
        if m is None:
            kinds.append(ERROR)
            at.append(pos)
            break
        k = name(m.lastgroup, m.group())
        if k is not None:
            kinds.append(k)
            at.append(pos)
        pos = m.end()
    return kinds, at


# ---------------------------------------------------------------- JSON
_JSON = _master(blank=r"[ \t\r\n]+", str=r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"', num=r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])", word=r"(?:true|false|null)(?!\w)", op=r"[{}\[\],:]")
_JSON_NAMES = {"str": "STRING", "num": "NUMBER"}


def json(text: str) -> Stream:
    return _run(_JSON, text.removeprefix("\ufeff"), lambda k, t: None if k == "blank" else _JSON_NAMES.get(k) or t)


# ---------------------------------------------------------------- Python
_PY_KEYWORDS = _words("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield")
_PY_STRING = r"(?:[rR][bB]?|[bB][rR]?|[fFuU]|[rR][fF]|[fF][rR])?(?:\"\"\"(?:[^\\]|\\.)*?\"\"\"|'''(?:[^\\]|\\.)*?'''|\"(?:[^\"\\\n]|\\(?:\r\n|.))*\"|'(?:[^'\\\n]|\\(?:\r\n|.))*')"
_PY_NUMBER = r"(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w)"
_PYTHON = _master(str=_PY_STRING, num=_PY_NUMBER, id=_ID, blank=r"[ \t\f]+|\\\r?\n", comment=r"#[^\r\n]*", nl=r"\r\n|\n|\r", aug=r"(?:\*\*|//|>>|<<|[-+*/%@&|^])=", op=r"\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|[-+*/%@&|^~<>()\[\]{},:.;=]")
_PY_OPS = {"+": "SIGN", "-": "SIGN", "%": "BINOP", "//": "BINOP", "<<": "BINOP", ">>": "BINOP", "&": "BINOP", "^": "BINOP", "<": "COMPARE", ">": "COMPARE", "<=": "COMPARE", ">=": "COMPARE", "==": "COMPARE", "!=": "COMPARE"}
_LEADING_ZERO = re.compile(r"0[\d_]*[1-9][\d_]*$")


def python(text: str) -> Stream:
    """Python's lexical rules, with NEWLINE, INDENT and DEDENT; tabs and blanks must agree."""
    text = text.removeprefix("\ufeff")
    kinds, at, pos, n = [], [], 0, len(text)
    indents, depth, fresh, match = [(0, 0)], [], True, _PYTHON.match

    def put(kind: str, where: int) -> None:
        kinds.append(kind)
        at.append(where)

    while pos < n:
        if fresh and not depth:
            col = alt = 0
            start = pos
            while pos < n and text[pos] in " \t\f":
                if text[pos] == "\t":
                    col, alt = col // 8 * 8 + 8, alt + 1
                elif text[pos] == "\f":
                    col = alt = 0
                else:
                    col, alt = col + 1, alt + 1
                pos += 1
            if pos >= n:
                break
            if text[pos] in "#\r\n":
                m = match(text, pos)
                pos = m.end()
                if m.lastgroup == "comment" and pos < n:
                    pos = match(text, pos).end()
                continue
            fresh = False
            if (col == indents[-1][0]) != (alt == indents[-1][1]) or (col > indents[-1][0]) != (alt > indents[-1][1]):
                put(ERROR, start)
                return kinds, at
            if col > indents[-1][0]:
                indents.append((col, alt))
                put("INDENT", pos)
            else:
                while col < indents[-1][0]:
                    indents.pop()
                    put("DEDENT", pos)
                if (col, alt) != indents[-1]:
                    put(ERROR, pos)
                    return kinds, at
        m = match(text, pos)
        if m is None:
            put(ERROR, pos)
            return kinds, at
        kind, t = m.lastgroup, m.group()
        if kind == "id":
            put(t if t in _PY_KEYWORDS else _py_soft(kinds, text, m, t, depth), pos)
        elif kind == "op":
            if t in "([{":
                depth.append(t)
            elif t in ")]}":
                if not depth or depth.pop() + t not in ("()", "[]", "{}"):
                    put(ERROR, pos)
                    return kinds, at
            put(_PY_OPS.get(t, t), pos)
        elif kind == "str":
            put("STRING", pos)
        elif kind == "num":
            put(ERROR if _LEADING_ZERO.match(t) else "NUMBER", pos)
        elif kind == "nl":
            if not depth:
                put("NEWLINE", pos)
                fresh = True
        elif kind == "aug":
            put("AUGASSIGN", pos)
        pos = m.end()
    if kinds and kinds[-1] != "NEWLINE" and not fresh:
        put("NEWLINE", n)
    for _ in indents[1:]:
        put("DEDENT", n)
    if depth:
        put(ERROR, n)
    return kinds, at


_PY_MATCH = re.compile(r"(match|case)\b(?=[ \t]*[^\s=.,:;)\]}]|[ \t]*[-(\[{\"'*])[^\n]*:[ \t]*(?:#[^\n]*)?(?:\r?\n|$)|case\b[^\n]*:")
_PY_TYPE = re.compile(r"type[ \t]+[^\W\d]\w*[ \t]*(?:\[[^\n]*\])?[ \t]*=")


def _py_soft(kinds: list[str], text: str, m: re.Match[str], word: str, depth: list[str]) -> str:
    """match, case and type are keywords only at the head of a statement of their kind."""
    if word in ("match", "case", "type") and not depth and (not kinds or kinds[-1] in ("NEWLINE", "INDENT", "DEDENT", ":", ";")):
        if (_PY_TYPE if word == "type" else _PY_MATCH).match(text, m.start()):
            return word
    return "NAME"


# ---------------------------------------------------------------- C
_C_KEYWORDS = {w: "BUILTIN" for w in "void char short int long float double signed unsigned _Bool _Complex __int128 bool".split()} | {w: "STORAGE" for w in "typedef extern static auto register inline _Noreturn _Thread_local __inline __inline__ __extension__".split()} | {w: "QUAL" for w in "const volatile restrict __restrict __restrict__ __const __volatile__".split()}
_C_KEYWORDS |= {w: w for w in "break case continue default do else enum for goto if return sizeof switch while typeof _Atomic _Alignas _Alignof _Generic _Static_assert __attribute__ asm".split()} | {"struct": "STRUCT", "union": "STRUCT", "__asm__": "asm", "__typeof__": "typeof", "static_assert": "_Static_assert"}
_C_OPS = dict.fromkeys("/ % << >> ^ | && ||".split(), "BINOP") | dict.fromkeys("< > <= >= == !=".split(), "COMPARE") | dict.fromkeys("+ -".split(), "SIGN") | dict.fromkeys("+= -= *= /= %= &= |= ^= <<= >>=".split(), "ASSIGN") | {"++": "INCDEC", "--": "INCDEC"}
_C = _master(blank=r"[ \t\r\n\f\v]+|\\\r?\n|" + _C_COMMENT, str=r'(?:u8|[uUL])?"(?:[^"\\\n]|\\(?:\r\n|.))*"', chr=r"[uUL]?'(?:[^'\\\n]|\\.)+'", num=r"(?:0[xX][0-9a-fA-F]*(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?|0[bB][01]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[uUlLfF]{0,3}(?!\w)", id=r"[A-Za-z_$]\w*", op=r"\.\.\.|<<=|>>=|->|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|[-+*/%&|^~!<>=?:;,.(){}\[\]]")
_C_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(\w*)((?:[^\\\n]|\\\r?\n|\\)*)(?:\n|\Z)")
_C_DIRECTIVES = _words("define include include_next ifdef ifndef if elif else endif undef pragma error warning line ident import")


_C_HEADER = re.compile(r"\s*(?:<[^<>\n]+>|\"[^\"\n]+\"|[A-Za-z_]\w*)")
#: Conditions that no C compiler takes.
_C_NEVER = re.compile(r"\s*(?:0+[uUlL]*|\(\s*0+\s*\)|defined\s*\(?\s*__cplusplus\s*\)?)\s*(?://.*|/\*.*)?$", re.S)
_C_LINE = re.compile(r"[^\n]*(?:\n|\Z)")
_C_MARKS = re.compile(r'"(?:[^"\\\n]|\\.)*"|//[^\n]*|/\*|\*/')


class _Condition:
    """A group of branches; the numbers of those that some compiler may take."""

    def __init__(self) -> None:
        self.branch, self.live, self.closed = -1, [], False

    def opened(self, never: bool) -> None:
        self.branch += 1
        if not never:
            self.live.append(self.branch)


def _c_lines(text: str) -> tuple[list[tuple[str, tuple]], int, str]:
    """The lines, directives blanked, each with the (condition, branch) it lies in; offset of a bad directive or -1; its name."""
    out, pos, path, bad = [], 0, [], -1
    in_comment = False
    while pos < len(text):
        d = None if in_comment else _C_DIRECTIVE.match(text, pos)
        if d:
            word, rest = d.group(1), d.group(2)
            dead = any(b not in g.live for g, b in path)
            if word in ("if", "ifdef", "ifndef"):
                group = _Condition()
                group.opened(word == "if" and bool(_C_NEVER.match(rest)) or word == "ifdef" and rest.strip() == "__cplusplus")
                path.append((group, 0))
            elif word in ("elif", "else"):
                if not path or path[-1][0].closed:
                    return out, d.start(1), word
                group = path.pop()[0]
                group.closed = word == "else"
                group.opened(word == "elif" and bool(_C_NEVER.match(rest)))
                path.append((group, group.branch))
            elif word == "endif":
                if not path:
                    return out, d.start(1), word
                path.pop()
            elif not dead and bad < 0 and (word not in _C_DIRECTIVES and not word.isdigit() and (word or rest.strip()) or word == "define" and not rest.strip() or word in ("include", "include_next", "import") and not _C_HEADER.match(rest)):
                bad = d.start(1)
            body = d.group()
            kept = re.sub(r"[^\n]", " ", body)
            if "/*" in body and "*/" not in body[body.rindex("/*") :]:
                in_comment = True
                kept = kept[: body.rindex("/*")] + body[body.rindex("/*") :]
            out.append((kept, tuple(path)))
            pos = d.end()
            continue
        line = _C_LINE.match(text, pos).group()
        out.append((line, tuple(path)))
        for mark in _C_MARKS.findall(line) if not in_comment else re.findall(r"/\*|\*/", line):
            in_comment = mark == "/*" if mark in ("/*", "*/") else in_comment
        pos += len(line)
    return out, len(text) if path and bad < 0 else bad, "endif"


def _c_variants(text: str) -> tuple[list[str], int]:
    """The texts compilers may see, directives blanked out: of every condition the first branch, then the second and
    so on (the last where there are fewer), so that each branch is in one of them; offset of a bad directive or -1.
    """
    if "#" not in text:
        return [text], -1
    lines, bad, _ = _c_lines(text)
    groups = {id(g): g for _, path in lines for g, _ in path}
    blank = {}
    out = []
    for k in range(max([1, *(len(g.live) for g in groups.values())])):
        chosen = {i: g.live[min(k, len(g.live) - 1)] if g.live else -1 for i, g in groups.items()}
        shown = []
        for i, (line, path) in enumerate(lines):
            if all(chosen[id(g)] == b for g, b in path):
                shown.append(line)
            else:
                if i not in blank:
                    blank[i] = re.sub(r"[^\n]", " ", line)
                shown.append(blank[i])
        out.append("".join(shown))
    return out, bad


_C_NAMES = {"str": "STRING", "chr": "CHAR", "num": "NUMBER"}


def c(text: str) -> list[Stream]:
    """A stream for each way to choose among the branches of conditions."""
    variants, bad = _c_variants(text.removeprefix("\ufeff"))
    if bad >= 0:
        return [([ERROR], [bad])]
    return [_run(_C, t, lambda k, t: None if k == "blank" else _C_KEYWORDS.get(t, "NAME") if k == "id" else _C_NAMES[k] if k in _C_NAMES else _C_OPS.get(t, t)) for t in variants]


# ---------------------------------------------------------------- Go
_GO_KEYWORDS = _words("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var")
_GO_OPS = dict.fromkeys("/ % << >> &^ || &&".split(), "BINOP") | dict.fromkeys("< > <= >= == !=".split(), "COMPARE") | dict.fromkeys("+ -".split(), "SIGN") | dict.fromkeys("+= -= *= /= %= &= |= ^= <<= >>= &^=".split(), "ASSIGN") | {"++": "INCDEC", "--": "INCDEC"}
_GO = _master(nl=r"\n", comment=_C_COMMENT, blank=r"[ \t\r]+", str=r'"(?:[^"\\\n]|\\.)*"|`[^`]*`', chr=r"'(?:[^'\\\n]|\\(?:[abfnrtv\\'\"]|x[0-9a-fA-F]{2}|[0-7]{3}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))'", num=r"(?:0[xX](?:_?[0-9a-fA-F])+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB](?:_?[01])+|0[oO]?(?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d+)?)i?(?!\w)", id=_ID, op=r"\.\.\.|<<=|>>=|&\^=|&\^|<-|:=|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||[-+*/%&|^]=|[-+*/%&|^~!<>=:;,.(){}\[\]]")
_GO_ENDS = _words("NAME NUMBER STRING CHAR break continue fallthrough return INCDEC ) ] }")


def go(text: str) -> Stream:
    """With the semicolons that Go's rules put at line ends."""
    text = text.removeprefix("\ufeff")
    kinds, at, pos, n, match = [], [], 0, len(text), _GO.match
    names = {"str": "STRING", "chr": "CHAR", "num": "NUMBER"}
    while pos < n:
        m = match(text, pos)
        if m is None:
            kinds.append(ERROR)
            at.append(pos)
            return kinds, at
        k, t = m.lastgroup, m.group()
        if k == "nl" or k == "comment" and "\n" in t:
            if kinds and kinds[-1] in _GO_ENDS:
                kinds.append(";")
                at.append(pos)
        elif k == "id":
            kinds.append(t if t in _GO_KEYWORDS else "NAME")
            at.append(pos)
        elif k not in ("comment", "blank"):
            # a semicolon may be left out before a closing bracket
            kinds.append(names[k] if k in names else _GO_OPS.get(t, t))
            at.append(pos)
        pos = m.end()
    if kinds and kinds[-1] in _GO_ENDS:
        kinds.append(";")
        at.append(n)
    return kinds, at


# ---------------------------------------------------------------- Java
_JAVA_KEYWORDS = {w: w for w in "assert break case catch class continue default do else enum extends final finally for if implements import instanceof interface new package return static super switch synchronized this throw throws try void while true false null".split()} | dict.fromkeys("abstract native private protected public strictfp transient volatile".split(), "MODIFIER") | dict.fromkeys("boolean byte char short int long float double".split(), "PRIMITIVE") | dict.fromkeys("const goto _".split(), ERROR)
_JAVA_OPS = dict.fromkeys("/ % << ^ && || <= == !=".split(), "BINOP") | dict.fromkeys("+ -".split(), "SIGN") | dict.fromkeys("+= -= *= /= %= &= |= ^= <<=".split(), "ASSIGN") | {"++": "INCDEC", "--": "INCDEC"}
_JAVA = _master(blank=r"[ \t\r\n\f]+|" + _C_COMMENT, block=r'"""[ \t\f]*\r?\n(?:[^\\]|\\.)*?"""', str=r'"(?:[^"\\\r\n]|\\.)*"', chr=r"'(?:[^'\\\r\n]|\\(?:[btnfrs\"'\\]|[0-7]{1,3}|u+[0-9a-fA-F]{4}))'", num=r"(?:0[xX][0-9a-fA-F_]*(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bB][01_]+|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)[lLfFdD]?(?!\w)", id=r"[^\W\d]\w*|\$[\w$]*", gt=r">", op=r"\.\.\.|->|::|<<=|\+\+|--|<<|<=|==|!=|&&|\|\||[-+*/%&|^]=|[-+*/%&|^~!<=?:;,.(){}\[\]@]")
_JAVA_SOFT = {"record": r"record\s+[^\W\d]\w*\s*[<(]", "sealed": r"sealed\s+\w", "permits": r"permits\s+\w", "yield": r"yield\s+[^=.;)\s]|yield\s*[(\"'-]", "when": r"when\b(?!\s*(?:->|:|,))", "open": r"open\s+module", "module": r"module\s+[\w.]+\s*\{", "with": r"with\s+\w"}
_JAVA_SOFT = {k: re.compile(v) for k, v in _JAVA_SOFT.items()}


def java(text: str) -> Stream:
    text = text.removeprefix("\ufeff").removesuffix("\x1a")
    kinds, at, pos, n, match = [], [], 0, len(text), _JAVA.match
    names = {"str": "STRING", "block": "STRING", "chr": "CHAR", "num": "NUMBER"}
    while pos < n:
        m = match(text, pos)
        if m is None:
            kinds.append(ERROR)
            at.append(pos)
            return kinds, at
        k, t = m.lastgroup, m.group()
        if k != "blank":
            if k == "id":
                kind = _JAVA_KEYWORDS.get(t)
                if kind is None:
                    soft = _JAVA_SOFT.get(t)
                    prior = kinds[-1] if kinds else ""
                    kind = "NAME"
                    if soft and soft.match(text, pos):
                        if t == "record" and prior in ("", ";", "{", "}", "MODIFIER", "static", "final", "NAME", ")") or t == "sealed" and prior in ("", ";", "{", "}", "MODIFIER", "static") or t == "permits" and prior in ("NAME", "GT", "GTA") or t == "yield" and prior in ("{", "}", ";", "->", ":", ")") or t == "when" and prior in ("NAME", ")") or t in ("open", "module") and prior in ("", ";", "open"):
                            kind = t
                    elif t == "non" and text.startswith("non-sealed", pos):
                        kinds.append("sealed")
                        at.append(pos)
                        pos += len("non-sealed")
                        continue
            elif k == "gt":
                kind = "GTA" if text[pos + 1 : pos + 2] in (">", "=") else "GT"
            else:
                kind = names[k] if k in names else _JAVA_OPS.get(t, t)
            kinds.append(kind)
            at.append(pos)
        pos = m.end()
    return kinds, at


# ---------------------------------------------------------------- SQL
_SQL_KEYWORDS = _words(
    """add all alter always and any array as asc at between by call case cast change check collate column comment commit conflict constraint create cross current database date default delete desc distinct do
    drop duplicate else end enum escape except exists explain extension fetch filter first for foreign from full generated grant group groups having identity if ilike in index inner insert intersect interval into is
    join key last lateral left like limit matched materialized merge modify natural next not nothing null nulls offset on only or order outer over owner partition primary qualify range recursive references regexp
    rename replace returning revoke right rlike rollback row rows savepoint schema select sequence set similar some start table temporary then to transaction true false type union unique update using values view when where window
    with without work begin"""
)
#: Words after the first of a type's name, and of a column's properties.
_SQL_WORDS = dict.fromkeys("varying precision unsigned signed zerofill large object".split(), "TYPE_WORD") | dict.fromkeys("auto_increment autoincrement stored virtual persisted sparse visible invisible rowversion".split(), "COLUMN_WORD")
_SQL = _master(blank=r"[\s\ufeff]+|--[^\n]*|/\*(?:[^*]|\*(?!/))*\*/", str=r"[eEnNxXbB]?'(?:[^']|'')*'|\$(?P<tag>[A-Za-z_]*)\$.*?\$(?P=tag)\$", quoted=r'"(?:[^"]|"")+"|`[^`]+`', num=r"(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?(?!\w)", id=r"[^\W\d][\w$]*", param=r"\?|[$:@]{1,2}\w+", op=r"::|\|\||<=>|<>|!=|<=|>=|==|->>?|#>>?|[-+*/%^&|~<>=(),.;\[\]:]")
_SQL_OPS = dict.fromkeys("/ % ^ & | || ~ -> ->> #> #>>".split(), "OP") | dict.fromkeys("< > <= >= <> != == <=>".split(), "COMPARE") | {"+": "SIGN", "-": "SIGN"}


def sql(text: str) -> Stream:
    names = {"str": "STRING", "quoted": "NAME", "num": "NUMBER", "param": "PARAM"}
    return _run(_SQL, text, lambda k, t: None if k == "blank" else (t.lower() if t.lower() in _SQL_KEYWORDS else _SQL_WORDS.get(t.lower(), "NAME")) if k == "id" else names[k] if k in names else _SQL_OPS.get(t, t))


# ---------------------------------------------------------------- JavaScript and TypeScript
_JS_WORDS = _words("import export default if else while do for continue break return throw with switch case try catch finally debugger let const var function class extends yield in instanceof await typeof void delete new super this null true false enum async of get set static as from")
_TS_WORDS = _words("type interface namespace module declare abstract readonly keyof infer is asserts public private protected override satisfies unique global implements assert out accessor require")
_JS_OPS = dict.fromkeys("/ % ** << == != === !== <= && || ?? ^".split(), "BINOP") | dict.fromkeys("+ -".split(), "SIGN") | dict.fromkeys("+= -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split(), "ASSIGN")
_JS = _master(blank=r"[\s\ufeff]+|" + _C_COMMENT, str=r'"(?:[^"\\\r\n]|\\(?:\r\n|.))*"|' + r"'(?:[^'\\\r\n]|\\(?:\r\n|.))*'", num=r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?(?![\w$])", private=r"#[\w$]+", id=r"(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4})*", gt=r">", op=r"\.\.\.|=>|\?\.(?!\d)|\*\*=|<<=|&&=|\|\|=|\?\?=|===|!==|\+\+|--|\*\*|<<|<=|==|!=|&&|\|\||\?\?|[-+*/%&|^]=|[-+*/%&|^~!<=?:;,.(){}\[\]@]")
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\.|\[(?:[^\]\\\r\n]|\\.)*\])+/[a-zA-Z]*")
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\.|\$(?!\{))*(?:`|\$\{)", re.S)
#: After these a slash divides and a line end before ++ ends the statement.
_JS_VALUE = _words("NAME NUMBER STRING REGEX TEMPLATE TEMPLATE_TAIL PRIVATE ) ] } this super null true false async of get set static as from let POSTFIX") | _TS_WORDS
_JS_RESTRICTED = _words("return break continue throw yield")


_JSX_START = re.compile(r"<(?:>|(?![^<>=]*?\bextends\b)[A-Za-z_$][\w$]*(?:[.:-][\w$]+)*(?=[\s/>{]))")
_JSX_NAME = re.compile(r"[A-Za-z_$][\w$.:-]*")
_JSX_BLANK = re.compile(r"(?:\s|/\*(?:[^*]|\*(?!/))*\*/|//[^\n]*)*")
_JSX_TEXT = re.compile(r"[^{}<>]*")
_JSX_STRING = re.compile(r"\"[^\"]*\"|'[^']*'")


class _Element:
    """An element of markup in a script: its open tags, and whether the place is within a tag."""

    def __init__(self) -> None:
        self.tags: list[str] = []
        self.inside = self.shown = False

    def scan(self, text: str, pos: int) -> tuple[int, str]:
        """Up to an expression ('expression': after its brace) or the end ('end'); 'error' where the markup is wrong."""
        while True:
            if self.inside:
                pos = _JSX_BLANK.match(text, pos).end()
                if text.startswith("/>", pos):
                    self.tags.pop()
                    self.inside, pos = False, pos + 2
                    if not self.tags:
                        return pos, "end"
                elif text.startswith(">", pos):
                    self.inside, pos = False, pos + 1
                elif text.startswith("{", pos):
                    pos, more = self._braced(text, pos)
                    if more:
                        return pos, "expression"
                else:
                    m = _JSX_NAME.match(text, pos)
                    if m is None:
                        return pos, "error"
                    pos = _JSX_BLANK.match(text, m.end()).end()
                    if text.startswith("=", pos):
                        pos = _JSX_BLANK.match(text, pos + 1).end()
                        if not text.startswith("{", pos):
                            m = _JSX_STRING.match(text, pos)
                            if m is None:
                                return pos, "error"
                            pos = m.end()
                continue
            pos = _JSX_TEXT.match(text, pos).end() if self.tags else pos
            if text.startswith("{", pos) and self.tags:
                pos, more = self._braced(text, pos)
                if more:
                    return pos, "expression"
            elif text.startswith("</", pos):
                m = re.compile(r"</\s*([\w$.:-]*)\s*>").match(text, pos)
                if m is None or not self.tags or self.tags.pop() != m[1]:
                    return pos, "error"
                pos = m.end()
                if not self.tags:
                    return pos, "end"
            elif text.startswith("<>", pos):
                self.tags.append("")
                pos += 2
            elif text.startswith("<", pos) and (m := _JSX_NAME.match(text, pos + 1)):
                self.tags.append(m[0])
                self.inside, pos = True, m.end()
            else:
                return pos, "error"

    def _braced(self, text: str, pos: int) -> tuple[int, bool]:
        """Behind a brace that holds only comments, or behind an opening one and a spread's dots."""
        after = _JSX_BLANK.match(text, pos + 1).end()
        if text.startswith("}", after):
            return after + 1, False
        return (after + 3, True) if text.startswith("...", after) else (pos + 1, True)


def _ecma(text: str, words: frozenset[str], plain: frozenset[str], markup: bool = False) -> tuple[list[str], list[int], list[bool]]:
    """Names, offsets, and whether a line end stands before the token.

    An element of markup is named as a template: its expressions stand between its head, middle and tail.
    """
    kinds, at, fresh = [], [], []
    pos, n, match, braces, line = 0, len(text), _JS.match, [], True
    if text.startswith("#!"):
        pos = text.find("\n") if "\n" in text else n

    def put(kind: str, where: int) -> None:
        kinds.append(kind)
        at.append(where)
        fresh.append(line)

    while pos < n:
        ch = text[pos]
        if ch == "}" and braces and isinstance(braces[-1], _Element) or markup and ch == "<" and (kinds[-1] if kinds else "") not in _JS_VALUE and _JSX_START.match(text, pos):
            element, start = (braces.pop(), pos) if ch == "}" else (_Element(), pos)
            pos, what = element.scan(text, pos + (ch == "}"))
            if what == "error":
                put(ERROR, pos)
                break
            more = what == "expression"
            put(("TEMPLATE_MID" if more else "TEMPLATE_TAIL") if element.shown else "TEMPLATE_HEAD" if more else "TEMPLATE", start)
            if more:
                element.shown = True
                braces.append(element)
            line = False
            continue
        if ch == "`" or ch == "}" and braces and braces[-1]:
            if ch == "}":
                braces.pop()
            m = _JS_TEMPLATE.match(text, pos + 1)
            if m is None:
                put(ERROR, pos)
                break
            more = m.group().endswith("${")
            put(("TEMPLATE_MID" if more else "TEMPLATE_TAIL") if ch == "}" else "TEMPLATE_HEAD" if more else "TEMPLATE", pos)
            if more:
                braces.append(True)
            pos, line = m.end(), False
            continue
        m = match(text, pos)
        prior = kinds[-1] if kinds else ""
        if ch == "/" and (m is None or m.lastgroup != "blank") and prior not in _JS_VALUE:
            m = _JS_REGEX.match(text, pos)
            if m is None:
                put(ERROR, pos)
                break
            put("REGEX", pos)
            pos, line = m.end(), False
            continue
        if m is None:
            put(ERROR, pos)
            break
        kind, t = m.lastgroup, m.group()
        if kind == "blank":
            if "\n" in t or "\r" in t:
                line = True
                if prior in _JS_RESTRICTED:
                    put(";", pos)
            pos = m.end()
            continue
        if kind == "id":
            put(t if t in words or t in plain else "NAME", pos)
        elif kind == "op":
            if t == "{":
                braces.append(False)
            elif t == "}" and braces:
                braces.pop()
            if t in ("++", "--"):
                if prior in _JS_VALUE and line and prior != "}":
                    put("ASI", pos)
                    put("INCDEC", pos)
                else:
                    put("POSTFIX" if prior in _JS_VALUE and not line else "INCDEC", pos)
            else:
                put(_JS_OPS.get(t, t), pos)
        elif kind == "gt":
            put("GTA" if text[pos + 1 : pos + 2] in (">", "=") else "GT", pos)
        else:
            put({"str": "STRING", "num": "NUMBER", "private": "PRIVATE"}[kind], pos)
        pos, line = m.end(), False
    return kinds, at, fresh


def javascript(text: str) -> tuple[list[str], list[int], list[bool]]:
    return _ecma(text.removeprefix("\ufeff"), _JS_WORDS, frozenset())


def typescript(text: str) -> tuple[list[str], list[int], list[bool]]:
    return _ecma(text.removeprefix("\ufeff"), _JS_WORDS, _TS_WORDS)


def jsx(text: str) -> tuple[list[str], list[int], list[bool]]:
    return _ecma(text.removeprefix("\ufeff"), _JS_WORDS, frozenset(), markup=True)


def tsx(text: str) -> tuple[list[str], list[int], list[bool]]:
    return _ecma(text.removeprefix("\ufeff"), _JS_WORDS, _TS_WORDS, markup=True)


_BLOCK_HEADS = _words("if for while switch catch with await")
_BLOCK_BEFORE = _words("; { else try finally do")


def stray_return(kinds: list[str]) -> int:
    """Index of a return that no function holds, -1 without one.

    Braces that may belong to a function, class or object are taken to do so; sure blocks are those that begin a
    statement or follow the head of a statement that has one.
    """
    if "return" not in kinds:
        return -1
    sure: list[bool] = []
    heads: list[str] = []
    closed = before = ""
    for i, k in enumerate(kinds):
        if k == "{":
            sure.append(before in _BLOCK_BEFORE or not i or before == ")" and closed in _BLOCK_HEADS)
        elif k == "}":
            if sure:
                sure.pop()
        elif k == "(":
            heads.append(before)
        elif k == ")":
            closed = heads.pop() if heads else ""
        elif k == "TEMPLATE_HEAD":
            sure.append(False)
        elif k == "TEMPLATE_TAIL" and sure:
            sure.pop()
        elif k == "return" and before not in (".", "?.") and all(sure) and (i + 1 == len(kinds) or kinds[i + 1] not in (":", "(", "=", ",", "?")):
            return i
        before = k
    return -1
