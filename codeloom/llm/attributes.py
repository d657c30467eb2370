"""Repository attribute files: patterns, their precedence, and which paths they mark."""

from __future__ import annotations

import re

#: Attribute names (their last part) that mark a path as not written by hand here.
KINDS = ("generated", "vendored")


def glob_regex(pattern: str, directory: str = "") -> str:
    """An anchored regular expression for a pattern of an attribute file that lies in ``directory``.

    Without a slash (but at the end) it names a file at any depth, else it is relative to the directory;
    ``**`` spans directories, ``*`` and ``?`` do not.
    """
    anchored = "/" in pattern.rstrip("/")
    body, i, p = "", 0, pattern.lstrip("/")
    while i < len(p):
        if p.startswith("**/", i):
            body, i = body + "(?:.*/)?", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            body, i = body + "/.*", i + 3
        elif p[i] == "*":
            while i < len(p) and p[i] == "*":
                i += 1
            body += "[^/]*"
        elif p[i] == "?":
            body, i = body + "[^/]", i + 1
        elif p[i] == "[" and "]" in p[i + 2 :]:
            j = p.index("]", i + 2)
            inner = p[i + 1 : j].replace("\\", "\\\\")
            body, i = body + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]", j + 1
        elif p[i] == "\\" and i + 1 < len(p):
            body, i = body + re.escape(p[i + 1]), i + 2
        else:
            body, i = body + re.escape(p[i]), i + 1
    base = re.escape(directory.strip("/") + "/") if directory.strip("/") else ""
    return f"^{base}{'' if anchored else '(?:.*/)?'}{body}$"


def rules(content: str, directory: str = "") -> list[tuple[int, str, str, bool | None]]:
    """(line number, regex, kind, value) of an attribute file; value None takes a mark back."""
    out = []
    for no, line in enumerate(content.splitlines(), 1):
        line = line.strip()
        if not line or line.startswith(("#", "[attr]", "!")):
            continue
        m = re.match(r'"((?:[^"\\]|\\.)*)"\s*(.*)$', line) or re.match(r"(\S+)\s*(.*)$", line)
        for word in m[2].split():
            name, _, value = word.lstrip("-!").partition("=")
            kind = name.rsplit("-", 1)[-1].lower()
            if kind in KINDS:
                mark = None if word[0] == "!" else word[0] != "-" and value.lower() not in ("false", "0", "no", "unset")
                out.append((no, glob_regex(m[1], directory), kind, mark))
    return out


#: Patterns that public repositories commonly declare; they hold where a repository declares nothing else.
COMMON = """
**/node_modules/** vendored
**/bower_components/** vendored
**/third_party/** vendored
**/third-party/** vendored
**/thirdparty/** vendored
**/3rdparty/** vendored
/external/** vendored
/extern/** vendored
/deps/** vendored
/vendor/** vendored
**/Godeps/** vendored
**/jspm_packages/** vendored
**/generated-sources/** generated
**/__generated__/** generated
**/build/gen/** generated
*.min.js generated
*.min.css generated
*.bundle.js generated
*.js.map generated
*_pb2.py generated
*_pb2_grpc.py generated
*.pb.go generated
*.pb.c generated
*.pb.h generated
*_generated.go generated
*.generated.* generated
*.designer.cs generated
*.g.ts generated
package-lock.json generated
npm-shrinkwrap.json generated
composer.lock generated
Pipfile.lock generated
"""
COMMON_RULES = [(re.compile(r, re.I), kind) for _, r, kind, _ in rules(COMMON)]


def common_kind(path: str) -> str | None:
    return next((kind for r, kind in COMMON_RULES if r.match(path)), None)
