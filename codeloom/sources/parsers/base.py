"""What parsers share: the event sink, masking of comments and strings, spans of blocks."""

from __future__ import annotations

import re

Key = tuple[str, str]  # label, fq_name


class Sink:
    """Collects the events of one file."""

    def __init__(self, path: str, language: str, text: str) -> None:
        self.path, self.text = path, text
        self.events: list[dict] = []
        self.file: Key = ("File", path)
        self.node(self.file, name=path.rsplit("/", 1)[-1], path=path, language=language, line_count=text.count("\n") + (not text.endswith("\n") and text != ""))

    def node(self, key: Key, **props) -> Key:
        self.events.append({"op": "node", "label": key[0], "fq_name": key[1], "edge_type": None, "to_label": None, "to_fq_name": None, "props": {k: _text(v) for k, v in props.items() if v is not None}})
        return key

    def edge(self, a: Key, kind: str, b: Key, **props) -> None:
        self.events.append({"op": "edge", "label": a[0], "fq_name": a[1], "edge_type": kind, "to_label": b[0], "to_fq_name": b[1], "props": {k: _text(v) for k, v in props.items() if v is not None}})

    def line(self, offset: int) -> int:
        return self.text.count("\n", 0, offset) + 1

    def child(self, owner: Key, label: str, fq_name: str, offset: int | None = None, **props) -> Key:
        """A node that its owner contains."""
        if offset is not None:
            props.setdefault("start_line", self.line(offset))
        key = self.node((label, fq_name), name=props.pop("name", fq_name.rsplit(".", 1)[-1]), file_ref=self.path, **props)
        self.edge(owner, "CONTAINS", key)
        return key


def _text(v) -> str:
    return str(v).lower() if isinstance(v, bool) else str(v)


_STYLES = {
    "c": r"//[^\n]*|/\*.*?(?:\*/|\Z)", "hash": r"#[^\n]*", "dash": r"--[^\n]*|/\*.*?(?:\*/|\Z)", "css": r"/\*.*?(?:\*/|\Z)", "scss": r"//[^\n]*|/\*.*?(?:\*/|\Z)", "php": r"//[^\n]*|#[^\n]*|/\*.*?(?:\*/|\Z)", "tf": r"//[^\n]*|#[^\n]*|/\*.*?(?:\*/|\Z)", "xml": r"<!--.*?(?:-->|\Z)",
}
_STRING = r"\"\"\".*?\"\"\"|'''.*?'''|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'"


def masked(text: str, style: str, strings: bool = True, ticks: bool = False) -> str:
    """The text with comments (and strings) blanked out; offsets and line ends stay."""
    string = _STRING + (r"|`(?:[^`\\]|\\.)*`" if ticks else "")
    pattern = re.compile(f"(?P<c>{_STYLES[style]})|(?P<s>{string})", re.S)

    def blank(m: re.Match[str]) -> str:
        if m.lastgroup == "s" and not strings:
            return m.group()
        t = m.group()
        inner = re.sub(r"[^\n]", " ", t)
        return t[0] + inner[1:-1] + t[-1] if m.lastgroup == "s" and len(t) > 1 else inner

    return pattern.sub(blank, text)


def block_end(text: str, start: int) -> int:
    """Offset behind the block that the brace at ``start`` opens."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(text, start):
        depth += 1 if m.group() == "{" else -1
        if not depth:
            return m.end()
    return len(text)


def arguments(text: str, start: int) -> tuple[list[str], int]:
    """The parts between the parenthesis at ``start`` and its partner, split at outer commas; and the offset behind."""
    depth, parts, begin = 0, [], start + 1
    for i in range(start, len(text)):
        ch = text[i]
        if ch in "([{<" and (ch != "<" or re.match(r"<[\w\s,.?&\[\]<>]*>", text[i:])):
            depth += 1
        elif ch in ")]}" or ch == ">" and depth > 1 and text[i - 1] not in "-=":
            depth -= 1
            if not depth:
                last = text[begin:i].strip()
                return (parts + [last] if last or parts else []), i + 1
        elif ch == "," and depth == 1:
            parts.append(text[begin:i].strip())
            begin = i + 1
    return [], len(text)
