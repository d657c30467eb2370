"""The words a reader of a rendered wiki page sees."""

from __future__ import annotations

import html
import re

import regex

from codeloom.llm.chars import skeleton

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_REF = re.compile(r"(?P<alone><ref\b[^<>]*/>|<references\b[^<>]*>)|(?P<open><ref\b[^<>]*>)|(?P<close></ref\s*>)", re.I)
_BRACES = re.compile(r"(?P<open>\{\{)|(?P<close>\}\})")
_HIDDEN_LINK = re.compile(r"\[\[\s*(?:category|kategorie|catégorie|категория|κατηγορία)\s*:[^\[\]]*\]\]", re.I)
_MEDIA = re.compile(r"\[\[\s*(?:file|image|datei|fichier|файл|αρχείο|media)\s*:[^\[\]|]*(?:\|[^\[\]|]*)*?(?:\|([^\[\]|]*))?\]\]", re.I)
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]]*)\]\]")
_URL = re.compile(r"\[(?:https?:|ftp:|mailto:)?//[^\s\[\]]*\s*([^\[\]]*)\]")
_BARE_URL = re.compile(r"(?:https?|ftp)://[^\s\[\]<>|]+")
_TABLE_LINE = re.compile(r"^[ \t:]*(?:\{\||\|-|\|\}).*$", re.M)
_CELL_STYLE = re.compile(r"^([ \t]*[|!])[^|\[\]{}\n]*=[^|\[\]{}\n]*\|(?!\|)", re.M)
_BLOCK = re.compile(r"</?(?:br|p|div|blockquote|li|ul|ol|td|tr|th|table|h[1-6]|hr|center|gallery|poem|pre|dl|dt|dd)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_QUOTES = re.compile(r"'{2,}")
_MAGIC = re.compile(r"__[A-Z]+__")
_MARK = re.compile("[̀-゙゚ͯ҃-҇]")
_WORDS = re.compile(r"[^\W_]+")
_MARKED_WORDS = regex.compile(r"[\p{L}\p{N}\p{M}]+")


def _without(text: str, pattern: re.Pattern[str], nested: bool) -> str:
    """The text without what stands between opening and closing marks, in one pass; unmatched marks stay."""
    cuts: list[tuple[int, int]] = []
    opened: list[int] = []
    for m in pattern.finditer(text):
        if m.lastgroup == "open":
            if nested or not opened:
                opened.append(m.start())
        elif m.lastgroup == "alone":
            if not opened:
                cuts.append(m.span())
        elif opened:
            start = opened.pop()
            while cuts and cuts[-1][0] > start:
                cuts.pop()
            cuts.append((start, m.end()))
    out, pos = [], 0
    for start, end in cuts:
        out.append(text[pos:start])
        pos = end
    return "".join(out) + text[pos:]


def render(text: str) -> str:
    """The text as a reader of the rendered page sees it: no comments, footnotes, template calls or markup.

    Nested template calls go whole; an unclosed comment hides the rest, any other unclosed construct is
    ordinary text.  The time taken is in proportion to the text, however deep its nesting.
    """
    if "<" in text:
        if "<!--" in text:
            text = _COMMENT.sub("", text)
        text = _without(text, _REF, nested=False)
    if "{" in text:
        if "{{" in text:
            text = _without(text, _BRACES, nested=True)
        if "{|" in text or "\n|" in text:
            text = _CELL_STYLE.sub(r"\1", _TABLE_LINE.sub("", text))
    if "[" in text:
        text = _HIDDEN_LINK.sub("", text)
        text = _MEDIA.sub(r" \1 ", text)
        text = _LINK.sub(r"\1", text)
        text = _URL.sub(r"\1", text)
    if "//" in text:
        text = _BARE_URL.sub(" ", text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK.sub(" ", text))
    if "''" in text:
        text = _QUOTES.sub("", text)
    if "__" in text:
        text = _MAGIC.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    return text


def words(text: str) -> list[str]:
    """Runs of letters and digits of plain text, in one form for letter case and look-alike characters."""
    text = skeleton(text).lower()
    return _MARKED_WORDS.findall(text) if not text.isascii() and _MARK.search(text) else _WORDS.findall(text)


def page_words(text: str) -> list[str]:
    return words(render(text))
