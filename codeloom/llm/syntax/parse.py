"""The first unrecoverable error of a source text, by language."""

from __future__ import annotations

from functools import lru_cache

from codeloom.llm.syntax import grammars, lexers
from codeloom.llm.syntax.lr import Tables

#: Language by a path's extension.
EXTENSIONS = {"java": "java", "py": "python", "pyi": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "go": "go", "c": "c", "h": "c", "json": "json", "sql": "sql"}
#: Languages that share another's grammar; markup is told by their lexers.
_SHARED = {"jsx": "javascript", "tsx": "typescript"}


@lru_cache(maxsize=None)
def tables(language: str) -> Tables:
    return Tables(getattr(grammars, language.upper()))


def first_error(language: str, text: str) -> tuple[int, str] | None:
    """Offset and token of the first place where no continuation fits; None for a well-formed text.

    A C text is parsed once for each branch of its longest condition, so that every branch that a compiler may take
    is parsed; the first error of all counts.
    """
    t = tables(_SHARED.get(language, language))
    if language == "c":
        found = [e for kinds, at in lexers.c(text) if (e := _placed(t.first_error(kinds), kinds, at, text))]
        return min(found) if found else None
    stream = getattr(lexers, language)(text)
    kinds, at = stream[:2]
    if len(stream) == 2:
        return _placed(t.first_error(kinds), kinds, at, text)
    fresh = stream[2]
    bad = t.first_error(kinds, "ASI", lambda i: fresh[i] or kinds[i] == "}")
    return _placed(lexers.stray_return(kinds) if bad < 0 else bad, kinds, at, text)


def _placed(bad: int, kinds: list[str], at: list[int], text: str) -> tuple[int, str] | None:
    if bad < 0:
        return None
    return (at[bad], kinds[bad]) if bad < len(at) else (len(text), "end of file")
