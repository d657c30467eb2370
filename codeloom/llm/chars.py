"""Characters that look the same: cleaning, look-alike classes, and the repair of mixed-script words."""

from __future__ import annotations

import re
import unicodedata

import regex

# Look-alike letters, each row Latin, Cyrillic, Greek ('-' where a script has none).
LOOKALIKES = """
a а α
c с ϲ
d ԁ -
e е -
h һ -
i і ι
j ј ϳ
l ӏ -
o о ο
p р ρ
q ԛ -
s ѕ -
u - υ
v ѵ ν
w ԝ -
x х -
y у -
A А Α
B В Β
C С Ϲ
E Е Ε
H Н Η
I І Ι
J Ј Ϳ
K К Κ
M М Μ
N - Ν
O О Ο
P Р Ρ
Q Ԛ -
S Ѕ -
T Т Τ
W Ԝ -
X Х Χ
Y Ү Υ
Z - Ζ
"""
SCRIPTS = ("LATIN", "CYRILLIC", "GREEK")

#: letter -> (Latin, Cyrillic, Greek) members of its class
CLASS: dict[str, tuple[str, ...]] = {}
for _line in LOOKALIKES.split("\n"):
    _row = tuple(_line.split())
    for _ch in _row:
        if _ch != "-":
            CLASS[_ch] = _row
#: Cyrillic У and the micro sign look like members of a class without being its usual form
CLASS["У"] = CLASS["Y"]
#: letter -> the first member of its class, whatever the script
PROTOTYPE = {ord(c): next(x for x in row if x != "-") for c, row in CLASS.items()} | {0xB5: "μ"}

_INVISIBLE = dict.fromkeys([0xAD, 0x34F, 0x61C, 0x180E, 0x200B, 0x200E, 0x200F, 0x2060, 0x2061, 0x2062, 0x2063, 0x2064, 0xFEFF])
_SPACES = dict.fromkeys([0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000], " ")
_WIDE = {c: unicodedata.normalize("NFKC", chr(c)) for c in [*range(0xFF01, 0xFFEF)] if unicodedata.decomposition(chr(c)).startswith(("<wide>", "<narrow>"))}
_CLEAN = {**_WIDE, **_SPACES, **_INVISIBLE, 0xB5: "μ"}
_ANY = re.compile("[" + "".join(map(chr, _CLEAN)) + "‌‍]")
#: A joiner stays where it is seen: within an emoji, or between letters of a script whose shapes it changes.
_JOINER = regex.compile(r"(?<![\p{So}\p{Sk}️])‍|‍(?![\p{So}♀♂])")
_SHAPED = regex.compile(r"[؀-ࣿऀ-෿က-႟ក-៿᠀-᢯]")
_JOINERS = re.compile("[‌‍]")


def clean(text: str) -> str:
    """One form for widths, spaces, invisible characters and combining accents; nothing visible changes."""
    if text.isascii():
        return text
    if _ANY.search(text):
        if _SHAPED.search(text):
            text = regex.sub(r"(?<![؀-ࣿऀ-෿က-႟ក-៿᠀-᢯])[‌‍](?![\p{So}])|(?<![؀-ࣿऀ-෿က-႟ក-៿᠀-᢯\p{So}\p{Sk}️])[‌‍]", "", text)
        elif _JOINERS.search(text):
            text = _JOINER.sub("", text.replace("‌", ""))
        text = text.translate(_CLEAN)
    return unicodedata.normalize("NFC", text)


#: Greek and Cyrillic, also precomposed: only their letters are ever replaced.
_OTHER = re.compile("[\u0370-\u052f\u1f00-\u1fff]")


def skeleton(text: str) -> str:
    """Clean text with every look-alike letter replaced by its class's first member (accents stay)."""
    text = clean(text)
    if text.isascii() or not _OTHER.search(text):
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(PROTOTYPE))


_SOLID = {s: regex.compile("[" + "".join(c for c in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B)]) if c not in CLASS) + "]" if i == 0 else r"[\p{%s}--[%s]]" % (s.capitalize(), "".join(r[i] for r in set(CLASS.values()) if r[i] != "-")), regex.V1) for i, s in enumerate(SCRIPTS)}


def solid_counts(text: str) -> list[int]:
    """Letters per script that look like no letter of another script."""
    return [len(_SOLID[s].findall(text)) for s in SCRIPTS]


def dominant(counts: list[int]) -> int | None:
    return max(range(3), key=lambda i: counts[i]) if any(counts) else None


_TO = [{ord(c): row[i] for c, row in CLASS.items() if row[i] != "-"} for i in range(3)]


_SCRIPT = [regex.compile(r"\p{%s}" % s.capitalize()) for s in SCRIPTS]


def scripts(word: str) -> list[int]:
    return [i for i in range(3) if _SCRIPT[i].search(word)]


def spellings(base: str, script: int | None) -> list[tuple[str, int]]:
    """(spelling, script) of a decomposed word with all its letters in one script: the given one, else in each that can."""
    out = []
    for s in range(3) if script is None else (script,):
        w = unicodedata.normalize("NFC", base.translate(_TO[s]))
        if scripts(w) == [s]:
            out.append((w, s))
    return out


#: Clean spellings in Latin letters, clean ones in others, and mixed ones.
LATIN, OTHER, MIXED = 0, 1, 2


def suspects(text: str) -> tuple[int, list[tuple[str, str, bool, int, bool]]]:
    """The dominant script of a clean text, and the spellings in question: of its mixed-script words and of words of look-alikes only.

    A spelling is (word, look, settled, rank, own): ``look`` is the same for all words that look the same; a word is
    ``settled`` if some letter of it looks like no other script's, so that its script shows; ``rank`` is LATIN,
    OTHER or MIXED; ``own`` tells the text's words from the one-script spellings they might stand for.  Script,
    look and settledness depend on nothing but looks.
    """
    if text.isascii() or not _OTHER.search(text):
        return 0, []
    ctx, out = dominant(solid_counts(unicodedata.normalize("NFD", text))) or 0, {}
    for word in set(_ALL_WORDS.findall(text)):
        found = scripts(word)
        if not found:
            continue
        base = unicodedata.normalize("NFD", word)
        script = dominant(solid_counts(base))
        if script is not None and len(found) == 1:
            continue
        look, settled = skeleton(word), script is not None
        out[word] = (word, look, settled, MIXED if len(found) > 1 else LATIN if found == [0] else OTHER, True)
        for w, s in spellings(base, script):
            out.setdefault(w, (w, look, settled, LATIN if s == 0 else OTHER, False))
    return ctx, sorted(out.values())


_ALL_WORDS = regex.compile(r"[\p{L}\p{M}]+")


def replace_words(text: str, fixed: dict[str, str]) -> str:
    """The text with whole words replaced."""
    return _ALL_WORDS.sub(lambda m: fixed.get(m[0], m[0]), text)
