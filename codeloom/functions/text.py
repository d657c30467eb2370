"""Scalar helpers: paths, names, durations, severity words; all as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_UNITS = {"s": 1, "sec": 1, "m": 60, "min": 60, "h": 3600, "hr": 3600, "d": 86400, "day": 86400}


def duration_seconds(text: str, default: int | None = None) -> int:
    """'15m', '2h', '7day' in seconds; anything else gives ``default``, or an error if there is none."""
    m = re.fullmatch(r"\s*(\d+)\s*(s|sec|m|min|h|hr|d|day)s?\s*", (text or "").lower())
    if m:
        return int(m[1]) * _UNITS[m[2]]
    if default is None:
        raise ValueError(f"not a duration: {text!r}")
    return default


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def last_segment(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def module_prefix(fq_name: Column, segments: int = 3) -> Column:
    """The first dotted segments of a name; the whole name if it has no more."""
    parts = F.split(fq_name, r"\.")
    return F.when(F.size(parts) <= segments, fq_name).otherwise(F.array_join(F.slice(parts, 1, segments), "."))


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a path holds one of the patterns: a substring, or fragments in order around ``**``."""
    hit = F.lit(False)
    clean = slashes(path)
    for p in patterns:
        parts = [x for x in p.replace("\\", "/").split("**")]
        hit = hit | (clean.contains(parts[0]) if len(parts) == 1 else clean.rlike(".*".join(map(re.escape, parts))))
    return F.coalesce(hit, F.lit(False))


def wildcard(column: Column, query: str) -> Column:
    """Case-insensitive: every piece between ``*`` occurs (in any order); no pieces match nothing."""
    pieces = [p for p in query.lower().split("*") if p]
    if not pieces:
        return F.lit(False)
    hit = F.lit(True)
    for p in pieces:
        hit = hit & F.lower(column).contains(p)
    return F.coalesce(hit, F.lit(False))


def severity_score(severity: Column) -> Column:
    """A number for a severity word, or for a vector by its count of high impacts."""
    s = F.upper(F.trim(severity))
    high = F.size(F.split(s, ":H")) - 1
    by_vector = F.when(high >= 3, 9.0).when(high >= 1, 7.0).otherwise(5.0)
    return F.when(s == "CRITICAL", 9.5).when(s == "HIGH", 7.5).when(s.isin("MEDIUM", "MODERATE"), 5.0).when(s == "LOW", 2.5).when(s.startswith("CVSS"), by_vector).otherwise(0.0)
