"""Written reports from bounded summaries, and a cache of results keyed by the graph's version."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame

from codeloom.operators import analytics
from codeloom.sources.store import GraphStore
from codeloom.util import drop_written, written


def markdown_table(df: DataFrame, most: int = 50) -> str:
    """At most ``most`` rows as a Markdown table."""
    rows = df.limit(most).collect()
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|")
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(map(cell, r)) + " |" for r in rows]])


def changelog(nodes: DataFrame, since, most: int = 50) -> str:
    """New and changed nodes by label, the label with the newest first, with a note on what is left out."""
    groups: dict[str, list] = {}
    for r in analytics.changelog(nodes, since, most).collect():  # at most ``most`` a label
        groups.setdefault(r["label"], []).append(r)
    out = ["# Changelog", ""]
    for label, rows in sorted(groups.items(), key=lambda g: (-max(r["last_ingested_at"].timestamp() for r in g[1]), g[0])):
        rows.sort(key=lambda r: (-r["last_ingested_at"].timestamp(), r["fq_name"]))
        out += [f"## {label} ({rows[0]['total']})", "", *[f"- `{r['fq_name']}`" for r in rows], *([f"- … {rows[0]['total'] - len(rows)} more"] if rows[0]["total"] > len(rows) else []), ""]
    return "\n".join(out)


def badges(text: str, values: dict[str, str]) -> str:
    """A document with what stands between ``<!-- badge:NAME -->`` and ``<!-- /badge -->`` replaced."""
    return re.sub(r"(<!-- badge:(\w+) -->).*?(<!-- /badge -->)", lambda m: m[1] + values.get(m[2], "") + m[3], text, flags=re.S)


def guard_badge(nodes: DataFrame, edges: DataFrame) -> str:
    row = analytics.guard_summary(nodes, edges).first()
    return f"guard: {'passing' if row['passed'] else 'failing'} ({row['errors']} errors, {row['warnings']} warnings)"


class ResultCache:
    """Results of a store's queries as written tables, for ``seconds`` each; a new version of the graph makes them all void."""

    def __init__(self, store: GraphStore, most: int = 4096, seconds: float = 30) -> None:
        self.store, self.most, self.seconds, self.version = store, most, seconds, None
        self.kept: dict[tuple, tuple[DataFrame, str]] = {}
        self.since: dict[tuple, float] = {}

    def warm(self, queries: dict[tuple, Callable[[DataFrame, DataFrame], DataFrame]]) -> None:
        """Compute results before they are asked for."""
        for key, compute in queries.items():
            self.get(key, compute)

    def get(self, key: tuple, compute: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        version = self.store.current()["version"]
        if version != self.version:
            self.clear()
            self.version = version
        if key in self.kept and time.monotonic() - self.since[key] > self.seconds:
            drop_written(self.store.spark, self.kept.pop(key)[1])
        if key not in self.kept:
            if len(self.kept) >= self.most:  # the oldest quarter goes
                for old in list(self.kept)[: max(1, self.most // 4)]:
                    drop_written(self.store.spark, self.kept.pop(old)[1])
            self.since[key] = time.monotonic()
            self.kept[key] = written(compute(self.store.nodes, self.store.edges), "result")
        return self.kept[key][0]

    def clear(self) -> None:
        for _, path in self.kept.values():
            drop_written(self.store.spark, path)
        self.kept.clear()
