"""Architecture rules: built-in and custom ones, layered settings, a report in one plan."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import excluded
from codeloom.operators import analytics
from codeloom.operators.traverse import longest_chain

_VIOLATION = "rule string, severity string, subject string, message string, file_id string, line bigint"
#: A rule plugin gives rows ``subject, message, file_id, line``.
Plugin = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass
class Custom:
    """A user's rule: SQL over the views ``nodes`` and ``edges`` with columns subject (or fq_name), message, file_id, line."""

    name: str
    query: str
    severity: str = "WARN"
    enabled: bool = True


@dataclass
class Config:
    """Settings of one layer; :meth:`over` lays it on another."""

    thresholds: dict[str, int] = field(default_factory=dict)
    disabled: set[str] = field(default_factory=set)
    exclude: list[str] = field(default_factory=list)
    custom: list[Custom] = field(default_factory=list)
    #: Most rows of a rule that are reported, after exclusions; none or no entry: all.
    most: dict[str, int | None] = field(default_factory=dict)

    def over(self, base: Config) -> Config:
        """Thresholds overwrite, disabled rules and exclusions add up, custom rules replace those of their name."""
        mine = {c.name for c in self.custom}
        return Config(base.thresholds | self.thresholds, base.disabled | self.disabled, [*dict.fromkeys([*base.exclude, *self.exclude])], [c for c in base.custom if c.name not in mine] + self.custom, base.most | self.most)

    @staticmethod
    def of(raw: dict | None) -> Config:
        """From parsed YAML."""
        raw = raw or {}
        custom = [Custom(c.get("name", ""), c.get("query", ""), str(c.get("severity") or "WARN").upper(), c.get("enabled", True)) for c in raw.get("custom") or []]
        return Config({k: int(v) for k, v in (raw.get("thresholds") or {}).items()}, set(raw.get("disabled") or []), list(raw.get("exclude") or []), custom, dict(raw.get("most") or {}))


DEFAULTS = Config({"god-file": analytics.GOD_FILE, "god-class": analytics.GOD_CLASS, "long-method": analytics.LONG_METHOD, "deep-inheritance": analytics.DEEP}, most={"dead-code": 500})


def resolved(*layers: Config) -> Config:
    """Defaults, then each layer on top."""
    return reduce(lambda base, layer: layer.over(base), layers, DEFAULTS)


def _rows(df: DataFrame, subject: str, message, line: str | None = None, file_id: str | None = "file_id") -> DataFrame:
    return df.select(F.col(subject).alias("subject"), message.alias("message"), (F.col(file_id) if file_id else F.lit(None)).cast("string").alias("file_id"), (F.col(line) if line else F.lit(None)).cast("bigint").alias("line"))


def _deep(nodes: DataFrame, edges: DataFrame, least: int) -> DataFrame:
    chains = longest_chain(edges, "EXTENDS").where(F.col("depth") >= least).select(F.col("node").alias("id"), "depth")
    return nodes.where("label = 'Class'").join(chains, "id").select("fq_name", "file_id", "depth")


BUILT_IN: dict[str, tuple[str, bool, Callable]] = {
    "god-file": ("ERROR", True, lambda n, e, t: _rows(analytics.god_files(n, e, t), "path", F.concat(F.col("methods").cast("string"), F.lit(f" methods, limit {t}")))),
    "god-class": ("ERROR", True, lambda n, e, t: _rows(analytics.god_classes(n, e, t), "fq_name", F.concat(F.col("methods").cast("string"), F.lit(f" methods, limit {t}")))),
    "long-method": ("WARN", True, lambda n, e, t: _rows(analytics.long_methods(n, t), "fq_name", F.concat(F.col("lines").cast("string"), F.lit(f" lines, limit {t}")), "start_line")),
    "deep-inheritance": ("WARN", False, lambda n, e, t: _rows(_deep(n, e, t), "fq_name", F.concat(F.col("depth").cast("string"), F.lit(f" levels, limit {t}")))),
    "dead-code": ("WARN", True, lambda n, e, t: _rows(analytics.dead_code(n, e, spare_handlers=True), "fq_name", F.lit("nothing calls it"), "start_line")),
}


def violations(nodes: DataFrame, edges: DataFrame, config: Config = DEFAULTS, plugins: dict[str, Plugin] | None = None) -> DataFrame:
    """All violations of the enabled rules, without those in excluded paths."""
    parts = []
    paths = nodes.where("label = 'File'").select(F.col("id").alias("file_id"), "path")
    for name, (severity, by_path, run) in BUILT_IN.items():
        if name not in config.disabled:
            rows = run(nodes, edges, config.thresholds.get(name))
            if by_path and config.exclude:
                rows = rows.join(paths, "file_id", "left").where(~excluded(F.col("path"), config.exclude)).drop("path")
            if config.most.get(name):
                rows = rows.orderBy("subject").limit(config.most[name])
            parts.append(rows.select(F.lit(name).alias("rule"), F.lit(severity).alias("severity"), "subject", "message", "file_id", "line"))
    for rule in config.custom:
        if rule.enabled and rule.name.strip() and rule.query.strip() and rule.name not in config.disabled:
            parts.append(_custom(nodes, edges, rule))
    for name, plugin in (plugins or {}).items():
        parts.append(plugin(nodes, edges).select(F.lit(name).alias("rule"), F.lit("WARN").alias("severity"), "subject", "message", "file_id", "line"))
    return reduce(DataFrame.unionByName, parts) if parts else nodes.sparkSession.createDataFrame([], _VIOLATION)


def _custom(nodes: DataFrame, edges: DataFrame, rule: Custom) -> DataFrame:
    rows = nodes.sparkSession.sql(rule.query, nodes=nodes, edges=edges) if "{nodes}" in rule.query or "{edges}" in rule.query else _cypher(nodes, edges, rule.query)
    c = {x.lower().replace("_", ""): x for x in rows.columns}
    pick = lambda *names, kind="string": next((F.col(c[n]) for n in names if n in c), F.lit(None)).cast(kind)
    return rows.select(F.lit(rule.name).alias("rule"), F.lit(rule.severity).alias("severity"), pick("subject", "fqname").alias("subject"), F.coalesce(pick("message"), F.lit(rule.name)).alias("message"), pick("fileid").alias("file_id"), pick("line", "startline", kind="bigint").alias("line"))


def _cypher(nodes: DataFrame, edges: DataFrame, text: str) -> DataFrame:
    from codeloom.plans.cypher import run

    return run(text, nodes, edges)


def severity_totals(found: DataFrame) -> DataFrame:
    """``severity, count`` with the severities that have none."""
    domain = found.sparkSession.createDataFrame([("ERROR",), ("WARN",), ("INFO",)], "severity string")
    counts = found.groupBy("severity").agg(F.count(F.lit(1)).alias("count"))
    return domain.join(counts, "severity", "left").select("severity", F.coalesce("count", F.lit(0)).alias("count"))


def guard_exit(found: DataFrame, fail_on_warn: bool = False) -> int:
    """1 if a violation is an error (or a warning, if these fail as well), else 0."""
    bad = ["ERROR", "WARN"] if fail_on_warn else ["ERROR"]
    return int(not found.where(F.col("severity").isin(bad)).isEmpty())
