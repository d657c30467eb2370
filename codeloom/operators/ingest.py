"""From events to the graph: merging, resolving, removing, comparing; each step is a set operation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import last_segment
from codeloom.model import SCANNED_LABELS


def merged(events: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: for every column the last value that is not null (later events do not clobber with nothing)."""
    rest = [c for c in events.columns if c not in (*keys, order)]
    return events.groupBy(*keys).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest])


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows with the new ones merged in; columns that are null in the new row keep their old value."""
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_n_{c}") for c in rest if c in new.columns])
    return old.join(n, keys, "full").select(*keys, *[(F.coalesce(f"_n_{c}", c) if c in new.columns else F.col(c)).alias(c) for c in rest])


def changed_only(new: DataFrame, old: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """New rows whose digest is not the stored one: what a re-scan has to write."""
    return new.join(old.select(*keys, digest), [*keys, digest], "left_anti")


def without(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ids in ``gone`` (column ``id``): edges go with either end."""
    kept = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone.select("id"), "id", "left_anti"), kept.select(edges.columns)


def stale_ids(nodes: DataFrame, alive: DataFrame, labels: list[str] = SCANNED_LABELS) -> DataFrame:
    """Ids of scan-managed labels that no file yields any more."""
    return nodes.where(F.col("label").isin(labels)).join(alive.select("id"), "id", "left_anti").select("id")


def orphan_projects(nodes: DataFrame, registry: DataFrame) -> DataFrame:
    return nodes.select("project_id").distinct().join(registry.select("project_id"), "project_id", "left_anti")


def is_placeholder(fq_name: Column) -> Column:
    return fq_name.startswith("unresolved.") & fq_name.contains(":")


def resolutions(nodes: DataFrame) -> DataFrame:
    """``placeholder, target``: unresolved calls whose name and arity fit exactly one method."""
    m = nodes.where("label = 'Method'") if "label" in nodes.columns else nodes
    holes = m.where(is_placeholder(F.col("fq_name"))).select(F.col("id").alias("placeholder"), "name", F.expr("try_cast(element_at(split(fq_name, ':'), -1) AS BIGINT)").alias("arity")).where("arity is not null")
    real = m.where(~F.col("fq_name").startswith("unresolved.")).groupBy("name", F.coalesce("param_count", F.lit(0)).alias("arity")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("target")).where("n = 1")
    return holes.join(real, ["name", "arity"]).select("placeholder", "target")


def resolved_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls with placeholders replaced; a replaced call gains 0.2 confidence, equal calls become one."""
    r = resolutions(nodes).select(F.col("placeholder").alias("dst"), "target")
    e = edges.join(r, "dst", "left").select("src", F.coalesce("target", "dst").alias("dst"), F.when(F.col("target").isNotNull(), F.coalesce("confidence", F.lit(0.5)) + 0.2).otherwise(F.col("confidence")).alias("confidence"))
    return e.groupBy("src", "dst").agg(F.max("confidence").alias("confidence"))


def unused_placeholders(nodes: DataFrame, calls: DataFrame) -> DataFrame:
    return nodes.where(is_placeholder(F.col("fq_name"))).join(calls.select(F.col("dst").alias("id")), "id", "left_anti").select("id", "fq_name")


def resolved_handlers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """HANDLES edges for endpoints that only name their view: to every method of that name."""
    done = edges.where("edge_type = 'HANDLES'").select(F.col("src").alias("id"))
    ends = nodes.where("label = 'ApiEndpoint' AND view_ref IS NOT NULL").select("id", last_segment(F.col("view_ref")).alias("name")).join(done, "id", "left_anti")
    methods = nodes.where("label = 'Method'").select("name", F.col("id").alias("dst"))
    return ends.join(methods, "name").select(F.col("id").alias("src"), "dst")


def diff_rows(old: DataFrame, new: DataFrame, keys: list[str], values: list[str] = ()) -> DataFrame:
    """``<keys>, change``: rows added, removed, or changed in ``values``."""
    a = old.select(*keys, F.struct(F.lit(1).alias("_"), *values).alias("o")).dropDuplicates(keys)
    b = new.select(*keys, F.struct(F.lit(1).alias("_"), *values).alias("n")).dropDuplicates(keys)
    change = F.when(F.col("o").isNull(), "added").when(F.col("n").isNull(), "removed").when(F.col("o") != F.col("n"), "changed")
    return a.join(b, keys, "full").select(*keys, change.alias("change")).where("change is not null")
