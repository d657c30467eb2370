"""Counts, lookups and one-step patterns of the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import wildcard


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count(F.lit(1)).alias("count"))


def edge_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges per type whose both ends are known."""
    return _ends(nodes, edges).groupBy("edge_type").agg(F.count(F.lit(1)).alias("count"))


def schema_connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return _ends(nodes, edges).groupBy("from_label", "to_label", "edge_type").agg(F.count(F.lit(1)).alias("count"))


def _ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    a = nodes.select(F.col("id").alias("src"), F.col("label").alias("from_label"))
    b = nodes.select(F.col("id").alias("dst"), F.col("label").alias("to_label"))
    return edges.select("src", "dst", "edge_type").join(a, "src").join(b, "dst")


def project_totals(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("project_id").agg(F.count(F.lit(1)).alias("nodes"))


def projects_list(nodes: DataFrame) -> DataFrame:
    files = nodes.where("label = 'File'").groupBy("project_id").agg(F.count(F.lit(1)).alias("file_count"))
    return nodes.where("label = 'Project'").select("project_id", "name").join(files, "project_id", "left").select("project_id", "name", F.coalesce("file_count", F.lit(0)).alias("file_count"))


def find_symbol(nodes: DataFrame, symbol: str, limit: int = 25) -> DataFrame:
    """Best matches first: exact name, name, last segments, start of a signature; a wider pass only counts if none fits.

    One scan ranks all forms; the wider form is kept only where no better one exists.
    """
    fq, name = F.col("fq_name"), F.col("name")
    rank = F.when(fq == symbol, 0).when(name == symbol, 1).when(fq.endswith("." + symbol), 2).when(fq.startswith(symbol + "("), 3)
    if "." in symbol:
        rank = rank.when(fq.contains("." + symbol + "("), 4)
    hits = nodes.withColumn("rank", rank).where("rank is not null")
    top = hits.orderBy("rank", "fq_name", "id").limit(limit)
    fast = F.min(F.col("rank")).over(Window.partitionBy())  # over at most ``limit`` rows
    return top.withColumn("best", fast).where("rank < 4 OR best = 4").select("label", "fq_name", "name", "id", "start_line", "file_id")


def search_by_name(nodes: DataFrame, query: str, label: str | None = None, limit: int = 50) -> DataFrame:
    hits = nodes.where(wildcard(F.col("name"), query) | wildcard(F.col("fq_name"), query))
    if label:
        hits = hits.where(F.col("label") == label)
    return hits.select("label", "fq_name", "name", "id").orderBy("fq_name", "id").limit(limit)


def callers(nodes: DataFrame, edges: DataFrame, node_id: str, limit: int = 100) -> DataFrame:
    """Methods that call a node."""
    return _step(nodes, edges.where(F.col("dst") == node_id).withColumn("id", F.col("src")), limit)


def callees(nodes: DataFrame, edges: DataFrame, node_id: str, limit: int = 100) -> DataFrame:
    return _step(nodes, edges.where(F.col("src") == node_id).withColumn("id", F.col("dst")), limit)


def _step(nodes: DataFrame, near: DataFrame, limit: int) -> DataFrame:
    hits = near.where("edge_type = 'CALLS'").select("id", "call_site_line").join(nodes.where("label = 'Method'"), "id")
    return hits.select("fq_name", "name", "call_site_line", "id").orderBy("fq_name", "id").limit(limit)


def neighbours(nodes: DataFrame, edges: DataFrame, node_id: str, edge_type: str, outward: bool = True) -> DataFrame:
    """Nodes one edge of a type away: contained, referencing, importing and so on."""
    here, there = ("src", "dst") if outward else ("dst", "src")
    near = edges.where((F.col("edge_type") == edge_type) & (F.col(here) == node_id)).select(F.col(there).alias("id")).distinct()
    return nodes.join(near, "id").select("label", "fq_name", "file_id", "start_line", "path", "id")


def bulk_caller_counts(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, callers`` for every id asked for, zeros included; only methods count as callers."""
    near = edges.where("edge_type = 'CALLS'").join(ids.select(F.col("id").alias("dst")), "dst", "left_semi").join(nodes.where("label = 'Method'").select(F.col("id").alias("src")), "src", "left_semi")
    counts = near.groupBy(F.col("dst").alias("id")).agg(F.countDistinct("src").alias("callers"))
    return ids.join(counts, "id", "left").select("id", F.coalesce("callers", F.lit(0)).alias("callers"))


def bulk_callee_counts(edges: DataFrame, ids: DataFrame) -> DataFrame:
    near = edges.where("edge_type = 'CALLS'").join(ids.select(F.col("id").alias("src")), "src", "left_semi")
    counts = near.groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("callees"))
    return ids.join(counts, "id", "left").select("id", F.coalesce("callees", F.lit(0)).alias("callees"))


def bulk_contains(nodes: DataFrame, edges: DataFrame, ids: DataFrame, most: int = 200) -> DataFrame:
    """``container, label, fq_name, id``: the first ``most`` children of each container, by name."""
    kids = edges.where("edge_type = 'CONTAINS'").join(ids.select(F.col("id").alias("src")), "src", "left_semi").select(F.col("src").alias("container"), F.col("dst").alias("id"))
    w = Window.partitionBy("container").orderBy("fq_name", "id")
    return nodes.select("id", "label", "fq_name").join(kids, "id").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("container", "label", "fq_name", "id")


def bulk_files(nodes: DataFrame, paths: list[str]) -> DataFrame:
    return nodes.where((F.col("label") == "File") & F.col("path").isin(paths)).select("path", "id", "language")


def call_graph_hubs(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """Methods with the most calls in and out: ``fq_name, out_deg, in_deg, total``."""
    c = edges.where("edge_type = 'CALLS'")
    ends = c.select(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(c.select(F.col("dst").alias("id"), F.lit(0), F.lit(1)))
    deg = ends.groupBy("id").agg(F.sum("o").alias("out_deg"), F.sum("i").alias("in_deg"))
    named = nodes.where("label = 'Method' AND NOT startswith(fq_name, 'unresolved.')").select("id", "fq_name").join(deg, "id")
    return named.select("fq_name", "out_deg", "in_deg", (F.col("out_deg") + F.col("in_deg")).alias("total")).orderBy(F.col("total").desc(), "fq_name").limit(limit)


def nodes_by_id(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """The nodes of some ids; ids without a node give no row."""
    return nodes.where(F.col("id").isin(ids)).select("id", "label", "name", "fq_name", "path")


def file_of(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, path`` of the file that each of the nodes (column ``id``) lies in; those without a file are left out."""
    files = nodes.where("label = 'File'").select(F.col("id").alias("file_id"), "path")
    return nodes.join(ids.select("id").distinct(), "id", "left_semi").select("id", "file_id").join(files, "file_id").select("id", "path")


def is_empty(nodes: DataFrame) -> bool:
    return nodes.isEmpty()


def graph_health(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per project ``project_id, files, nodes, edges, last_ingested_at``; an edge belongs to the project of its source."""
    per = nodes.groupBy("project_id").agg(F.count_if(F.col("label") == "File").alias("files"), F.count(F.lit(1)).alias("nodes"), F.max("last_ingested_at").alias("last_ingested_at"))
    lines = edges.select(F.col("src").alias("id")).join(nodes.select("id", "project_id"), "id").groupBy("project_id").agg(F.count(F.lit(1)).alias("edges"))
    return per.join(lines, "project_id", "left").select("project_id", "files", "nodes", F.coalesce("edges", F.lit(0).cast("bigint")).alias("edges"), "last_ingested_at")


def doctor(nodes: DataFrame, edges: DataFrame, labels: list[str]) -> DataFrame:
    """``check, found``: what is wrong with a graph, by kind: loose edge ends, repeated ids, unknown labels, members of no project."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    loose = ends.join(nodes.select("id"), "id", "left_anti").agg(F.count(F.lit(1)).alias("found"))
    again = nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("found"))
    own = nodes.agg(F.count_if(~F.col("label").isin(labels)).alias("unknown_labels"), F.count_if(F.col("project_id").isNull()).alias("no_project"))
    flat = own.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("found")) for c in ("unknown_labels", "no_project")])).alias("x")).select("x.*")
    return loose.select(F.lit("loose_edge_ends").alias("check"), "found").unionByName(again.select(F.lit("repeated_ids").alias("check"), "found")).unionByName(flat)


def rename_sites(nodes: DataFrame, edges: DataFrame, node_id: str) -> DataFrame:
    """``site, label, fq_name, file_id, line``: the definition of a symbol and all that names it, which a rename has to change."""
    own = nodes.where(F.col("id") == node_id).select(F.lit("definition").alias("site"), "label", "fq_name", "file_id", F.col("start_line").alias("line"))
    uses = edges.where((F.col("dst") == node_id) & F.col("edge_type").isin("CALLS", "REFERENCES", "IMPORTS", "EXTENDS", "IMPLEMENTS", "HANDLES"))
    named = uses.select(F.col("src").alias("id"), F.lower("edge_type").alias("site"), "call_site_line").join(nodes.select("id", "label", "fq_name", "file_id", "start_line"), "id")
    return own.unionByName(named.select("site", "label", "fq_name", "file_id", F.coalesce("call_site_line", "start_line").alias("line")))
