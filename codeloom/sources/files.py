"""Source trees as tables: scanning, change detection, parsing to graph events, and the graph from events."""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import slashes
from codeloom.model import EDGE, NODE, coerced, content_hash, node_id, shaped
from codeloom.operators.ingest import merged
from codeloom.sources.parsers import REGISTRY, parse_file
from codeloom.util import spread

# Directories that are never scanned.
IGNORED = "target build out dist .next .nuxt .cache .turbo .svelte-kit node_modules vendor bower_components coverage __pycache__ .tox .pytest_cache .gradle .idea .vscode .angular .git".split()
EVENT = "path string, op string, label string, fq_name string, edge_type string, to_label string, to_fq_name string, props map<string,string>, seq bigint"


def scan_files(spark: SparkSession, root: str, ignored: list[str] = IGNORED) -> DataFrame:
    """``path, content, content_hash`` of the files under ``root`` that some parser reads; paths are relative."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    whole = slashes(F.regexp_replace("path", r"^file:/*", "/"))
    rel = F.regexp_replace(whole, "^" + re.escape(base.removeprefix("file://")) + "/", "")
    parts = F.slice(F.split(rel, "/"), F.lit(1), F.greatest(F.size(F.split(rel, "/")) - 1, F.lit(0)))
    endings = [e for _, names, _ in REGISTRY for e in names]
    name = F.lower(F.element_at(F.split(rel, "/"), -1))
    known = name.isin(endings) | F.element_at(F.split(name, r"\."), -1).isin(endings) | F.startswith(name, F.lit("dockerfile."))
    kept = files.where(~F.arrays_overlap(parts, F.array(*map(F.lit, ignored))) & ~F.contains(rel, F.lit("/resources/static/")) & known)
    return kept.select(rel.alias("path"), F.decode("content", "utf-8").alias("content"), F.substring(F.sha2("content", 256), 1, 16).alias("content_hash"))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files whose (path, hash) is not among the known ones."""
    return files.join(known.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def git_changes(root: str, since: str) -> tuple[list[str], list[str]]:
    """Paths changed and paths deleted since a commit."""

    def paths(kinds: str) -> list[str]:
        run = subprocess.run(["git", "-C", root, "diff", "--name-only", f"--diff-filter={kinds}", since, "HEAD"], capture_output=True, text=True, check=True)
        return run.stdout.split("\n")[:-1]

    return paths("ACMRT"), paths("D")


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.schema([("path", pa.string()), ("op", pa.string()), ("label", pa.string()), ("fq_name", pa.string()), ("edge_type", pa.string()), ("to_label", pa.string()), ("to_fq_name", pa.string()), ("props", pa.map_(pa.string(), pa.string())), ("seq", pa.int64())])
    for b in batches:
        for path, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            events = parse_file(path, text or "")
            if events:
                yield pa.RecordBatch.from_pylist([e | {"path": path, "seq": i, "props": list(e["props"].items())} for i, e in enumerate(events)], kind)


def parsed(files: DataFrame) -> DataFrame:
    """Graph events of the files (columns ``path, content``)."""
    return spread(files.select("path", "content")).mapInArrow(_parse, EVENT)


def graph_of(events: DataFrame, project_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges from events: of each property the last value that is not null; edges are one per (src, type, dst)."""
    p = F.lit(project_id)
    name = lambda label, fq: F.when(label == "Project", p).otherwise(fq)
    ident = lambda label, fq: node_id(p, label, name(label, fq))
    at = F.struct("path", "seq")
    nodes = events.where("op = 'node'").withColumn("fq_name", name(F.col("label"), F.col("fq_name")))
    props = [(f.name, coerced(F.element_at("props", f.name), f.dataType)) for f in NODE if f.name not in ("id", "project_id", "label", "fq_name", "extra", "file_id", "table_id", "content_hash")]
    flat = nodes.select(
        ident(F.col("label"), F.col("fq_name")).alias("id"), p.alias("project_id"), "label", "fq_name", *[v.alias(n) for n, v in props], at.alias("at"),
        F.when(F.col("props").getItem("file_ref").isNotNull(), ident(F.lit("File"), F.col("props").getItem("file_ref"))).alias("file_id"),
        F.when(F.col("props").getItem("table_ref").isNotNull(), ident(F.lit("Table"), F.col("props").getItem("table_ref"))).alias("table_id"),
        content_hash(F.col("label"), F.col("fq_name"), F.col("props")).alias("content_hash"),
        F.map_filter("props", lambda k, v: ~k.isin([n for n, _ in props])).alias("extra"),
    )
    e = events.where("op = 'edge'")
    edges = e.select(p.alias("project_id"), "edge_type", ident(F.col("label"), F.col("fq_name")).alias("src"), ident(F.col("to_label"), F.col("to_fq_name")).alias("dst"), F.element_at("props", "confidence").try_cast("double").alias("confidence"), F.element_at("props", "call_site_line").try_cast("bigint").alias("call_site_line"), at.alias("at"))
    return shaped(merged(flat, ["id"], "at"), NODE), shaped(merged(edges, ["project_id", "edge_type", "src", "dst"], "at"), EDGE)


def scanned(spark: SparkSession, root: str, project_id: str) -> tuple[DataFrame, DataFrame]:
    """The graph of a source tree."""
    return graph_of(parsed(scan_files(spark, root)), project_id)


def files_at(spark: SparkSession, root: str, commit: str, ignored: list[str] = IGNORED) -> DataFrame:
    """``path, content, content_hash`` of the files of a commit that some parser reads; ``root`` is a repository all executors see.

    The paths are spread over the executors, which read their contents from the repository; no tree is checked out.
    """
    run = subprocess.run(["git", "-C", root, "ls-tree", "-r", "-z", "--name-only", commit], capture_output=True, text=True, check=True)
    names = [(p,) for p in run.stdout.split("\0") if p and not set(p.split("/")[:-1]) & set(ignored)]
    endings = {e for _, ends, _ in REGISTRY for e in ends}
    known = [p for p in names if (n := p[0].lower().rsplit("/", 1)[-1]) in endings or n.rsplit(".", 1)[-1] in endings or n.startswith("dockerfile.")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [subprocess.run(["git", "-C", root, "show", f"{commit}:{p}"], capture_output=True, check=True).stdout.decode("utf-8", "replace") for p in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["path", "content"])

    paths = spread(spark.createDataFrame(known, "path string"))
    return paths.mapInArrow(read, "path string, content string").withColumn("content_hash", F.substring(F.sha2("content", 256), 1, 16))


def snapshot_at(spark: SparkSession, root: str, project_id: str, commit: str) -> tuple[DataFrame, DataFrame]:
    """The graph of a source tree as it was at a commit, under a project of its own (the id and the commit's first 12 digits)."""
    return graph_of(parsed(files_at(spark, root, commit)), f"{project_id}__sha_{commit[:12]}")
