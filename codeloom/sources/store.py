"""The stored graph: nodes in parts by label, edges by type, versioned so that a write never disturbs a reader.

A change writes only the parts it touches; the file ``CURRENT`` names the parts that count, and is replaced last,
as a whole.
"""

from __future__ import annotations

import json
import uuid
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from codeloom.operators.ingest import upserted, without
from codeloom.operators.traverse import closure
from codeloom.util import drop_written, get_text, hadoop_path, put_text, scope, shared_dir, written

_BY = {"nodes": "label", "edges": "edge_type"}


class GraphStore:
    """A graph in a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    # -------------------------------------------------- versions
    def current(self) -> dict | None:
        """The version that counts: the files of its parts, and the schemas of its tables."""
        said = get_text(self.spark, f"{self.path}/CURRENT")
        return json.loads(said) if said else None

    def save(self, nodes: DataFrame, edges: DataFrame) -> GraphStore:
        """Write a whole new version (the bulk load)."""
        return self._next({"nodes": (nodes, None), "edges": (edges, None)})

    def _next(self, changed: dict[str, tuple[DataFrame, list[str] | None]]) -> GraphStore:
        """A version in which the named parts of the tables (all of them for None) are new and the others as they were.

        ``CURRENT`` is replaced when all is written.  The parts it named before stay for the readers of one
        version more, then they are deleted.
        """
        old, version = self.current() or {"parts": {}, "gone": []}, uuid.uuid4().hex
        entry = {"parts": dict(old["parts"]), "schemas": dict(old.get("schemas", {})), "gone": [], "version": version}
        for what, (df, names) in changed.items():
            base = f"{self.path}/{version}/{what}"
            df.write.partitionBy(_BY[what]).parquet(base)
            known = entry["parts"].get(what, {})
            fresh = {name: [f"{base}/{folder}"] for name, folder in self._folders(base)}
            gone = known if names is None else {k: v for k, v in known.items() if k in names}
            entry["parts"][what] = {k: v for k, v in known.items() if k not in gone} | fresh
            entry["gone"] += [p for v in gone.values() for p in v]
            entry["schemas"][what] = df.schema.jsonValue()
        put_text(self.spark, f"{self.path}/CURRENT", json.dumps(entry))
        drop_written(self.spark, *old["gone"])
        return self

    def _folders(self, base: str) -> list[tuple[str, str]]:
        """(part, folder) of what a write by parts left."""
        fs, target = hadoop_path(self.spark, base)
        names = [x.getPath().getName() for x in fs.listStatus(target) if x.isDirectory()]
        return [(unquote(n.split("=", 1)[1]), n) for n in names if "=" in n]

    def _read(self, what: str, names: list[str] | None = None) -> DataFrame:
        entry = self.current()
        schema, by = StructType.fromJson(entry["schemas"][what]), _BY[what]
        parts = {k: v for k, v in entry["parts"].get(what, {}).items() if names is None or k in names}
        if not parts:
            return self.spark.createDataFrame([], schema)
        inner = StructType([f for f in schema if f.name != by])
        out = None
        bases: dict[str, list[str]] = {}
        for paths in parts.values():
            for p in paths:
                bases.setdefault(p.rsplit("/", 1)[0], []).append(p)
        for base, paths in bases.items():  # one scan a version that parts lie in
            part = self.spark.read.option("basePath", base).schema(StructType([*inner, schema[by]])).parquet(*paths)
            out = part if out is None else out.unionByName(part)
        return out.select(*schema.names)

    @property
    def nodes(self) -> DataFrame:
        return self._read("nodes")

    @property
    def edges(self) -> DataFrame:
        return self._read("edges")

    # -------------------------------------------------- changes
    def _names(self, df: DataFrame, what: str) -> list[str]:
        return ["__HIVE_DEFAULT_PARTITION__" if r[0] is None else r[0] for r in df.select(_BY[what]).distinct().collect()]  # labels or types

    def merge(self, nodes: DataFrame, edges: DataFrame) -> GraphStore:
        """Upsert: columns that are null in a new row keep their stored value; an edge is one per (src, type, dst).

        Only the parts (labels, types) that new rows belong to are written.
        """
        changed = {}
        for what, df, keys in (("nodes", nodes, ["id"]), ("edges", edges, ["src", "edge_type", "dst"])):
            names = self._names(df, what)
            if names:
                changed[what] = (upserted(self._read(what, names), df, keys), names)
        return self._next(changed) if changed else self

    def remove(self, gone: DataFrame) -> GraphStore:
        """Remove nodes (column ``id``) and the edges at them; only parts that lose something are written."""
        gone, at = written(gone.select("id").distinct(), "gone")
        changed = {}
        names = self._names(self.nodes.join(gone, "id", "left_semi"), "nodes")
        if names:
            changed["nodes"] = (self._read("nodes", names).join(gone, "id", "left_anti"), names)
        ends = [F.col(c).alias("id") for c in ("src", "dst")]
        touched = self.edges.select("edge_type", ends[0]).unionAll(self.edges.select("edge_type", ends[1])).join(gone, "id", "left_semi")
        names = self._names(touched, "edges")
        if names:
            kept = without(self.nodes, self._read("edges", names), gone)[1]
            changed["edges"] = (kept, names)
        if changed:
            self._next(changed)
        drop_written(self.spark, at)
        return self

    def remove_project(self, project_id: str) -> int:
        """Remove a project; how many nodes it had."""
        own = self.nodes.where(F.col("project_id") == project_id).select("id")
        n = own.count()
        self.remove(own)
        return n

    def remove_files(self, project_id: str, paths: DataFrame) -> GraphStore:
        """Remove files (column ``path``) and all they contain, however deep, in one change."""
        own = self.nodes.where((F.col("project_id") == project_id) & (F.col("label") == "File"))
        files, at = written(own.join(paths.select("path").distinct(), "path", "left_semi").select(F.lit("").alias("source"), F.col("id").alias("node")), "files")
        with scope(self.spark):
            inside = closure(self.edges, files).select(F.col("node").alias("id"))
            self.remove(inside.unionByName(files.select(F.col("node").alias("id"))))
        drop_written(self.spark, at)
        return self

    def remove_file(self, project_id: str, path: str) -> GraphStore:
        """Remove a file and all it contains."""
        return self.remove_files(project_id, self.spark.createDataFrame([(path,)], "path string"))


def scratch(spark: SparkSession) -> GraphStore:
    """A store of its own in the shared folder."""
    return GraphStore(spark, f"{shared_dir(spark)}/codeloom/graph-{uuid.uuid4().hex}")
