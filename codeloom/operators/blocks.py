"""Graphs as numpy blocks: nodes are numbers, a block holds all edges of a range of nodes, one value a node lies in a file.

The number of a node is the place of its name's hash among the sorted hashes; two names with one hash are noticed.
The files lie in the shared folder and are mapped by the workers that read them, so that neither the driver nor a
task gathers edges.  All this serves graphs whose values of 8 bytes a node fit a worker (``MOST_NODES``) in a shared
folder of a file system; callers join DataFrames otherwise.
"""

from __future__ import annotations

import glob
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.util import _KEPT, drop_written, hadoop_path, lookup, shared_dir, written

#: Nodes up to which a worker maps and holds values of all of them.
MOST_NODES = 32 << 20
#: Edges in a block, about.
BLOCK_EDGES = 1 << 20
_LOW = (1 << 32) - 1
_BLOCK = "part int, keys binary, weights binary"


def folder(spark: SparkSession) -> str | None:
    """A new folder for files of values; None where the shared folder is no file system's."""
    fs, root = hadoop_path(spark, shared_dir(spark))
    if fs.getScheme() != "file":
        return None
    path = f"{root.toUri().getPath()}/codeloom/values-{uuid.uuid4().hex}"
    os.makedirs(path)
    _KEPT[f"file://{path}"] = spark
    return path


def new_values(path: str, n: int, kind: str) -> np.ndarray:
    return np.memmap(path, kind, "w+", shape=(max(1, n),))


def values(path: str, kind: str, mode: str = "r") -> np.ndarray:
    return np.memmap(path, kind, mode)


def column(batch: pa.RecordBatch, i: int, kind=None) -> np.ndarray:
    c = batch.column(i)
    return (c if kind is None else c.cast(kind)).to_numpy(zero_copy_only=False)


def numbered(names: DataFrame, at: str) -> int | None:
    """The number of distinct ``names`` (one column ``name``, unique), with their sorted hashes in ``at``; None if two have one hash or there are too many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [column(b, 0) for b in batches]
        n = sum(map(len, got))
        if n:
            path = f"{at}/part-{uuid.uuid4().hex}"
            np.concatenate(got).tofile(path)
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "n": pa.array([n], pa.int64())})

    parts = names.select(F.xxhash64("name").alias("h")).mapInArrow(run, "path string, n bigint").collect()  # one row a partition
    n = sum(r["n"] for r in parts)
    if n > MOST_NODES:
        return None
    # only what tasks report counts: a task that was run twice left a second file
    hashes = np.concatenate([np.fromfile(r["path"], np.int64) for r in parts]) if parts else np.zeros(0, np.int64)
    for path in glob.glob(f"{at}/part-*"):
        os.unlink(path)
    hashes.sort()
    if (hashes[1:] == hashes[:-1]).any():
        return None
    hashes.tofile(f"{at}/hashes") if n else None
    return n


def numbers_of(hashes: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Numbers of hashes, -1 for those of no node."""
    i = np.searchsorted(hashes, h)
    i[i == len(hashes)] = 0
    return np.where(hashes[i] == h, i, -1)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def keyed(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (u.astype(np.int64) << 32) | v.astype(np.int64)


def summed(keys: np.ndarray, w: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their weights (1 each without)."""
    if w is None:
        keys, w = np.unique(keys, return_counts=True)
        return keys, w.astype(float)
    order = np.argsort(keys)
    keys = keys[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.add.reduceat(w[order], starts) if len(keys) else w


def cut(keys: np.ndarray, w: np.ndarray | None, size: int) -> pa.RecordBatch:
    """Sorted keys as one row for each part of ``size`` first numbers."""
    parts = (keys >> 32) // size
    starts = np.flatnonzero(np.r_[True, parts[1:] != parts[:-1]]) if len(keys) else np.zeros(0, np.int64)
    ends = np.r_[starts[1:], len(keys)] if len(keys) else starts
    return pa.RecordBatch.from_pydict(
        {
            "part": pa.array(parts[starts], pa.int32()),
            "keys": pa.array([keys[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
            "weights": pa.array([b"" if w is None else w[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
        }
    )


def gathered(table: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    """The part, its distinct keys and their weights, from all rows of a part."""
    rows, weights = table.column("keys").to_pylist(), table.column("weights").to_pylist()
    keys = np.frombuffer(b"".join(rows), np.int64)
    return table.column("part")[0].as_py(), *summed(keys, np.frombuffer(b"".join(weights)) if weights[0] else None)


def merged(rows: DataFrame, at: str) -> list[tuple[int, str, str]]:
    """The distinct keys of each part in order with their weights (a byte each where these are small counts), in a file a part: part, path, kind of weights."""

    def run(table: pa.Table) -> pa.Table:
        part, keys, w = gathered(table)
        small, path = w.astype(np.uint8), f"{at}/block-{uuid.uuid4().hex}"
        kind = "u1" if (small == w).all() else "f8"
        keys.tofile(path)
        (small if kind == "u1" else w).tofile(f"{path}-w")
        return pa.table({"part": pa.array([part], pa.int32()), "path": pa.array([path]), "kind": pa.array([kind])})

    return sorted(tuple(r) for r in rows.groupBy("part").applyInArrow(run, "part int, path string, kind string").collect())  # one row a part


def blocks_of(batches: Iterator[pa.RecordBatch], files: list[tuple[int, str, str]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """``part, u, v, w`` of the files of :func:`merged`, by their places in the list."""
    for b in batches:
        for i in b.column(0).to_pylist():
            part, path, kind = files[i]
            k = np.fromfile(path, np.int64)
            yield part, k >> 32, k & _LOW, np.fromfile(f"{path}-w", kind)


def hashed_edges(edges: DataFrame, at: str, size: int) -> DataFrame:
    """Rows of parts with both directions of ``src, dst`` by their numbers; loops are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = values(f"{at}/hashes", "i8"), [], 0

        def flush() -> pa.RecordBatch:
            a, b = (numbers_of(hashes, np.concatenate(x)) for x in zip(*held))
            keys = keyed(np.concatenate([a, b]), np.concatenate([b, a]))
            keys.sort()
            return cut(keys, None, size)

        for batch in batches:
            if batch.num_rows:
                held.append((column(batch, 0), column(batch, 1)))
                n += batch.num_rows
            if n >= BLOCK_EDGES:
                yield flush()
                held, n = [], 0
        if held:
            yield flush()

    return edges.where("src <> dst").select(F.xxhash64("src").alias("s"), F.xxhash64("dst").alias("d")).mapInArrow(run, _BLOCK)


class Graph:
    """The undirected weights of ``src, dst`` (loops left out, parallel and opposite edges summed), both ways, as blocks."""

    def __init__(self, names: DataFrame, files: list[tuple[int, str, str]], at: str, n: int, size: int, two_m: float) -> None:
        self.names, self.files, self.at, self.n, self.size, self.two_m = names, files, at, n, size, two_m

    def mapped(self, run, schema: str) -> DataFrame:
        """What ``run`` makes of the blocks, some for each task."""
        spark = self.names.sparkSession
        return spark.range(0, len(self.files), 1, max(1, min(len(self.files), 4 * spark.sparkContext.defaultParallelism))).mapInArrow(run, schema)

    def sums(self, run, *names: str) -> list[float]:
        """Sums over the rows that ``run`` makes of the blocks, of one number a name."""
        out = self.mapped(run, ", ".join(f"{x} double" for x in names)).agg(*[F.sum(x) for x in names]).first()  # one row
        return [x or 0.0 for x in out]

    def coarser(self, to: np.ndarray, n: int) -> Graph:
        """The graph of groups: ``to`` has the group of each node, 0..``n``-1; edges within a group go from it to itself."""
        path, files, size = f"{self.at}/to-{uuid.uuid4().hex}", self.files, max(1, -(-n // max(1, -(-self.n // self.size))))
        to.astype(np.int32).tofile(path)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            into = values(path, "i4")
            for _, u, v, w in blocks_of(batches, files):
                yield cut(*summed(keyed(into[u], into[v]), w.astype(float)), size)

        fewer = merged(self.mapped(run, _BLOCK), self.at)
        os.unlink(path)
        return Graph(self.names, fewer, self.at, n, size, self.two_m)

    def drop_blocks(self) -> None:
        for _, path, _ in self.files:
            os.unlink(path), os.unlink(f"{path}-w")

    def named(self, group: np.ndarray) -> DataFrame:
        """``node, community`` from a number for each node; a community has the least name in it."""
        if not self.n:
            return self.names.select(F.col("name").alias("node"), F.col("name").alias("community"))
        path, hashes_at = f"{self.at}/group-{uuid.uuid4().hex}", f"{self.at}/hashes"
        group.astype(np.int32).tofile(path)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of, hashes = values(path, "i4"), values(hashes_at, "i8")
            for b in batches:
                yield pa.RecordBatch.from_pydict({"node": b.column(0), "_c": pa.array(of[numbers_of(hashes, column(b, 1))], pa.int32())})

        rows, _ = written(self.names.select("name", F.xxhash64("name").alias("h")).mapInArrow(run, "node string, _c int"), "grouped")
        least, _ = written(rows.groupBy("_c").agg(F.min("node").alias("community")), "communities")
        return lookup(rows, least, ["_c"], written_already=True).select("node", "community")

    def numbered(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` of strings, with the ``_number`` of the node that its column ``name`` names, -1 for none."""
        hashes_at, known = f"{self.at}/hashes", self.n > 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = values(hashes_at, "i8") if known else None
            for b in batches:
                h = column(b, b.num_columns - 1)
                i = numbers_of(hashes, h) if known else np.full(len(h), -1)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(i, pa.int32())], names=[*b.schema.names[:-1], "_number"])

        return df.select("*", F.xxhash64(name).alias("_h")).mapInArrow(run, ", ".join(f"`{c}` string" for c in df.columns) + ", _number int")

    def groups(self, member: DataFrame) -> tuple[np.ndarray, int]:
        """The group of each node by ``member`` (``node, community``), -1 without; and how many of its nodes and names are no nodes here."""
        at, hashes_at, known = self.at, f"{self.at}/hashes", self.n > 0

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes, got, strange = values(hashes_at, "i8") if known else None, [], 0
            for b in batches:
                i, c = (numbers_of(hashes, column(b, k)) if known else np.full(b.num_rows, -1) for k in (0, 1))
                strange += int((i < 0).sum() + (c < 0).sum())
                got.append(np.stack([i[i >= 0], column(b, 1)[i >= 0]]))
            path = f"{at}/member-{uuid.uuid4().hex}"
            (np.concatenate(got, axis=1) if got else np.zeros((2, 0), np.int64)).tofile(path)
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "strange": pa.array([strange], pa.int64())})

        parts = member.where("community is not null").select(F.xxhash64("node").alias("h"), F.xxhash64("community").alias("c")).mapInArrow(run, "path string, strange bigint").collect()  # one row a partition
        names = np.unique(np.concatenate([np.unique(np.fromfile(r["path"], np.int64).reshape(2, -1)[1]) for r in parts]))
        out = np.full(self.n, -1, np.int32)
        for r in parts:
            i, c = np.fromfile(r["path"], np.int64).reshape(2, -1)
            out[i] = np.searchsorted(names, c)
            os.unlink(r["path"])
        return out, sum(r["strange"] for r in parts)

    def drop(self) -> None:
        drop_written(self.names.sparkSession, f"file://{self.at}")


#: Edges of one node up to which its block fits a task.
MOST_DEGREE = 8 << 20


def graph(pairs: DataFrame) -> Graph | None:
    """Blocks of stored ``src, dst``; None where the graph is not one for blocks."""
    spark = pairs.sparkSession
    if (at := folder(spark)) is None:
        return None
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("name"))
    names, names_at = written(ends.groupBy("name").agg(F.count(F.lit(1)).alias("degree")), "names")
    edges, most = pairs.count(), names.agg(F.max("degree")).first()[0] or 0  # two numbers
    if most > MOST_DEGREE or (n := numbered(names.select("name"), at)) is None:
        drop_written(spark, names_at, f"file://{at}")
        return None
    size = max(1, -(-n // max(1, -(-2 * edges // BLOCK_EDGES))))
    return Graph(names.select("name"), merged(hashed_edges(pairs, at, size), at) if n else [], at, n, size, 2.0 * edges)
