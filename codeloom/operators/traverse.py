"""Traversals of the graph: level-synchronous search over DataFrames, one written table a level.

Edges are ``src, dst``.  A walk of 1..k edges reaches a node; the start itself only if it lies on a circle.
Every level is deduplicated before the next join, so that dense graphs do not enumerate paths.
"""

from __future__ import annotations

import itertools
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.hierarchy import hierarchy
from codeloom.util import drop_written, written


def links(edges: DataFrame, *types: str) -> DataFrame:
    """``src, dst`` of the given types."""
    return edges.where(F.col("edge_type").isin(*types)).select("src", "dst")


def clamp(depth: int, most: int) -> int:
    return max(1, min(depth, most))


def levels(pairs: DataFrame, seeds: DataFrame, depth: int | None) -> list[DataFrame]:
    """Breadth-first levels ``source, node, pred``: nodes first reached by 1, 2, ... edges from each source.

    ``seeds`` has a column ``source``, and ``node`` if the search of a source starts from other nodes than itself,
    from several at once; ``pred`` is the smallest node of the level before with an edge to it.
    ``pairs`` is read once a level: it should be a scan of a stored graph.  Without a ``depth`` the search goes on
    until nothing new is found, however deep that is.
    """
    found: list[DataFrame] = []
    frontier = seeds.select("source", F.col("node" if "node" in seeds.columns else "source").alias("node")).distinct()
    for _ in itertools.count() if depth is None else range(depth):
        step = frontier.join(pairs, frontier["node"] == pairs["src"]).groupBy("source", F.col("dst").alias("next")).agg(F.min("node").alias("pred"))
        step = step.select("source", F.col("next").alias("node"), "pred")
        for seen in found:
            step = step.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        level, path = written(step, "level")
        if level.isEmpty():
            drop_written(level.sparkSession, path)
            break
        found.append(level)
        frontier = level.select("source", "node")
    return found


def reached(pairs: DataFrame, seeds: DataFrame, depth: int | None) -> DataFrame:
    """``source, node, depth``: every node reached (at any depth without one) and the least number of edges to it."""
    out = None
    for d, level in enumerate(levels(pairs, seeds, depth), 1):
        part = level.select("source", "node", F.lit(d).alias("depth"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else seeds.select("source", F.col("source").alias("node"), F.lit(0).alias("depth")).where("false")


def one(spark, node_id: str) -> DataFrame:
    return spark.range(1).select(F.lit(node_id).alias("source"))


def impact_downstream(nodes: DataFrame, edges: DataFrame, node_id: str, depth: int = 3) -> DataFrame:
    """Nodes that calls and references lead to from one node within ``depth`` (1..8) edges."""
    hit = reached(links(edges, "CALLS", "REFERENCES"), one(nodes.sparkSession, node_id), clamp(depth, 8))
    return nodes.join(hit.select(F.col("node").alias("id"), "depth"), "id").select("label", "fq_name", "name", "id", "depth")


def bulk_impacted(edges: DataFrame, ids: DataFrame, depth: int = 3) -> DataFrame:
    """``source, node`` for many starts (column ``source``) at once."""
    return reached(links(edges, "CALLS", "REFERENCES"), ids, clamp(depth, 8)).select("source", "node")


def test_reach(nodes: DataFrame, edges: DataFrame, node_id: str, depth: int = 3, limit: int | None = 200) -> DataFrame:
    """Tests from which calls or references lead to a node, nearest first."""
    back = links(edges, "CALLS", "REFERENCES").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    hit = reached(back, one(nodes.sparkSession, node_id), clamp(depth, 16))
    tests = nodes.where("label = 'Method' AND is_test").join(hit.select(F.col("node").alias("id"), "depth"), "id")
    out = tests.select(F.col("fq_name").alias("test"), "file_id", "depth").orderBy("depth", "test")
    return out if limit is None else out.limit(limit)


def shortest_path(nodes: DataFrame, edges: DataFrame, start: str, end: str, depth: int = 6) -> list[str] | None:
    """Ids of the nodes of a shortest call path, by smallest predecessors; [] if start is end, None without a path."""
    if start == end:
        return []
    found = levels(links(edges, "CALLS"), one(nodes.sparkSession, start), clamp(depth, 12))
    for d, level in enumerate(found):
        row = level.where(F.col("node") == end).first()
        if row:
            path = [end, row["pred"]]
            for earlier in reversed(found[:d]):  # at most 12 point lookups
                path.append(earlier.where(F.col("node") == path[-1]).first()["pred"])
            return path[::-1]
    return None


def path_table(nodes: DataFrame, path: list[str] | None) -> DataFrame:
    """``position, id, label, name, fq_name`` of a path's nodes."""
    steps = nodes.sparkSession.createDataFrame(list(enumerate(path or [])), "position int, id string")
    return steps.join(nodes.select("id", "label", "name", "fq_name"), "id").select("position", "id", "label", "name", "fq_name")


def flows(nodes: DataFrame, edges: DataFrame, kind: str, depth: int = 3, most: int = 50) -> DataFrame:
    """What entry points reach by calls: ``entry, reaches`` (the first ``most`` names in order).

    kind: rest (handlers of endpoints), main (static methods of that name), test.
    """
    methods = nodes.where("label = 'Method'")
    if kind == "rest":
        entries = edges.where("edge_type = 'HANDLES'").select(F.col("dst").alias("source")).distinct()
    else:
        entries = methods.where("name = 'main' AND coalesce(is_static, false)" if kind == "main" else "coalesce(is_test, false)").select(F.col("id").alias("source"))
    hit = reached(links(edges, "CALLS"), entries, clamp(depth, 8))
    named = hit.join(methods.select(F.col("id").alias("node"), F.col("fq_name").alias("reach")), "node").select("source", "reach").distinct()
    first = named.withColumn("n", F.row_number().over(Window.partitionBy("source").orderBy("reach"))).where(F.col("n") <= most)
    lists = first.groupBy("source").agg(F.array_sort(F.collect_list("reach")).alias("reaches"))  # bounded by ``most``
    names = entries.join(methods.select(F.col("id").alias("source"), F.col("fq_name").alias("entry")), "source")
    return names.join(lists, "source", "left").select("entry", F.coalesce("reaches", F.array().cast("array<string>")).alias("reaches"), F.col("source").alias("id"))


def ego_slice(nodes: DataFrame, edges: DataFrame, node_id: str, depth: int = 2, most: int = 500, direction: str = "both") -> tuple[DataFrame, DataFrame]:
    """The neighbourhood of a node: nodes (with callee counts) and the edges among them, cut in (level, id) order."""
    pairs = edges.select("src", "dst").distinct()
    flip = pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    pairs = pairs if direction == "out" else flip if direction == "in" else pairs.unionByName(flip).distinct()
    hit = reached(pairs, one(nodes.sparkSession, node_id), clamp(depth, 4)).where(F.col("node") != node_id)
    near = hit.orderBy("depth", "node").limit(most - 1).select(F.col("node").alias("id"), "depth")
    near = near.unionByName(one(nodes.sparkSession, node_id).select(F.col("source").alias("id"), F.lit(0).alias("depth")))
    near, _ = written(near, "slice")
    callees = edges.where("edge_type = 'CALLS'").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("callee_count"))
    shown = nodes.join(near, "id").join(callees, "id", "left").select("id", "label", "fq_name", "depth", F.coalesce("callee_count", F.lit(0)).alias("callee_count"))
    inner = edges.join(near.select(F.col("id").alias("src")), "src", "left_semi").join(near.select(F.col("id").alias("dst")), "dst", "left_semi")
    return shown, inner.select(F.concat_ws("|", "src", "edge_type", "dst").alias("id"), "src", "dst", "edge_type").distinct()


def longest_chain(edges: DataFrame, edge_type: str = "EXTENDS") -> DataFrame:
    """``node, depth``: the longest path of the type upwards from each node; nodes on circles or below them have none.

    Where every node has one parent at most, pointer doubling gives the depths in about log2(depth) rounds; else
    a node's depth is one more than the greatest of its parents' as soon as all of these are known, a round a level.
    """
    pairs, pairs_at = written(links(edges, edge_type).distinct(), "chain")
    if pairs.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        tree = hierarchy(pairs.select(F.lit(edge_type).alias("type"), F.col("src").alias("node_id"), F.col("dst").alias("parent_id")), with_path=False)
        drop_written(pairs.sparkSession, pairs_at)
        return tree.where("depth > 0").select(F.col("node_id").alias("node"), "depth")
    tops = pairs.select(F.col("dst").alias("node")).distinct().join(pairs.select(F.col("src").alias("node")), "node", "left_anti")
    last = known = tops.select("node", F.lit(0).alias("depth"))
    found = []
    while True:
        below = pairs.join(last.select(F.col("node").alias("dst")), "dst", "left_semi").select("src").distinct()
        parents = pairs.join(below, "src", "left_semi").join(known.select(F.col("node").alias("dst"), "depth"), "dst", "left")
        full = parents.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.count("depth").alias("k"), F.max("depth").alias("d")).where("n = k")
        last, at = written(full.select("node", (F.col("d") + 1).alias("depth")), "depths")
        if last.isEmpty():
            drop_written(pairs.sparkSession, at, pairs_at)
            break
        found.append(last)
        known = known.unionByName(last)
    return reduce(DataFrame.unionByName, found) if found else pairs.select(F.col("src").alias("node"), F.lit(0).alias("depth")).where("false")


def closure(edges: DataFrame, seeds: DataFrame, edge_type: str = "CONTAINS", depth: int | None = None) -> DataFrame:
    """``source, node, depth`` of everything contained in the seeds, however deep."""
    return reached(links(edges, edge_type), seeds, depth)
