"""Full hierarchies from parent-child links of unknown depth.

Method: pointer doubling.  Every node starts with a pointer to its parent; a round replaces each pointer by
the pointer of the node it points to, which doubles its reach, and puts the path segments together.  A node
is done when its pointer has reached a node without a parent.  A round looks up only the nodes that open pointers
point to, each once, and brings these few back to the open nodes.  If a round finishes no node, all that are open
lie on a circle or below one (of nodes with a root, some of every depth up to the deepest exist), so there are
about log2(depth) rounds.

Each round is one written table in the shared folder, split into done and open nodes (no lineage grows, a lost
executor costs a re-read); a round reads the done ones once and writes only the open ones.  All of them are
deleted when the result is written.

Defined cases: rows with a null end are no links; of several parents the one of the row with the newest
time counts, then the larger number; a node that is its own parent is a circle; empty input gives an empty
result; repeated rows change nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.util import drop_written, lookup, written


def tree_links(edge_keys: DataFrame) -> DataFrame:
    """``type, node_id, parent_id`` of the containment and type trees; one parent each."""
    ends = edge_keys.where(F.col("type").isin("CONTAINS", "EXTENDS") & F.col("from_id").isNotNull() & F.col("to_id").isNotNull())
    down = F.col("type") == "CONTAINS"
    ends = ends.select("type", F.when(down, F.col("to_id")).otherwise(F.col("from_id")).alias("node_id"), F.when(down, F.col("from_id")).otherwise(F.col("to_id")).alias("parent_id"), F.struct("ingested_at", "event_no").alias("at"))
    return ends.groupBy("type", "node_id").agg(F.max_by("parent_id", "at").alias("parent_id"))


def hierarchy(links: DataFrame, with_path: bool = True) -> DataFrame:
    """``type, node_id, parent_id, root_id, depth`` (and ``path``) of every node that has a parent.

    On a circle or below one: root_id '', depth -1, path null.  path is the array of ids from the root to the node.
    """
    spark, paths = links.sparkSession, []

    def cut(df: DataFrame, label: str, *by: str) -> DataFrame:
        kept, path = written(df, label, *by)
        paths.append(path)
        return kept

    seg = [F.array("node_id").alias("path")] if with_path else []
    base = cut(links.select("type", "node_id", "parent_id"), "links")
    # a parent that has no parent is a root; each parent is looked up once, hot ones do no harm
    inner = base.select("type", F.col("node_id").alias("parent_id"), F.lit(False).alias("above"))
    known = base.select("type", "parent_id").distinct().join(inner, ["type", "parent_id"], "left").select("type", "parent_id", F.coalesce("above", F.lit(True)).alias("done"))
    state = lookup(base, cut(known, "parents"), ["type", "parent_id"], written_already=True).select("type", "node_id", "parent_id", F.col("parent_id").alias("anc"), F.lit(1).cast("bigint").alias("dist"), "done", *seg)
    finished: list[DataFrame] = []
    while True:
        state = cut(state, "pointers", "done")
        counts = {r["done"]: r["n"] for r in state.groupBy("done").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
        finished.append(state.where("done"))
        opened = state.where("NOT done")
        if not counts.get(False) or not counts.get(True):
            break
        cols = [F.col("type"), F.col("node_id").alias("anc"), F.col("anc").alias("anc2"), F.col("dist").alias("dist2"), F.col("done").alias("done2")]
        cols += [F.col("path").alias("path2")] if with_path else []
        targets = opened.select(*cols)
        for part in finished:
            targets = targets.unionByName(part.select(*cols))
        asked = cut(targets.join(opened.select("type", "anc").distinct(), ["type", "anc"], "left_semi"), "targets")
        step = lookup(opened, asked, ["type", "anc"], written_already=True)
        path = [F.concat("path2", "path").alias("path")] if with_path else []
        state = step.select("type", "node_id", "parent_id", F.col("anc2").alias("anc"), (F.col("dist") + F.col("dist2")).alias("dist"), F.col("done2").alias("done"), *path)
    path = [F.concat(F.array("anc"), "path").alias("path")] if with_path else []
    out = None
    for part in finished:
        part = part.select("type", "node_id", "parent_id", F.col("anc").alias("root_id"), F.col("dist").cast("int").alias("depth"), *path)
        out = part if out is None else out.unionByName(part)
    lost = [F.lit(None).cast("array<string>").alias("path")] if with_path else []
    out, _ = written(out.unionByName(opened.select("type", "node_id", "parent_id", F.lit("").alias("root_id"), F.lit(-1).alias("depth"), *lost)), "hierarchy")
    drop_written(spark, *paths)
    return out


def descendants(tree: DataFrame) -> DataFrame:
    """``type, ancestor_id, node_id, distance`` for all pairs of a node and one above it, from the paths."""
    steps = tree.where("depth > 0").select("type", "node_id", "depth", F.posexplode("path").alias("level", "ancestor_id"))
    return steps.where("level < depth").select("type", "ancestor_id", "node_id", (F.col("depth") - F.col("level")).alias("distance"))


def tree_sizes(tree: DataFrame) -> DataFrame:
    """Each node with the number of its descendants: the hierarchy's columns and ``descendants``."""
    below = descendants(tree).groupBy("type", F.col("ancestor_id").alias("node_id")).agg(F.count(F.lit(1)).alias("descendants"))
    return tree.join(below, ["type", "node_id"], "left").withColumn("descendants", F.coalesce("descendants", F.lit(0).cast("bigint")))
