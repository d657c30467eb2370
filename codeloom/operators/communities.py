"""Components and communities of the call graph, all by joins: no component is ever gathered in one task."""

from __future__ import annotations

import os
import uuid
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators import blocks
from codeloom.util import BROADCAST_BYTES, drop_written, first_of_each, lookup, skewed_lookup, written


def adjacency(edges: DataFrame) -> DataFrame:
    """Undirected weights ``u, v, w`` both ways: loops dropped, parallel and opposite edges summed."""
    e = edges.where("src <> dst")
    both = e.select(F.col("src").alias("u"), F.col("dst").alias("v")).unionAll(e.select(F.col("dst").alias("u"), F.col("src").alias("v")))
    return both.groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("w"))


def components(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """``node, component``: the smallest id of each connected component (least neighbours, with contraction).

    A round points every node to the least of itself and its neighbours, and that one's pointer; then the nodes of
    one pointer become one, edges within them go, equal ones are folded.  At least half of the nodes vanish with
    each round, so that the rounds together cost about as much as the first.  The pointers of all rounds, put
    together from the last to the first, name the components.  Hot nodes meet their pointers by a broadcast.
    """
    spark = pairs.sparkSession
    both = pairs.select(F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"))
    edges, edges_at = written(both.where("u <> v").distinct(), "undirected")
    ids = pairs.select(F.inline(F.array(F.struct(F.col("src").alias("node")), F.struct(F.col("dst").alias("node")))))
    if nodes is not None:
        ids = ids.unionAll(nodes.select("node"))
    ids, _ = written(ids.where("node is not null").distinct(), "ids")
    rounds: list[tuple[DataFrame, str]] = []
    while not edges.isEmpty():
        # u is the smaller end: the least neighbour of v is among its u, that of u is u itself or among its own
        least = edges.select(F.inline(F.array(F.struct(F.col("v").alias("node"), F.col("u").alias("low")), F.struct(F.col("u").alias("node"), F.col("u").alias("low"))))).groupBy("node").agg(F.min("low").alias("low"))
        near, near_at = written(least, "near")
        to, to_at = written(lookup(near, near.select(F.col("node").alias("low"), F.col("low").alias("rep")), ["low"], written_already=True).select("node", "rep"), "pointers")
        rounds.append((to, to_at))
        ends = lookup(edges, to.select(F.col("node").alias("u"), F.col("rep").alias("a")), ["u"], written_already=True)
        ends = lookup(ends, to.select(F.col("node").alias("v"), F.col("rep").alias("b")), ["v"], written_already=True)
        fewer = ends.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u <> v").distinct()
        new, new_at = written(fewer, "undirected")
        drop_written(spark, edges_at, near_at)
        edges, edges_at = new, new_at
    drop_written(spark, edges_at)
    whole = None
    for to, at in reversed(rounds):
        if whole is not None:
            there = lookup(to, whole.select(F.col("node").alias("rep"), F.col("component").alias("further")), ["rep"], how="left", written_already=True)
            to = there.select("node", F.coalesce("further", "rep").alias("rep"))
        new, new_at = written(to.select("node", F.col("rep").alias("component")), "components")
        drop_written(spark, at, *([whole_at] if whole is not None else []))
        whole, whole_at = new, new_at
    if whole is None:
        return ids.select("node", F.col("node").alias("component"))
    return ids.join(whole, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def modularity(adj: DataFrame, member: DataFrame, node: str = "node", community: str = "community") -> DataFrame:
    """One row ``modularity``: sum over communities of in/2m - (deg/2m)^2."""
    m = member.select(F.col(node).alias("u"), F.col(community).alias("cu"))
    e = adj.join(m, "u").join(m.select(F.col("u").alias("v"), F.col("cu").alias("cv")), "v")
    per = e.groupBy("cu").agg(F.sum("w").alias("deg"), F.sum(F.when(F.col("cu") == F.col("cv"), F.col("w")).otherwise(0.0)).alias("inside"))
    total = adj.agg(F.sum("w").alias("t")).first()["t"] or 1.0  # one number
    return per.agg(F.round(F.sum(F.col("inside") / total - (F.col("deg") / total) * (F.col("deg") / total)), 6).alias("modularity"))


def louvain(edges: DataFrame, passes: int = 50, least_gain: float = 1e-2, coarser: bool = True, stored: bool = False) -> DataFrame:
    """``node, community`` by local moving in parallel, level by level.

    A pass has two halves: the nodes of one parity (of a hash that changes with the pass), then those of the
    other, move to the neighbouring community of the largest positive gain (k_in,C - k_in,old)/m
    - k_i (S_C - (S_old - k_i)) / (2 m^2), ties to the smaller id; moving half of the nodes at a time keeps
    neighbours from swapping for ever.  A level ends with a pass that moves no node or raises modularity by less than
    ``least_gain``, after ``passes`` at the latest (a warning then says how many nodes the last pass still moved).
    With ``coarser`` the communities become the nodes of a next level, until a level makes none of several nodes; without, and with a ``least_gain`` of 0, one level runs until no node can gain by moving.
    Moves are made on blocks of edges (:mod:`blocks`), or by joins where the graph is none for these; a community has the name of one of its nodes.
    ``stored`` edges are a scan of files and are read again instead of being written first.
    """
    pairs, graph = _graph(edges, stored)
    if graph is None:
        return _by_joins(pairs, passes, least_gain, coarser)
    member = graph.named(_moved(graph, passes, least_gain, coarser))
    graph.drop()
    return member


def _graph(edges: DataFrame, stored: bool) -> tuple[DataFrame, blocks.Graph | None]:
    pairs, at = edges.where("src <> dst").select("src", "dst"), None
    if not stored:
        pairs, at = written(pairs, "pairs")
    graph = blocks.graph(pairs)
    if graph is not None and at:
        drop_written(pairs.sparkSession, at)
    return pairs, graph


def _moved(graph: blocks.Graph, passes: int, least_gain: float, coarser: bool) -> np.ndarray:
    """The community of each node, by number, after all levels on blocks."""
    whole, level = np.arange(graph.n, dtype=np.int32), graph
    while graph.n:
        member, moved = _moved_blocks(level, passes, least_gain)
        used = np.zeros(level.n, bool)
        used[member] = True
        left = int(used.sum())
        if moved and left < level.n:  # every level that goes on has fewer nodes than the one before
            to = (np.cumsum(used, dtype=np.int32) - 1)[member]
            whole = to[whole]
            if coarser:
                done, level = level, level.coarser(to, left)
                if done is not graph:
                    done.drop_blocks()
                continue
        if level is not graph:
            level.drop_blocks()
        break
    return whole


def _parity(nodes: np.ndarray, turn: int) -> np.ndarray:
    """One bit of a hash of node and turn."""
    x = nodes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((turn + 1) * 0xBF58476D1CE4E5B9 % 2**64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(40)) & np.uint64(1)


def _moved_blocks(graph: blocks.Graph, passes: int, least_gain: float) -> tuple[np.ndarray, int]:
    """The community of each node after the passes of one level on blocks, and how many moves there were.

    Edges from a node to itself (of coarser levels) count in its degree and move with it.
    """
    n, size, files, two_m, m = graph.n, graph.size, graph.files, graph.two_m, graph.two_m / 2
    k_at, own_at, s_at, at = (f"{graph.at}/{x}-{uuid.uuid4().hex}" for x in ("k", "own", "s", "member"))
    blocks.new_values(k_at, n, "f8"), blocks.new_values(own_at, n, "f8")

    def said(moved: int, inside: float) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"moved": pa.array([float(moved)]), "inside": pa.array([float(inside)])})

    def degrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, own = blocks.values(k_at, "f8", "r+"), blocks.values(own_at, "f8", "r+")
        for part, u, v, w in blocks.blocks_of(batches, files):
            lo, hi = part * size, min(n, part * size + size)
            k[lo:hi] = np.bincount(u - lo, w, hi - lo)
            own[lo:hi] = np.bincount(u - lo, w * (u == v), hi - lo)
        k.flush(), own.flush()
        yield said(0, 0.0)

    graph.sums(degrees, "moved", "inside")
    k_all = np.fromfile(k_at)
    member = np.arange(n, dtype=np.int32)
    before, moves_of_all = None, 0
    for turn in range(passes):
        moved, inside, squares = 0, 0.0, 0.0
        for half in (0, 1):
            totals = np.bincount(member, k_all, n)
            squares = float((totals * totals).sum())
            totals.tofile(s_at), member.tofile(at)
            del totals
            new_at = f"{at}-{turn}-{half}"
            blocks.new_values(new_at, n, "i4")

            def move(batches: Iterator[pa.RecordBatch], turn=turn, half=half, new_at=new_at) -> Iterator[pa.RecordBatch]:
                old, new = blocks.values(at, "i4"), blocks.values(new_at, "i4", "r+")
                k, own, s = (blocks.values(x, "f8") for x in (k_at, own_at, s_at))
                for part, u, v, w in blocks.blocks_of(batches, files):
                    lo, hi = part * size, min(n, part * size + size)
                    mine = _parity(np.arange(lo, hi), turn) == half
                    out, count, inside = np.array(old[lo:hi]), 0, float(own[lo:hi][mine].sum())
                    pick = mine[u - lo] & (u != v)
                    if pick.any():
                        nodes, to, k_in = _toward(u[pick] - lo, old[v[pick]], w[pick])
                        here, ku = out[nodes] == to, np.asarray(k[lo:hi])[nodes]
                        # the gain without the part that is the same for all communities
                        score = np.where(here, -np.inf, k_in / m - ku * s[to] / (2 * m * m))
                        starts = np.flatnonzero(np.r_[True, nodes[1:] != nodes[:-1]])
                        best, each = np.maximum.reduceat(score, starts), np.diff(np.r_[starts, len(nodes)])
                        k_old = np.add.reduceat(np.where(here, k_in, 0.0), starts)
                        first = np.flatnonzero(score == np.repeat(best, each))  # the smaller community of several
                        target = to[first[np.r_[True, nodes[first][1:] != nodes[first][:-1]]]]
                        node, ku = nodes[starts], ku[starts]
                        gain = best - k_old / m + ku * (s[out[node]] - ku) / (2 * m * m)
                        goes = gain > 1e-12
                        out[node[goes]] = target[goes]
                        count, inside = int(goes.sum()), inside + float(k_old.sum())
                    new[lo:hi] = out
                    yield said(count, inside)
                new.flush()

            got = graph.sums(move, "moved", "inside")
            moved, inside = moved + int(got[0]), inside + got[1]
            member = np.fromfile(new_at, np.int32)[:n]
            os.unlink(new_at)
        moves_of_all += moved
        # modularity as the pass met it, each half before its moves
        now = inside / two_m - squares / (two_m * two_m)
        if not moved or before is not None and least_gain and now - before < least_gain:
            break
        before = now
    else:
        warnings.warn(f"louvain: pass {passes}, the last allowed, still moved {moved} nodes", stacklevel=4)
    for path in (k_at, own_at, s_at, at):
        if os.path.exists(path):
            os.unlink(path)
    return member, moves_of_all


def _toward(nodes: np.ndarray, to: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Node, community and the weight between them, in this order."""
    keys, k_in = blocks.summed(blocks.keyed(nodes, to), w.astype(float))
    return keys >> 32, keys & 0xFFFFFFFF, k_in


def _by_joins(edges: DataFrame, passes: int, least_gain: float, coarser: bool) -> DataFrame:
    """:func:`louvain` by joins of DataFrames, whatever the number of nodes."""
    spark = edges.sparkSession
    named, named_at = written(adjacency(edges), "adjacency")
    degree = named.groupBy("u").agg(F.sum("w").alias("k"))
    two_m = named.agg(F.sum("w")).first()[0]  # one number
    # numbers in the order of the ids: the loop shuffles these instead of names
    ids, _ = written(ranked(degree, [F.col("u")]).select(F.col("u").alias("name"), F.col("rank").cast("bigint").alias("node")), "numbers")
    if not two_m:
        return ids.select(F.col("name").alias("node"), F.col("name").alias("community"))
    adj = named.join(ids.select(F.col("name").alias("u"), F.col("node").alias("_u")), "u").join(ids.select(F.col("name").alias("v"), F.col("node").alias("_v")), "v")
    adj, adj_at = written(adj.select(F.col("_u").alias("u"), F.col("_v").alias("v"), "w"), "adjacency")
    drop_written(spark, named_at)
    whole, whole_at = written(ids.select("node", F.col("node").alias("community")), "whole")
    while True:
        member, member_at, moved = _moved_level(adj, two_m, passes, least_gain)
        sizes = member.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("community").alias("communities")).first()  # two numbers
        if not moved or sizes["nodes"] == sizes["communities"]:  # every level that goes on has fewer nodes than the one before
            drop_written(spark, member_at)
            break
        # a community takes the number of its first node
        first = member.groupBy("community").agg(F.min("node").alias("first"))
        to, to_at = written(lookup(member, first, ["community"], "first").select("node", F.col("first").alias("to")), "to")
        new, new_at = written(lookup(whole.withColumnRenamed("community", "old"), to.withColumnRenamed("node", "old"), ["old"], written_already=True).select("node", F.col("to").alias("community")), "whole")
        drop_written(spark, whole_at, member_at)
        whole, whole_at = new, new_at
        if not coarser:
            break
        ends = lookup(adj, to.select(F.col("node").alias("u"), F.col("to").alias("a")), ["u"], written_already=True)
        ends = lookup(ends, to.select(F.col("node").alias("v"), F.col("to").alias("b")), ["v"], written_already=True)
        next_adj, next_at = written(ends.groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.sum("w").alias("w")), "adjacency")
        drop_written(spark, adj_at, to_at)
        adj, adj_at = next_adj, next_at
    drop_written(spark, adj_at)
    names = ids.select(F.col("node").alias("community"), F.col("name").alias("_to"))
    return lookup(whole.join(ids, "node"), names, ["community"], "names").select(F.col("name").alias("node"), F.col("_to").alias("community"))


def _moved_level(adj: DataFrame, two_m: float, passes: int, least_gain: float) -> tuple[DataFrame, str, int]:
    """``node, community, k`` after the passes of one level, where it lies, and how many moves there were.

    Edges from a node to itself (of coarser levels) count in its degree and move with it.
    """
    spark, m, moves_of_all = adj.sparkSession, two_m / 2, 0
    across = adj.where("u <> v")
    member, at = written(adj.groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("k"), F.sum(F.when(F.col("u") == F.col("v"), F.col("w")).otherwise(0.0)).alias("own")).select("node", F.col("node").alias("community"), "k", "own"), "member")
    before = None
    for turn in range(passes):
        moved, inside, squares = 0, 0.0, 0.0
        for half in (0, 1):
            totals, totals_at = written(member.groupBy("community").agg(F.sum("k").alias("s")), "totals")
            sizes = totals.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("s") * F.col("s")).alias("squares")).first()  # two numbers
            squares, small = sizes["squares"], sizes["n"] * 32 <= BROADCAST_BYTES
            state = member.join(F.broadcast(totals), "community") if small else skewed_lookup(member, totals, ["community"], member.count())
            parity = lambda node, turn=turn, half=half: F.pmod(F.xxhash64(node, F.lit(turn)), F.lit(2)) == half
            # by the moving node from here on: its communities, the best of these and its move need no further exchange
            seen = across.where(parity("u")).join(state.select(F.col("node").alias("v"), "community", "s"), "v").select(F.col("u").alias("node"), "community", "s", "w").repartition("node")
            toward = seen.groupBy("node", "community").agg(F.sum("w").alias("k_in"), F.min("s").alias("s"))
            mine = state.where(parity("node")).select("node", F.col("community").alias("old"), "k", F.col("s").alias("s_old"))
            # the gain without the part that is the same for all communities
            score = F.col("k_in") / m - F.col("k") * F.col("s") / (2 * m * m)
            best = mine.join(toward, "node").groupBy("node", "old", "k", "s_old").agg(
                F.min(F.when(F.col("community") != F.col("old"), F.struct((-score).alias("g"), "community"))).alias("b"),
                F.max(F.when(F.col("community") == F.col("old"), F.col("k_in")).otherwise(0.0)).alias("k_old"),
            )
            gain = -F.col("b.g") - F.col("k_old") / m + F.col("k") * (F.col("s_old") - F.col("k")) / (2 * m * m)
            moves = best.select("node", F.when(gain > 1e-12, F.col("b.community")).alias("to"), "k_old")
            new, new_at = written(member.join(moves, "node", "left").select("node", F.coalesce("to", "community").alias("community"), "k", "own", F.col("to").isNotNull().alias("moved"), F.when(parity("node"), F.coalesce("k_old", F.lit(0.0)) + F.col("own")).otherwise(0.0).alias("inside")), "member")
            said = new.agg(F.count_if("moved").alias("moved"), F.sum("inside").alias("inside")).first()  # two numbers
            moved, inside = moved + said["moved"], inside + said["inside"]
            drop_written(spark, at, totals_at)
            member, at = new.select("node", "community", "k", "own"), new_at
        moves_of_all += moved
        # modularity as the pass met it, each half before its moves
        now = inside / two_m - squares / (two_m * two_m)
        if not moved or before is not None and least_gain and now - before < least_gain:
            break
        before = now
    else:
        warnings.warn(f"louvain: pass {passes}, the last allowed, still moved {moved} nodes", stacklevel=3)
    return member, at, moves_of_all


def leiden(edges: DataFrame, passes: int = 50, least_gain: float = 1e-2, coarser: bool = True, stored: bool = False) -> DataFrame:
    """Louvain's communities, split into connected parts: ``node, community`` (the least node of the part)."""
    pairs, graph = _graph(edges, stored)
    if graph is None:
        member, _ = written(_by_joins(pairs, passes, least_gain, coarser), "louvain")
        inner = _inside(pairs, member).select("src", "dst")
        return components(inner, member.select("node")).withColumnRenamed("component", "community")
    member = graph.named(_connected(graph, _moved(graph, passes, least_gain, coarser)))
    graph.drop()
    return member


def _connected(graph: blocks.Graph, whole: np.ndarray) -> np.ndarray:
    """The least number in the connected part of each node's community: least neighbours, then their pointers, until none gets smaller."""
    n, size, files = graph.n, graph.size, graph.files
    member_at, at = (f"{graph.at}/{x}-{uuid.uuid4().hex}" for x in ("member", "least"))
    whole.tofile(member_at)
    least = np.arange(n, dtype=np.int32)
    while n:
        least.tofile(at)
        new_at = f"{at}-new"
        blocks.new_values(new_at, n, "i4")

        def lower(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            member, old, new, changed = blocks.values(member_at, "i4"), blocks.values(at, "i4"), blocks.values(new_at, "i4", "r+"), 0
            for part, u, v, _ in blocks.blocks_of(batches, files):
                lo, hi = part * size, min(n, part * size + size)
                out = np.array(old[lo:hi])
                starts = np.flatnonzero(np.r_[True, u[1:] != u[:-1]])
                near = np.minimum.reduceat(np.where(member[u] == member[v], old[v], old[u]), starts)
                nodes = u[starts] - lo
                changed += int((near < out[nodes]).sum())
                out[nodes] = np.minimum(out[nodes], near)
                new[lo:hi] = out
            new.flush()
            yield pa.RecordBatch.from_pydict({"changed": pa.array([float(changed)])})

        changed = graph.sums(lower, "changed")[0]
        before, least = least, np.fromfile(new_at, np.int32)[:n]
        os.unlink(new_at)
        if not changed:
            break
        # a node's former pointer lies in its part: that one gets what the node got, then pointers are followed
        np.minimum.at(least, before, least.copy())
        least = least[least]
    return least


def _inside(pairs: DataFrame, member: DataFrame) -> DataFrame:
    a = pairs.join(member.select(F.col("node").alias("src"), F.col("community").alias("c1")), "src")
    return a.join(member.select(F.col("node").alias("dst"), F.col("community").alias("c2")), "dst").where("c1 = c2")


def described(edges: DataFrame, member: DataFrame, least: int = 2, samples: int = 10) -> DataFrame:
    """``rank, community, size, internal_edges, cohesion, members`` (the first ``samples``), largest first."""
    pairs = edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    inner = _inside(pairs, member).groupBy(F.col("c1").alias("community")).agg(F.count(F.lit(1)).alias("internal_edges"))
    return _described(member, inner, least, samples)


def _described(member: DataFrame, inner: DataFrame, least: int, samples: int) -> DataFrame:
    sizes = member.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    some = first_of_each(member.select("community", "node"), ["community"], [F.col("node")], samples).groupBy("community").agg(F.array_sort(F.collect_list("node")).alias("members"))
    out = sizes.where(F.col("size") >= least).join(inner, "community", "left").join(some, "community").fillna(0, ["internal_edges"])
    out = out.withColumn("cohesion", F.round(F.col("internal_edges") / (F.col("size") * (F.col("size") - 1) / 2), 6))
    # ranks over communities, by a range-partitioned sort
    return ranked(out, [F.col("size").desc(), F.col("community")])


def louvain_described(edges: DataFrame, stored: bool = False, least: int = 2, samples: int = 10) -> DataFrame:
    """:func:`described` of :func:`louvain`'s communities; edges are counted on the blocks that these were found on."""
    pairs, graph = _graph(edges, stored)
    if graph is None:
        member, _ = written(_by_joins(pairs, 50, 1e-2, True), "louvain")
        return described(pairs, member, least, samples)
    group = _moved(graph, 50, 1e-2, True)
    member, _ = written(graph.named(group), "louvain")
    # a number and a name of each community: those of its first named node
    inner = _inner_edges(graph, group)
    of = graph.numbered(member.where("node = community"), "community").select("community", "_number")
    inner, _ = written(_of_groups(of, group, inner, "internal_edges"), "inner")
    graph.drop()
    return _described(member, inner.where("internal_edges > 0"), least, samples)


def _inner_edges(graph: blocks.Graph, group: np.ndarray) -> np.ndarray:
    """The pairs of nodes with an edge that lie in each group."""
    files, many = graph.files, int(group.max()) + 1 if len(group) else 1
    path, at = f"{graph.at}/group-{uuid.uuid4().hex}", graph.at
    group.astype(np.int32).tofile(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, counts, out = blocks.values(path, "i4"), np.zeros(many), f"{at}/inner-{uuid.uuid4().hex}"
        for _, u, v, _ in blocks.blocks_of(batches, files):
            c = of[u]
            pick = (c == of[v]) & (u < v)
            counts += np.bincount(c[pick], minlength=many)
        counts.tofile(out)
        yield pa.RecordBatch.from_pydict({"path": pa.array([out])})

    total = np.zeros(many)
    for r in graph.mapped(run, "path string").collect() if files else []:  # one row a task
        total += np.fromfile(r["path"])
        os.unlink(r["path"])
    os.unlink(path)
    return total


def _of_groups(named: DataFrame, group: np.ndarray, values: np.ndarray, name: str) -> DataFrame:
    """``named`` (``community`` and the ``_number`` of a node of it) with the value of its group."""
    folder = blocks.folder(named.sparkSession)
    np.r_[group, 0].astype(np.int32).tofile(f"{folder}/group"), np.r_[values, 0.0].tofile(f"{folder}/values")  # no file is empty

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, x = blocks.values(f"{folder}/group", "i4"), blocks.values(f"{folder}/values", "f8")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x[of[blocks.column(b, 1)]].astype(np.int64))], names=["community", name])

    return named.select("community", "_number").mapInArrow(run, f"community string, {name} bigint")


def louvain_checked(edges: DataFrame, floor: DataFrame, stored: bool = False) -> DataFrame | None:
    """One row of what must hold of :func:`louvain`'s communities, found on their blocks; None where the graph is none for blocks.

    ``floor`` has the ``node, community`` whose modularity is the least that is asked for; both sums leave out nodes that it has not.
    """
    pairs, graph = _graph(edges, stored)
    if graph is None:
        return None
    spark = pairs.sparkSession
    member, _ = written(graph.named(_moved(graph, 50, 1e-2, True)), "louvain")
    found, strange = graph.groups(member)
    least, _ = graph.groups(floor)
    sizes = member.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("node").alias("nodes")).first()  # two numbers
    said = (sizes["nodes"] == graph.n, sizes["n"] == sizes["nodes"], strange == 0, _modularity(graph, found) >= _modularity(graph, least))
    graph.drop()
    return spark.createDataFrame([said], "all_members boolean, one_each boolean, named_by_members boolean, not_below_floor boolean")


def _modularity(graph: blocks.Graph, group: np.ndarray) -> float:
    """:func:`modularity` on blocks: groups by number, nodes of none (-1) and their edges left out."""
    path, at, files, two_m = f"{graph.at}/of-{uuid.uuid4().hex}", graph.at, graph.files, graph.two_m or 1.0
    many = int(group.max()) + 1 if len(group) else 0
    group.astype(np.int32).tofile(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, sums, out = blocks.values(path, "i4"), np.zeros((2, many)), f"{at}/sums-{uuid.uuid4().hex}"
        for _, u, v, w in blocks.blocks_of(batches, files):
            a, b = of[u], of[v]
            both = (a >= 0) & (b >= 0)
            sums[0] += np.bincount(a[both], w[both], many)
            sums[1] += np.bincount(a[both & (a == b)], w[both & (a == b)], many)
        sums.tofile(out)
        yield pa.RecordBatch.from_pydict({"path": pa.array([out])})

    sums = np.zeros((2, many))
    for r in graph.mapped(run, "path string").collect() if files and many else []:  # one row a task
        sums += np.fromfile(r["path"]).reshape(2, -1)
        os.unlink(r["path"])
    os.unlink(path)
    return round(float((sums[1] / two_m - (sums[0] / two_m) ** 2).sum()), 6)


def ranked(df: DataFrame, order: list) -> DataFrame:
    """``rank`` of every row by ``order``, without bringing all rows to one task."""
    parts, _ = written(df.orderBy(*order).withColumn("_p", F.spark_partition_id()), "ranked")
    offsets = {r["_p"]: r["n"] for r in parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    base, rows = 0, []
    for p in sorted(offsets):
        rows.append((p, base))
        base += offsets[p]
    start = df.sparkSession.createDataFrame(rows, "_p int, _base long")
    w = Window.partitionBy("_p").orderBy(*order)
    return parts.join(F.broadcast(start), "_p").withColumn("rank", F.row_number().over(w) + F.col("_base")).drop("_p", "_base")
