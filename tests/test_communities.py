import random
from collections import Counter, defaultdict

import pytest

from codeloom.operators import communities


def _improvable(pairs, member):
    """Nodes that could still gain by moving to a neighbour's community."""
    adj = defaultdict(Counter)
    for a, b in pairs:
        adj[a][b] += 1
        adj[b][a] += 1
    k, m = {i: sum(x.values()) for i, x in adj.items()}, len(pairs)
    total = Counter()
    for i in adj:
        total[member[i]] += k[i]
    out = set()
    for i in adj:
        to, old = Counter(), member[i]
        for j, w in adj[i].items():
            to[member[j]] += w
        if any((to[c] - to[old]) / m - k[i] * (total[c] - (total[old] - k[i])) / (2 * m * m) > 1e-9 for c in to if c != old):
            out.add(i)
    return out


def test_local_moving_runs_until_no_node_gains(spark, rows):
    r = random.Random(5)
    pairs = sorted({tuple(f"n{i:03}" for i in sorted(r.sample(range(200), 2))) for _ in range(400)})
    e = spark.createDataFrame(pairs, "src string, dst string")
    member = dict(rows(communities.louvain(e, least_gain=0, coarser=False)))
    assert set(member) == {i for p in pairs for i in p} and set(member.values()) <= set(member)
    assert _improvable(pairs, member) == set()
    with pytest.warns(UserWarning, match="still moved"):
        assert _improvable(pairs, dict(rows(communities.louvain(e, 1, 0, False))))


def _modularity(pairs, member):
    m, total, inside = len(pairs), Counter(), 0
    for a, b in pairs:
        inside += member[a] == member[b]
        total[member[a]] += 1
        total[member[b]] += 1
    return inside / m - sum(x * x for x in total.values()) / (4 * m * m)


def _sequential(pairs):
    """One level of local moving, one node after another."""
    adj = defaultdict(Counter)
    for a, b in pairs:
        adj[a][b] += 1
        adj[b][a] += 1
    k, m, member = {i: sum(x.values()) for i, x in adj.items()}, len(pairs), {i: i for i in adj}
    total = Counter(k)
    for _ in range(50):
        moved = False
        for i in sorted(adj):
            to, old = Counter({member[i]: 0}), member[i]
            for j, w in adj[i].items():
                to[member[j]] += w
            gain = lambda c: (to[c] - to[old]) / m - k[i] * (total[c] - (total[old] - k[i])) / (2 * m * m)
            best = max(sorted(c for c in to if c != old), key=gain, default=old)
            if best != old and gain(best) > 1e-12:
                total[old] -= k[i]
                total[best] += k[i]
                member[i], moved = best, True
        if not moved:
            return member
    return member


def test_modularity_is_not_below_that_of_sequential_moving(spark, rows):
    r = random.Random(7)
    blocks = [(a, b) for a in range(120) for b in range(a) if r.random() < (0.25 if a // 20 == b // 20 else 0.01)]
    loose = sorted({tuple(sorted(r.sample(range(150), 2))) for _ in range(400)})
    for pairs in (blocks, loose):
        pairs = [(f"n{a:03}", f"n{b:03}") for a, b in pairs]
        member = dict(rows(communities.louvain(spark.createDataFrame(pairs, "src string, dst string"))))
        assert set(member) == {i for p in pairs for i in p} and set(member.values()) <= set(member)
        assert _modularity(pairs, member) >= _modularity(pairs, _sequential(pairs)) - 0.005


def test_components_agree_with_union_find(spark, rows):
    r = random.Random(9)
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(24)]
    pairs = chain + [tuple(f"r{x:03}" for x in r.sample(range(300), 2)) for _ in range(160)] + [("h", f"x{i}") for i in range(40)] + [("s", "s")]
    parent: dict[str, str] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    got = dict(rows(communities.components(spark.createDataFrame(pairs, "src string, dst string"), spark.createDataFrame([("alone",)], "node string"))))
    least: dict[str, str] = {}
    for x in [*parent, "alone"]:
        least[root(x)] = min(x, least.get(root(x), x))
    assert got == {x: least[root(x)] for x in [*parent, "alone"] if x in got} and set(got) == {x for p in pairs for x in p} | {"alone"}
    assert rows(communities.components(spark.createDataFrame([], "src string, dst string"))) == []


def test_moving_on_blocks_shuffles_no_edge_in_a_pass(spark, rows, monkeypatch):
    """Passes by joins are for graphs too large for blocks only; both ways hold."""
    r = random.Random(3)
    pairs = sorted({tuple(sorted(r.sample(range(40), 2))) for _ in range(70)} | {(a, b) for a in range(40, 46) for b in range(40, a)})
    pairs = [(f"n{a:02}", f"n{b:02}") for a, b in pairs] + [("n00", "n00")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    by_joins = communities._by_joins
    monkeypatch.setattr(communities, "_by_joins", lambda *a: pytest.fail("joins"))
    for member in (dict(rows(communities.louvain(e))), dict(rows(communities.leiden(e)))):
        assert set(member) == {i for p in pairs for i in p} and set(member.values()) <= set(member)
        assert len({member[f"n{a}"] for a in range(40, 46)}) == 1
        groups = defaultdict(set)
        for i, c in member.items():
            groups[c].add(i)
        assert all(c == min(g) for c, g in groups.items())
    for c, g in groups.items():  # leiden's are connected
        seen, todo = {c}, [c]
        while todo:
            i = todo.pop()
            near = {b if a == i else a for a, b in pairs if i in (a, b)} & g - seen
            seen |= near
            todo += near
        assert seen == g
    assert rows(communities.louvain(e.where("src = dst"))) == []
    monkeypatch.undo()
    monkeypatch.setattr(communities.blocks, "MOST_NODES", 3)
    monkeypatch.setattr(communities, "_by_joins", lambda *a: by_joins(*a).withColumn("joins", communities.F.lit(1)))
    assert communities.louvain(e, 2, 0.5, False).columns[-1] == "joins"


def test_communities_are_described_and_checked_without_joins_of_edges(spark, rows, monkeypatch):
    r = random.Random(5)
    pairs = [(f"n{a:02}", f"n{b:02}") for a, b in (r.sample(range(60), 2) for _ in range(130))] + [("n01", "n01"), ("n02", "n03"), ("n03", "n02"), ("z", "z")]
    e = spark.createDataFrame(pairs, "src string, dst string")
    member = communities.louvain(e)
    want = rows(communities.described(e, member))
    monkeypatch.setattr(communities, "_inside", lambda *a: pytest.fail("joins"))
    assert rows(communities.louvain_described(e)) == want
    assert rows(communities.louvain_described(e.where("src = dst"))) == []
    graph = communities._graph(e, False)[1]
    for m in (member, member.where("node > 'n2'"), member.select("node", communities.F.lit("n01").alias("community"))):
        assert communities._modularity(graph, graph.groups(m)[0]) == pytest.approx(communities.modularity(communities.adjacency(e), m).first()[0], abs=2e-6)
    assert graph.groups(spark.createDataFrame([("n01", "n02"), ("no", "n01"), ("n02", "no")], "node string, community string"))[1] == 2
    assert rows(communities.louvain_checked(e, member)) == [(True, True, True, True)]
    one_each = member.select("node", communities.F.col("node").alias("community"))
    monkeypatch.setattr(communities, "_moved", lambda graph, *a: communities.np.arange(graph.n))
    assert rows(communities.louvain_checked(e, one_each)) == [(True, True, True, True)] and not communities.louvain_checked(e, member).first()["not_below_floor"]


def test_queries_of_communities_and_migration_store_no_whole_graph(spark, rows, monkeypatch):
    from codeloom.plans import reference

    monkeypatch.setattr(reference.Loaded, "_stores", {})
    monkeypatch.setattr(reference.Loaded, "_whole", lambda self: pytest.fail("whole graph"))
    sf = "/root/testdata/sf0.001"
    assert rows(reference.QUERIES["louvain_holds"](spark, sf)) == [(True, True, True, True)]
    assert reference.QUERIES["communities_described"](spark, sf).count() > 1
    assert reference.QUERIES["migrate_risk"](spark, sf).count() == reference.QUERIES["migrate_plan"](spark, sf).count() > 1
