import datetime as dt
import random

from codeloom.operators import hierarchy as H

SCHEMA = "event_no long, from_id string, type string, to_id string, ingested_at timestamp, node_id string, path string"
DAY = dt.datetime(2025, 1, 1)


def _log(spark, links):
    return spark.createDataFrame([(e, a, t, b, DAY + dt.timedelta(minutes=m), "clash", "clash") for e, a, t, b, m in links], SCHEMA)


def _tree(spark, links, **kw):
    return H.hierarchy(H.tree_links(_log(spark, links)), **kw)


def test_paths_circles_and_replaced_links(spark, rows):
    links = [(1, "r", "CONTAINS", "a", 0), (2, "a", "CONTAINS", "b", 0), (3, "x", "CONTAINS", "b", 5), (4, "x", "CONTAINS", "b", 9), (5, "a", "CONTAINS", "b", 9), (6, None, "CONTAINS", "q", 0), (7, "q", "CONTAINS", None, 0)]
    links += [(8, "c1", "CONTAINS", "c2", 0), (9, "c2", "CONTAINS", "c1", 0), (10, "c1", "CONTAINS", "below", 0), (11, "self", "CONTAINS", "self", 0), (12, "sub", "EXTENDS", "sup", 0), (13, "r", "CALLS", "z", 0)]
    got = {(r["type"], r["node_id"]): (r["root_id"], r["depth"], r["path"]) for r in _tree(spark, links).collect()}
    assert got == {
        ("CONTAINS", "a"): ("r", 1, ["r", "a"]), ("CONTAINS", "b"): ("r", 2, ["r", "a", "b"]), ("CONTAINS", "c1"): ("", -1, None), ("CONTAINS", "c2"): ("", -1, None), ("CONTAINS", "below"): ("", -1, None), ("CONTAINS", "self"): ("", -1, None),
        ("EXTENDS", "sub"): ("sup", 1, ["sup", "sub"]),
    }


def test_a_deep_random_forest_agrees_with_brute_force(spark, rows):
    rng = random.Random(11)
    parent = {f"n{i}": f"n{max(0, i - rng.choice((1, 1, 1, 2, 9)))}" for i in range(1, 150)} | {f"h{i}": "n0" for i in range(60)}
    got = {r["node_id"]: r for r in H.tree_sizes(_tree(spark, [(i, p, "CONTAINS", c, 0) for i, (c, p) in enumerate(parent.items())])).collect()}
    below = dict.fromkeys(parent, 0)
    for n in parent:
        path = [n]
        while path[-1] in parent:
            path.append(parent[path[-1]])
        assert got[n]["path"] == path[::-1] and got[n]["depth"] == len(path) - 1 and got[n]["root_id"] == "n0"
        for a in path[1:-1]:
            below[a] += 1
    assert {n: r["descendants"] for n, r in got.items()} == below


def test_only_circles_and_nothing_at_all(spark, rows):
    assert rows(_tree(spark, [(1, "a", "EXTENDS", "b", 0), (2, "b", "EXTENDS", "a", 0)], with_path=False).select("node_id", "root_id", "depth")) == [("a", "", -1), ("b", "", -1)]
    assert rows(_tree(spark, [])) == []
