import pytest
from pyspark.sql import functions as F

from codeloom import util
from codeloom.model import EDGE, NODE, shaped
from codeloom.operators import traverse
from codeloom.plans import cypher
from codeloom.sources import store as S
from codeloom.sources.parsers import parse_file
from codeloom.streaming import watch


def _graph(spark, nodes, edges):
    n = spark.createDataFrame([(i, "p", label, f"x.{i}", i, path) for i, label, path in nodes], "id string, project_id string, label string, fq_name string, name string, path string")
    return shaped(n, NODE), shaped(spark.createDataFrame([("p", t, a, b) for a, t, b in edges], "project_id string, edge_type string, src string, dst string"), EDGE)


def _parts(store, what):
    return {k: tuple(v) for k, v in store.current()["parts"][what].items()}


def test_a_tree_of_any_depth_is_removed_with_its_file(spark, rows):
    nodes = [("f", "File", "a.py")] + [(f"c{i:02}", "Class", None) for i in range(40)] + [("g", "File", "b.py"), ("m", "Method", None)]
    edges = [("f", "CONTAINS", "c00")] + [(f"c{i:02}", "CONTAINS", f"c{i + 1:02}") for i in range(39)] + [("g", "CONTAINS", "m"), ("m", "CALLS", "c39"), ("c39", "CALLS", "m")]
    store = S.scratch(spark).save(*_graph(spark, nodes, edges))
    before = _parts(store, "nodes")
    store.remove_file("p", "a.py")
    assert rows(store.nodes.select("id")) == [("g",), ("m",)] and rows(store.edges.select("src", "dst")) == [("g", "m")]
    assert _parts(store, "nodes")["Method"] == before["Method"]  # a part that loses nothing is not written
    assert store.remove_file("p", "none.py").nodes.count() == 2


def test_a_merge_writes_only_the_parts_of_its_rows(spark, rows):
    store = S.scratch(spark).save(*_graph(spark, [("a", "Class", None), ("b", "Method", None)], [("a", "CONTAINS", "b"), ("b", "CALLS", "b")]))
    before, read = _parts(store, "nodes"), store.nodes
    n, e = _graph(spark, [("c", "Method", None), ("b", "Method", "new")], [("c", "CALLS", "b")])
    store.merge(n, e)
    assert _parts(store, "nodes")["Class"] == before["Class"] and rows(store.nodes.select("id", "path")) == [("a", None), ("b", "new"), ("c", None)]
    assert rows(read.select("id")) == [("a",), ("b",)]  # a reader of the version before
    assert rows(store.edges.select("edge_type", "src", "dst")) == [("CALLS", "b", "b"), ("CALLS", "c", "b"), ("CONTAINS", "a", "b")]
    store.merge(n, e)
    assert store.nodes.where(F.col("label") == "Method").count() == 2


def test_small_files_are_replaced_as_a_whole(spark, tmp_path):
    for text in ("one", "", "zwei ä"):
        util.put_text(spark, f"file://{tmp_path}/x", text)
        assert util.get_text(spark, f"file://{tmp_path}/x") == text
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x"] and util.get_text(spark, f"file://{tmp_path}/none") is None


def test_a_scope_deletes_what_was_written_in_it(spark):
    outer, at = util.written(spark.range(3), "outer")
    with util.scope(spark):
        _, inner = util.written(spark.range(3), "inner")
    fs, path = util.hadoop_path(spark, inner)
    assert not fs.exists(path) and outer.count() == 3
    util.drop_written(spark, at)


def test_a_file_that_fails_holds_no_other_up(spark, rows, monkeypatch):
    store = S.scratch(spark).save(*_graph(spark, [], []))
    whole = watch.graph_of

    def fails(events, project):
        if not events.where("path = 'bad.py'").isEmpty():
            raise RuntimeError("no")
        return whole(events, project)

    monkeypatch.setattr(watch, "graph_of", fails)
    w = watch.Watcher(store, "p")
    w.apply(spark.createDataFrame([("bad.py", "MODIFY", "def a():\n    pass\n", 1), ("good.py", "MODIFY", "def b():\n    pass\n", 2)], "path string, kind string, content string, seq long"))
    assert w.stats == {"batches": 1, "changed": 1, "deleted": 0, "failed": 1} and list(w.failures) == ["bad.py"]
    assert {r["path"] for r in store.nodes.where("label = 'File'").collect()} == {"good.py"}


def test_longest_chains_with_several_parents(spark, rows):
    e = lambda pairs: spark.createDataFrame([("p", "EXTENDS", a, b) for a, b in pairs], "project_id string, edge_type string, src string, dst string")
    assert rows(traverse.longest_chain(e([("a", "b"), ("b", "c"), ("a", "c"), ("d", "a"), ("d", "c"), ("x", "y"), ("y", "x"), ("z", "x"), ("z", "c")]))) == [("a", 2), ("b", 1), ("d", 3)]
    assert rows(traverse.longest_chain(e([(f"n{i:02}", f"n{i + 1:02}") for i in range(40)])))[0] == ("n00", 40)


def test_query_texts_search_to_the_end_and_give_no_unasked_pairs(spark, rows):
    nodes, edges = _graph(spark, [(f"c{i:02}", "Class", None) for i in range(25)], [(f"c{i:02}", "EXTENDS", f"c{i + 1:02}") for i in range(24)])
    assert cypher.run("MATCH (a:Class {name: 'c00'})-[:EXTENDS*]->(b:Class) RETURN count(b) AS n", nodes, edges, {}).first()[0] == 24
    assert cypher.run("MATCH (a:Class), (b:Class) WHERE a.name = b.name RETURN count(a) AS n", nodes, edges, {}).first()[0] == 25
    with pytest.raises(cypher.CypherError, match="all pairs"):
        cypher.run("MATCH (a:Class), (b:Class) WHERE a.name < b.name RETURN count(a) AS n", nodes, edges, {})


def test_annotations_far_before_a_declaration_are_seen():
    notes = "".join(f"    @Note{i}(\"{'x' * 40}\")\n" for i in range(30))
    text = "@RequestMapping(\"/api\")\n" + notes + "class C {\n    @GetMapping(\"/x\")\n" + notes + "    @Values({1, 2})\n    void f() { }\n}\n"
    assert any(e["op"] == "node" and e["label"] == "ApiEndpoint" and e["fq_name"] == "GET /api/x" for e in parse_file("C.java", text))
