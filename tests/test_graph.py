import datetime as dt

import pytest

from codeloom.operators.orphans import OrphanState
from codeloom.engine import GraphEngine
from codeloom.functions import text as X
from codeloom.model import NODE, shaped
from codeloom.operators import communities, ingest, rules, traverse
from codeloom.plans import cypher
from codeloom.sources import files
from codeloom.sources.parsers import parse_file
from codeloom.sources.store import scratch
from codeloom.streaming import watch

CLIQUES = [(a, b) for g in ("abcd", "wxyz") for i, a in enumerate(g) for b in g[i + 1 :]] + [("d", "w")]


def _edges(spark, pairs, kind="CALLS"):
    return spark.createDataFrame([("p", kind, a, b) for a, b in pairs], "project_id string, edge_type string, src string, dst string")


def _nodes(spark, ids):
    return shaped(spark.createDataFrame([(i, "p", "Method", f"x.{i}", i, False, None) for i in ids], "id string, project_id string, label string, fq_name string, name string, is_test boolean, file_id string"), NODE)


def test_search_reaches_the_start_only_on_a_circle(spark, rows):
    e = _edges(spark, [("1", "2"), ("2", "3"), ("3", "1"), ("3", "4")])
    assert rows(traverse.reached(e, traverse.one(spark, "1"), 8).select("node", "depth")) == [("1", 3), ("2", 1), ("3", 2), ("4", 3)]
    assert rows(traverse.reached(e, traverse.one(spark, "4"), 8)) == []
    assert rows(traverse.longest_chain(_edges(spark, [(str(i), str(i + 1)) for i in range(6)] + [("q", "r"), ("r", "q")], "EXTENDS"))) == [(str(i), 6 - i) for i in range(6)]


def test_shortest_paths(spark):
    e, n = _edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e")]), _nodes(spark, "abcde")
    assert traverse.shortest_path(n, e, "a", "e") == ["a", "b", "d", "e"] and traverse.shortest_path(n, e, "e", "a") is None and traverse.shortest_path(n, e, "a", "a") == []
    g = GraphEngine(n, e)
    assert g.trace("x.a", "x.e")["depth"] == 3 and g.trace("x.e", "x.a")["reason"] == "no-path" and g.trace("no", "x.a")["reason"] == "source-not-found"


def test_two_cliques_are_two_communities(spark, rows):
    e = _edges(spark, CLIQUES)
    groups: dict[str, set] = {}
    for node, c in rows(communities.leiden(e)):
        groups.setdefault(c, set()).add(node)
    assert sorted(map(sorted, groups.values())) == [list("abcd"), list("wxyz")]
    member = communities.louvain(e)
    adj = communities.adjacency(e)
    q = communities.modularity(adj, member).first()[0]
    assert q > communities.modularity(adj, member.withColumn("community", member["node"])).first()[0] and abs(q - (12 / 13 - 0.5)) < 1e-6
    d = communities.described(e, member).collect()
    assert [r["rank"] for r in d] == [1, 2] and {r["internal_edges"] for r in d} == {6} and {r["cohesion"] for r in d} == {1.0}
    assert {r[1] for r in rows(communities.components(_edges(spark, [("b", "a"), ("c", "b"), ("z", "y")])))} == {"a", "y"}


def test_placeholders_need_exactly_one_candidate(spark, rows):
    n = spark.createDataFrame([("h", "unresolved.f:1", "f", None), ("g", "unresolved.g:0", "g", None), ("f1", "A.f", "f", 1), ("f2", "B.f", "f", 2), ("g1", "A.g", "g", None), ("g2", "B.g", "g", 0)], "id string, fq_name string, name string, param_count long")
    e = spark.createDataFrame([("x", "h", 0.5), ("x", "g", 0.5), ("y", "h", None), ("x", "f1", 0.8)], "src string, dst string, confidence double")
    calls = ingest.resolved_calls(n, e)
    assert rows(calls) == [("x", "f1", 0.8), ("x", "g", 0.5), ("y", "f1", 0.7)] and rows(ingest.unused_placeholders(n, calls)) == [("h", "unresolved.f:1")]


def test_query_language(spark, rows):
    n, e = _nodes(spark, "abcd"), _edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("a", "d")])
    run = lambda t, **p: rows(cypher.run(t, n, e, p))
    assert run("MATCH (x {id: $i})-[:CALLS]->(y) RETURN y.name AS n ORDER BY n", i="a") == [("b",), ("d",)]
    assert run("MATCH (x)-[:CALLS*2..2]->(y) WHERE x.id = 'a' RETURN y.id") == [("c",)]
    assert run("MATCH p = shortestPath((x {id: 'a'})-[:CALLS*1..5]->(y {id: 'c'})) RETURN length(p) AS n") == [(2,)]
    assert run("MATCH (x) OPTIONAL MATCH (x)-[r:CALLS]->(y) RETURN x.id AS id, count(y) AS n") == [("a", 2), ("b", 1), ("c", 1), ("d", 0)]
    assert run("MATCH (x)-[:CALLS]->(y) WITH x, collect(y.name) AS ys WHERE size(ys) > 1 RETURN x.name AS n, ys[0] AS first, ys[0..1] AS some") == [("a", "b", ["b"])]
    assert run("MATCH (x) WHERE NOT EXISTS { MATCH (x)-[:CALLS]->() } RETURN x.id") == [("d",)]
    assert run("MATCH (x)<-[r]-(y) WHERE x.id IN $l AND type(r) = 'CALLS' RETURN DISTINCT y.id AS y", l=["b", "d"]) == [("a",)]
    assert run("UNWIND [1, 2, 3] AS v RETURN sum(v) AS s, max(v) / 2 AS h") == [(6, 1)]
    assert run("MATCH (x) WHERE x.name STARTS WITH 'a' OR x.name =~ '[cd]' RETURN CASE WHEN x.id = 'a' THEN 'SET ' ELSE coalesce(x.fileId, x.id) END AS v UNION MATCH (x {id: 'c'}) RETURN x.id AS v") == [("SET ",), ("c",), ("d",)]
    for bad in ("MATCH (x) DELETE x", "MATCH (x", "MATCH (x) RETURN x.id LIMIT $n", "RETURN", "MATCH (x) RETURN f(x.id)"):
        with pytest.raises(cypher.CypherError):
            run(bad)


def test_rules_are_layered(spark, rows):
    base = rules.Config.of({"thresholds": {"god-file": 7}, "disabled": ["dead-code"], "exclude": ["gen"], "custom": [{"name": "c", "query": "x"}]})
    top = rules.Config.of({"thresholds": {"god-file": 9}, "disabled": ["god-class"], "exclude": ["**/dist/**"], "custom": [{"name": "c", "query": "y", "severity": "error"}]})
    r = rules.resolved(base, top)
    assert r.thresholds == {"god-file": 9, "god-class": 20, "long-method": 80, "deep-inheritance": 5} and r.disabled == {"dead-code", "god-class"} and r.exclude == ["gen", "**/dist/**"] and [(c.query, c.severity) for c in r.custom] == [("y", "ERROR")]
    found = spark.createDataFrame([("WARN",)], "severity string")
    assert rules.guard_exit(found) == 0 and rules.guard_exit(found, True) == 1 and rows(rules.severity_totals(found)) == [("ERROR", 0), ("INFO", 0), ("WARN", 1)]


def test_scalars(spark):
    assert X.duration_seconds("15m") == 900 and X.duration_seconds("2 days") == 172800 and X.duration_seconds("x", 5) == 5
    with pytest.raises(ValueError):
        X.duration_seconds("soon")
    row = spark.range(1).select(X.module_prefix(X.F.lit("a.b.c.d")), X.excluded(X.F.lit("a\\gen\\b\\x"), ["gen/**/x"]), X.wildcard(X.F.lit("FooBar"), "bar*foo"), X.wildcard(X.F.lit("F"), "**")).first()
    assert tuple(row) == ("a.b.c", True, True, False)


JAVA = "package s.api;\n// class Fake { void fake() {} }\n@RequestMapping(\"/users\")\npublic class Ctl extends Base {\n  String t = \"class Nope {\";\n  public Ctl(String a) {}\n  @GetMapping(\"/{id}\")\n  public User get(String id) { return find(id, 1); }\n  private User find(String a, int b) { helper.save(a); return new User(); }\n}\n"
SOURCES = {
    "src/Ctl.java": JAVA, "db/s.sql": "CREATE TABLE users (id BIGINT PRIMARY KEY, email VARCHAR(9));\n-- CREATE TABLE commented (x INT);\nSELECT 'INSERT INTO fake' FROM users;\nINSERT INTO audit_log VALUES (1);", "app.yml": "a:\n  b: [1, 2]\n# fake: 1\n", "m/t.py": "import os\nfrom ..x import y\nclass A(B):\n    def f(self):\n        return g()\ndef g(): pass\n@app.get('/q')\ndef test_h(): f()\n'''def commented(): pass'''\n",
    "s.scss": ".btn { color: $c; @include mix; }\n/* .fake { } */\n$c: red;\n@mixin mix { }", "Dockerfile": "FROM node:20 AS build\nEXPOSE 80\nENV A=1\n", "pom.xml": "<project><properties><v>2</v></properties><dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId><version>${v}</version></dependency></dependencies></project>", "main.go": "package main\nfunc main() { run() }\nfunc run() {}\ntype T struct { a int }\nfunc (t *T) M() { run() }\n",
    "t.tf": 'resource "aws_x" "y" {\n a = var.z\n}\nvariable "z" {}\n', "a.proto": "message M { int32 a = 1; }\nservice S { rpc R (M) returns (M); }\n", "s.graphql": "type Q { a: Int }\n", "w.ts": "import { z } from './z';\nexport class K extends L { m(): void { this.n(); } n() { fetch('/api/x'); } }\n", "node_modules/x/i.js": "function no() {}", "notes.txt": "class Nope {}",
}


def test_parsers_find_declarations_and_nothing_in_comments():
    names = {(e["label"], e["fq_name"]) for p, t in SOURCES.items() for e in parse_file(p, t) if e["op"] == "node"}
    want = [("Class", "s.api.Ctl"), ("Method", "s.api.Ctl.<init>(String)"), ("Method", "s.api.Ctl.find(String,int)"), ("ApiEndpoint", "GET /users/{id}"), ("Table", "users"), ("Column", "users.email"), ("Table", "audit_log"), ("ConfigKey", "a.b[1]"), ("Class", "m/t.py::A"), ("Method", "m/t.py::A.f"), ("Module", "..x"), ("ApiEndpoint", "GET /q"), ("CssClass", "btn"), ("DesignToken", "$c"), ("CssMixin", "mix"), ("ContainerImage", "node:20"), ("ContainerPort", "80"), ("EnvVar", "A"), ("MavenDependency", "g:a"), ("Struct", "main.T"), ("Method", "main.T.M"), ("Resource", "aws_x.y"), ("ProtobufRpc", "S.R"), ("GraphqlField", "Q.a"), ("Class", "w.ts::K"), ("HttpCall", "GET /api/x")]
    assert [w for w in want if w not in names] == []
    assert not [n for n in names if any(x in n[1].lower() for x in ("fake", "commented", "nope"))]


def test_scan_store_and_stream(spark, rows, tmp_path):
    for path, text in SOURCES.items():
        (tmp_path / "tree" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / path).write_text(text)
    scan = files.scan_files(spark, str(tmp_path / "tree"))
    assert {r["path"] for r in scan.select("path").collect()} == set(SOURCES) - {"node_modules/x/i.js", "notes.txt"}
    assert files.changed_files(scan, scan.where("path <> 'app.yml'")).select("path").collect()[0][0] == "app.yml"
    store = scratch(spark).save(*files.graph_of(files.parsed(scan), "proj"))
    g = GraphEngine(store.nodes, store.edges, "proj")
    assert [r["fq_name"] for r in g.query("MATCH (a:Method)-[:CALLS]->(b:Method) WHERE a.fqName STARTS WITH 's.api.Ctl.get' RETURN b.fqName AS fq_name").collect()] == ["s.api.Ctl.find(String,int)"]
    assert g.db_impact("users").collect() == [] and g.nodes.where("label = 'File'").count() == 12
    before = store.nodes.count()
    store.merge(store.nodes.limit(3), store.edges.limit(3))
    assert store.nodes.count() == before
    batch = spark.createDataFrame([("main.go", "MODIFY", "package main\nfunc fresh() {}\n", 1), ("app.yml", "MODIFY", "a: 1", 2), ("app.yml", "DELETE", None, 3)], "path string, kind string, content string, seq long")
    batch.write.parquet(str(tmp_path / "changes"))
    w = watch.Watcher(store, "proj")
    watch.catch_up(spark.readStream.schema(batch.schema).parquet(str(tmp_path / "changes")), w, str(tmp_path / "cp"))
    names = {r[0] for r in store.nodes.select("fq_name").collect()}
    assert "main.fresh" in names and not names & {"main.run", "app.yml", "a.b[0]"} and w.stats == {"batches": 1, "changed": 1, "deleted": 1, "failed": 0}
    assert store.remove_project("proj") > 0 and store.nodes.count() == 0 and store.edges.count() == 0


def test_streams(spark, rows, tmp_path):
    t = dt.datetime(2025, 1, 1)
    ev = spark.createDataFrame([("f", "k", t, 2, 1), ("f", "k", t + dt.timedelta(1), 2, 2), ("f", "a", t, 1, None), ("f", "a", t + dt.timedelta(1), 2, 3), ("f", "b", t, 2, 4), ("f", "b", t + dt.timedelta(1), 1, None), ("f", "b", t + dt.timedelta(2), 0, None)], "field string, key string, at timestamp, kind int, row_no long")
    ev.write.parquet(str(tmp_path / "ev"))
    stream, state = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ev")), OrphanState(spark)
    watch.orphan_stream(stream, state, str(tmp_path / "state")).awaitTermination()
    assert rows(state.orphans().select("row_no", "state")) == [(1, "missing"), (2, "missing"), (4, "late")]
    more = spark.createDataFrame([("f", "b", t + dt.timedelta(3), 2, 9)], ev.schema)
    more.write.mode("append").parquet(str(tmp_path / "ev"))
    again = OrphanState(spark, state.folder)
    watch.orphan_stream(stream, again, str(tmp_path / "state")).awaitTermination()
    assert rows(again.orphans().select("row_no", "state")) == [(1, "missing"), (2, "missing"), (4, "late"), (9, "deleted")]
    table = spark.createDataFrame([(t, "x"), (t + dt.timedelta(minutes=5), "x"), (t + dt.timedelta(hours=2), "y")], "ts timestamp, event_type string")
    assert [(r[1], r[2]) for r in rows(watch.windowed_counts(table))] == [("x", 2), ("y", 1)]
