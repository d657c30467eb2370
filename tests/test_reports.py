import datetime as dt

from codeloom.model import EDGE, NODE, shaped
from codeloom.operators import match
from codeloom.plans import reports
from codeloom.sources.store import scratch


def test_reports_and_cache(spark):
    t = dt.datetime(2025, 1, 1)
    nodes = shaped(spark.createDataFrame([("a", "p", "Class", "x|y", t), ("b", "p", "Class", "z", t + dt.timedelta(1)), ("c", "p", "Method", "m", t)], "id string, project_id string, label string, fq_name string, last_ingested_at timestamp"), NODE)
    edges = shaped(spark.createDataFrame([("p", "CONTAINS", "a", "c")], "project_id string, edge_type string, src string, dst string"), EDGE)
    assert reports.changelog(nodes, dt.datetime(2024, 1, 1), 1) == "# Changelog\n\n## Class (2)\n\n- `z`\n- … 1 more\n\n## Method (1)\n\n- `m`\n"
    assert reports.markdown_table(nodes.where("id = 'a'").select("id", "fq_name", "name")) == "| id | fq_name | name |\n|---|---|---|\n| a | x\\|y |  |"
    assert reports.badges("<!-- badge:guard -->old<!-- /badge -->", {"guard": reports.guard_badge(nodes, edges)}) == "<!-- badge:guard -->guard: passing (0 errors, 0 warnings)<!-- /badge -->"
    store = scratch(spark).save(nodes, edges)
    cache, runs = reports.ResultCache(store, most=2), []

    def counts(n, e):
        runs.append(1)
        return match.node_counts(n)

    for _ in range(2):
        assert {tuple(r) for r in cache.get(("counts",), counts).collect()} == {("Class", 2), ("Method", 1)}
    for k in range(4):
        cache.get((k,), lambda n, e: match.edge_counts(n, e))
    store.remove(spark.createDataFrame([("a",)], "id string"))
    assert {tuple(r) for r in cache.get(("counts",), counts).collect()} == {("Class", 1), ("Method", 1)} and len(runs) == 2 and len(cache.kept) == 1
