import random

from codeloom.model import NODE, shaped
from codeloom.operators import analytics
from codeloom.plans import reference

KIND = "id string, project_id string, label string, fq_name string, name string, path string, file_id string, class_id string, is_test boolean"


def _graph(spark, seed=3, methods=40, classes=8, files=3):
    r = random.Random(seed)
    m = [(f"m{i}", "p", "Method", f"a.b.{'xyz'[i % 3]}.k.m{i}", f"m{i}", None, f"f{i % classes % files}", f"c{i % classes}", i % 7 == 0) for i in range(methods)]
    c = [(f"c{i}", "p", "Class", f"a.C{i}", f"C{i}", None, f"f{i % files}", None, None) for i in range(classes)]
    f = [(f"f{i}", "p", "File", f"s/{i}", f"{i}", f"s/{i}", None, None, None) for i in range(files)]
    e = {("p", "CALLS" if r.random() < 0.7 else "REFERENCES", f"m{r.randrange(methods)}", f"m{r.randrange(methods)}") for _ in range(methods)}
    e |= {("p", "IMPORTS", "f0", "c1"), ("p", "IMPORTS", "f2", "c1"), ("p", "IMPORTS", "m3", "c1")}
    return m, e, shaped(spark.createDataFrame(m + c + f, KIND), NODE), spark.createDataFrame(sorted(e), "project_id string, edge_type string, src string, dst string")


def _reach(e, start, depth):
    out, frontier = set(), {start}
    for _ in range(depth):
        frontier = {b for _, t, a, b in e if a in frontier and t in ("CALLS", "REFERENCES")}
        out |= frontier
    return out


def test_migration_counts_tests_to_depth_importers_and_modules(spark):
    m, e, nodes, edges = _graph(spark)
    of, name = {x[0]: x[7] for x in m}, {x[0]: x[3] for x in m}
    got = {r["fq_name"]: r for r in analytics.migrate_plan(nodes, edges).collect()}
    direct = {r["fq_name"]: r["tests"] for r in analytics.migrate_plan(nodes, edges, 1).collect()}
    for i in range(8):
        c, row = f"c{i}", got[f"a.C{i}"]
        covers = lambda d: sum(x[8] and x[7] != c and any(of[y] == c for y in _reach(e, x[0], d)) for x in m)  # noqa: E731, B023
        assert (row["tests"], direct[f"a.C{i}"]) == (covers(5), covers(1))
        callers = {a for _, t, a, b in e if t == "CALLS" and of[b] == c and of[a] != c}
        modules = {}
        for a in callers:
            k = ".".join(name[a].split(".")[:3])
            modules[k] = modules.get(k, 0) + 1
        assert (row["callers"], row["modules"], row["by_module"], row["importers"]) == (len(callers), len(modules), modules, 2 * (i == 1))
        assert row["risk"] == min(100, min(60, 6 * row["callers"]) + min(20, row["references"] * 2 // 5) + 20 * (row["tests"] == 0))
    assert any(got[k]["tests"] > direct[k] for k in got)


def test_pr_impact_of_all_files_reaches_three_edges(spark, rows):
    m, e, nodes, edges = _graph(spark, 4)
    files = nodes.where("label = 'File'").select(nodes["id"].alias("file_id"))

    def want(depth):
        out = []
        for f in range(3):
            own = {x[0] for x in m if x[6] == f"f{f}"}
            out.append((f"s/{f}", len(own), sum(t == "CALLS" and b in own for _, t, _, b in e), len(set().union(*[_reach(e, i, depth) for i in own]))))
        return out

    assert rows(analytics.pr_impact(nodes, edges, files)) == want(3) != want(2)
    assert rows(analytics.pr_impact(nodes, edges, files, 1)) == want(1)
    assert {"pr_impact", "migrate_plan"} <= set(reference.QUERIES)


def test_whole_flows_and_children(spark):
    sf = "/root/testdata/sf0.001"
    for kind in ("test", "rest"):
        assert max(len(r["reaches"].split("|")) for r in reference.QUERIES[f"flows_{kind}"](spark, sf).collect()) > 10
    kids = reference.QUERIES["bulk_contains_capped"](spark, sf).groupBy("container").count().collect()
    assert max(r["count"] for r in kids) > 5


def test_migration_writes_no_pair_of_a_test_and_a_node(spark, rows, monkeypatch):
    from codeloom.operators import coverage, traverse

    r = random.Random(8)
    m = [(f"m{i}", "p", "Method", f"a.{i % 9}.k.m{i % 50}", f"m{i}", None, "f0", None if i % 11 == 4 else f"c{i % 30}", None if i == 6 else i % 3 == 0) for i in range(300)]
    c = [(f"c{i}", "p", "Class", f"a.C{i}", f"C{i}", None, "f0", None, None) for i in range(33)]
    ends = [f"m{i}" for i in range(5, 300)] + [f"x{i}" for i in range(20)]  # some ends are no methods
    e = [("p", r.choice(("CALLS", "CALLS", "REFERENCES", "EXTENDS")), r.choice(ends), r.choice(ends)) for _ in range(900)]
    nodes, edges = shaped(spark.createDataFrame(m + c, KIND), NODE), spark.createDataFrame(e + e[:100], "project_id string, edge_type string, src string, dst string")
    found, counted = {}, coverage.counted
    monkeypatch.setattr(coverage, "counted", lambda *_: None)
    for depth in (1, 3, 5):
        found[depth] = rows(analytics.migrate_plan(nodes, edges, depth))
    monkeypatch.setattr(coverage, "counted", counted)
    written = []
    monkeypatch.setattr(traverse, "written", lambda df, label: written.append(label))
    for at_a_time in (1 << 20, 50):
        monkeypatch.setattr(coverage, "EDGES_AT_A_TIME", at_a_time)
        for depth, want in found.items():
            assert rows(analytics.migrate_plan(nodes, edges, depth)) == want
    assert rows(analytics.migrate_plan(nodes, edges, 5, brief=True)) == sorted((tuple(x[i] for i in (0, 1, 2, 4, 7, 8)) for x in found[5]), key=str)
    assert not written and found[5] != found[1]
