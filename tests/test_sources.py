import subprocess
import time

from codeloom.engine import GraphEngine
from codeloom.model import NODE, shaped
from codeloom.operators import ingest, match
from codeloom.plans import reports
from codeloom.sources import files
from codeloom.sources.store import scratch
from codeloom.streaming import watch


def _git(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@t", *args], check=True, capture_output=True)


def test_graphs_of_two_commits(spark, rows, tmp_path):
    _git(tmp_path, "init", "-q")
    (tmp_path / "a.py").write_text("def one():\n    pass\n")
    (tmp_path / "build").mkdir()
    (tmp_path / "build" / "b.py").write_text("def ignored():\n    pass\n")
    _git(tmp_path, "add", "-A")
    _git(tmp_path, "commit", "-qm", "1")
    first = subprocess.run(["git", "-C", str(tmp_path), "rev-parse", "HEAD"], capture_output=True, text=True).stdout.strip()
    (tmp_path / "a.py").write_text("def two():\n    pass\n")
    (tmp_path / "c.py").write_text("def three():\n    pass\n")
    _git(tmp_path, "add", "-A")
    _git(tmp_path, "commit", "-qm", "2")
    (old, _), (new, _) = files.snapshot_at(spark, str(tmp_path), "p", first), files.snapshot_at(spark, str(tmp_path), "p", "HEAD")
    of = lambda n: n.where("label = 'Method'")
    assert rows(ingest.diff_rows(of(old), of(new), ["fq_name"])) == [("a.py::one", "removed"), ("a.py::two", "added"), ("c.py::three", "added")]
    assert old.first()["project_id"] == f"p__sha_{first[:12]}"
    assert files.git_changes(str(tmp_path), first) == (["a.py", "c.py"], [])
    _git(tmp_path, "rm", "-q", "c.py")
    _git(tmp_path, "commit", "-qm", "3")
    assert files.git_changes(str(tmp_path), "HEAD~1") == ([], ["c.py"])


def test_projects_without_an_entry_are_told(spark, rows):
    n = shaped(spark.createDataFrame([("1", "p", "File"), ("2", "q", "File")], "id string, project_id string, label string"), NODE)
    assert rows(ingest.orphan_projects(n, spark.createDataFrame([("p",)], "project_id string"))) == [("q",)]
    assert rows(GraphEngine(n, n).tagged("node_counts").select("project_id", "count")) == [("p", 1), ("q", 1)] and not match.is_empty(n)


def test_monitors_and_progress(spark, tmp_path):
    schema = "path string, kind string, content string, seq long"
    spark.createDataFrame([("a.py", "MODIFY", "def a():\n    pass\n", 1)], schema).write.parquet(str(tmp_path / "in"))
    store, seen, all_ = scratch(spark), [], watch.Monitors()
    store.save(spark.createDataFrame([], NODE), spark.createDataFrame([], files.EDGE))
    listener = watch.ProgressEvents(seen.append)
    spark.streams.addListener(listener)
    w = watch.Watcher(store, "p")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    assert all_.start("t", w, stream, str(tmp_path / "cp")) and not all_.start("t", w, stream, str(tmp_path / "cp"))
    end = time.time() + 60
    while not w.stats["changed"] and time.time() < end:
        time.sleep(0.2)
    assert all_.running() == ["t"] and w.stats["changed"] == 1
    all_.stop("t")
    end = time.time() + 20
    while {"started", "ended"} - {x["event"] for x in seen} and time.time() < end:
        time.sleep(0.2)
    spark.streams.removeListener(listener)
    assert all_.running() == [] and {"started", "ended"} <= {x["event"] for x in seen} and store.nodes.where("label = 'Method'").count() == 1


def test_results_are_kept_for_a_while(spark):
    n = shaped(spark.createDataFrame([("1", "p", "File")], "id string, project_id string, label string"), NODE)
    cache, runs = reports.ResultCache(scratch(spark).save(n, spark.createDataFrame([], files.EDGE)), seconds=3600), []
    count = lambda nodes, edges: runs.append(1) or match.node_counts(nodes)
    cache.warm({("n",): count})
    assert cache.get(("n",), count).first()["count"] == 1 and len(runs) == 1
    cache.seconds = 0
    assert cache.get(("n",), count).first()["count"] == 1 and len(runs) == 2
    cache.clear()
