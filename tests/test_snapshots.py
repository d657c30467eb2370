import datetime as dt
import random

from pyspark.sql import functions as F

from codeloom.operators import snapshots as S

SCHEMA = "snapshot_no int, delivered_at timestamp, project_id string, label string, fq_name string, callee_count long, file_id string, start_line long, end_line long, bucket string, v string, chunk int"
DAY = dt.datetime(2025, 1, 1)


def _row(no, project, name, count=1, file="f", at=0):
    return (no, DAY + dt.timedelta(minutes=at), project, "Class", name, count, file, 1, 2, "clash", "clash", 0)


def _changes(spark, data, **kw):
    return S.snapshot_changes(spark.createDataFrame(data, SCHEMA), "slice_nodes", S.node_key(), ["callee_count", "file_id", "start_line", "end_line"], **kw)


def test_added_removed_changed_and_missed_deliveries(spark, rows):
    data = [_row(1, "p", "a"), _row(1, "p", "b"), _row(1, "p", "c"), _row(3, "p", "a"), _row(3, "p", "b", 2), _row(3, "p", "d"), _row(2, "q", "x")]
    got = {(r[1], r[2], r[3], r[4]) for r in rows(_changes(spark, data))}
    assert got == {(3, "p", "Class:b", "changed"), (3, "p", "Class:c", "removed"), (3, "p", "Class:d", "added")}


def test_the_newest_delivery_counts_and_null_is_a_value(spark, rows):
    data = [_row(1, "p", "a", 1, at=5), _row(1, "p", "a", 9, at=1), _row(2, "p", "a", 1, at=9), _row(2, "p", "a", 9, at=2), _row(2, "p", "a", 1, at=9)]
    data += [_row(1, "p", "n", None), _row(2, "p", "n", None), _row(1, "p", "m", None), _row(2, "p", "m", 0), _row(1, "p", None), _row(2, "p", "z", file=None), _row(1, "p", "z", file=None)]
    assert [r[3:] for r in rows(_changes(spark, data))] == [("Class:m", "changed")]


def test_chunks_of_any_size_agree_with_brute_force(spark, rows):
    rng = random.Random(5)
    state = {f"n{i}": 0 for i in range(400)}
    data, want, before = [], set(), None
    for no in (1, 2, 3):
        for k in rng.sample(sorted(state), 25):
            del state[k]
        for k in rng.sample(sorted(state), 25):
            state[k] += 1
        state |= {f"x{no}_{i}": 0 for i in range(20)}
        data += [_row(no, "p", k, v) for k, v in state.items()] * 2
        if before is not None:
            want |= {(no, f"Class:{k}", "added") for k in state.keys() - before.keys()} | {(no, f"Class:{k}", "removed") for k in before.keys() - state.keys()} | {(no, f"Class:{k}", "changed") for k in state.keys() & before.keys() if state[k] != before[k]}
        before = dict(state)
    for kw in ({"range_rows": 10**6, "chunk_rows": 4}, {"range_rows": 500, "chunk_rows": 64}, {"range_rows": 20}, {}):
        got = [(r[1], r[3], r[4]) for r in rows(_changes(spark, data, **kw))]
        assert len(got) == len(set(got)) and set(got) == want


def test_equal_chunks_are_discarded(spark):
    same = [_row(no, "p", f"n{i}", i) for no in (1, 2, 3) for i in range(600)]
    moved = [(*r[:5], (r[5] or 0) + 1, *r[6:]) if r[0] == 3 and r[4] == "n7" else r for r in same]
    report = lambda data: {r["snapshot_no"]: r for r in S.chunk_report(spark.createDataFrame(data, SCHEMA), "slice_nodes", S.node_key(), ["callee_count", "file_id", "start_line", "end_line"]).collect()}
    got = report(same)
    assert set(got) == {2, 3} and all(r["n_matched"] == r["n_chunks"] > 40 and r["n_discarded"] == r["n_rows"] == 600 for r in got.values())
    got = report([*moved, *[_row(3, "p", f"x{i}") for i in range(3)]])
    assert got[3]["n_rows"] == 603 and got[3]["n_discarded"] > 480 and got[3]["n_chunks"] - got[3]["n_matched"] <= 7 and got[2]["n_discarded"] == 600


def test_nulls_that_change_places_are_seen(spark, rows):
    data = [(1, DAY, "p", "Class", "a", None, "f", 5, None, "", "", 0), (2, DAY, "p", "Class", "a", None, "f", None, 5, "", "", 0), (1, DAY, None, "Class", "a", 1, "f", 5, 5, "", "", 0), (2, DAY, None, "Class", "b", 1, "f", 5, 5, "", "", 0)]
    assert [r[3:] for r in rows(_changes(spark, data))] == [("Class:a", "changed")]


def test_empty_table_and_edges(spark, rows):
    assert rows(_changes(spark, [])) == []
    edges = spark.createDataFrame([(1, DAY, "p", "1", "a", "b", "CALLS"), (2, DAY, "p", "1", "a", "b", "USES"), (2, DAY, "p", "2", "a", None, "USES")], "snapshot_no int, delivered_at timestamp, project_id string, id string, source string, target string, type string")
    assert rows(S.snapshot_changes(edges, "slice_edges", S.edge_key(), ["type"])) == [("slice_edges", 2, "p", "a>b", "changed")]
    assert edges.where(F.lit(True)).count() == 3
