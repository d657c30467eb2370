import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from codeloom.operators import orphans as O

T = lambda d: dt.datetime(2025, 1, 1) + dt.timedelta(days=d)
NODES = "snapshot_no int, snapshot_at timestamp, project_id string, id string, fq_name string, at string, key string"
KEYS = "event_no long, to_id string, ingested_at timestamp, field string"
FINDINGS = "finding_id long, project_id string, subject string, file_id string, found_at timestamp"
LIBRARY = "id string, project_id string, fq_name string"
FILES = "file_id string, first_seen_at timestamp, removed_at timestamp"


def _tables(spark, nodes=(), keys=(), findings=(), library=(), files=()):
    df = lambda r, s: spark.createDataFrame(list(r), s)
    return O.reference_events(df(keys, KEYS), df(findings, FINDINGS)), O.parent_events(df(nodes, NODES), df(library, LIBRARY), df(files, FILES))


def _state(spark, *tables, **named):
    return O.replayed(*_tables(spark, *tables, **named))


def _node(no, day, project, node):
    return (no, T(day), project, node, f"fq.{node}", "clash", "clash")


def test_states_of_references(spark, rows):
    nodes = [_node(1, 0, "p", "a"), _node(1, 0, "p", "a"), _node(2, 40, "p", "b"), _node(3, 80, "p", "a"), _node(1, 0, "q", "c")]
    keys = [(1, "a", T(1), ""), (1, "a", T(1), ""), (2, "a", T(40), ""), (3, "a", T(80), ""), (4, "b", T(2), ""), (5, "nil", T(2), ""), (6, None, T(2), ""), (7, "lib", T(-9), ""), (8, "c", T(500), ""), (9, "a", T(-1), ""), (10, "A", T(1), "")]
    findings = [(1, "p", "fq.a", "f", T(5)), (2, "q", "fq.a", "g", T(5)), (3, "s", "fq.lib", "f", T(30)), (4, "p", None, None, T(5)), (5, "p", "fq.b", "f", T(-5))]
    got = rows(_state(spark, nodes, keys, findings, [("lib", "s", "fq.lib")], [("f", T(0), T(30)), ("f", T(0), T(30))]).orphans())
    assert got == sorted([
        ("edge_keys", "to_id", 2, "deleted", "2025-02"), ("edge_keys", "to_id", 4, "late", "2025-01"), ("edge_keys", "to_id", 5, "missing", "2025-01"), ("edge_keys", "to_id", 9, "late", "2024-12"), ("edge_keys", "to_id", 10, "missing", "2025-01"),
        ("findings", "subject", 2, "missing", "2025-01"), ("findings", "subject", 5, "late", "2024-12"), ("findings", "file_id", 2, "missing", "2025-01"), ("findings", "file_id", 3, "deleted", "2025-01"), ("findings", "file_id", 5, "late", "2024-12"),
    ], key=str)


def _judged(nodes, keys):
    """References that find no record, one by one."""
    days = sorted({n[1] for n in nodes})
    there = {d: {n[3] for n in nodes if n[1] == d} for d in days}
    out = []
    for no, key, t, _ in keys:
        past = [d for d in days if d <= t]
        if not past or key not in there[past[-1]]:
            ever, seen = any(key in x for x in there.values()), any(key in there[d] for d in past)
            out.append((no, "missing" if not ever else "deleted" if seen else "late", t.strftime("%Y-%m")))
    return sorted(out)


def _random(seed):
    rng = random.Random(seed)
    nodes = [_node(n, 30 * n, "p", k) for n in range(4) for k in "abcdef" if rng.random() < 0.6] + [_node(n, 30 * n, "p", "z") for n in range(4)]
    return nodes, [(i, "a" if i % 2 else rng.choice("abcdefgh"), T(rng.randrange(-10, 130)), "") for i in range(400)]


def test_months_of_events_agree_with_one_by_one_judgement(spark, rows):
    for seed in (3, 4):
        nodes, keys = _random(seed)
        state = _state(spark, nodes, [*keys, *keys[:50]])
        assert sorted((r[2], r[3], r[4]) for r in rows(state.orphans())) == _judged(nodes, keys)
        assert sum(r["orphaned"] for r in state.counts().collect()) == len(_judged(nodes, keys))


def test_any_cut_into_batches_gives_the_same(spark, rows):
    nodes, keys = _random(5)
    events = O.graph_events(*(spark.createDataFrame(r, s) for r, s in ((keys, KEYS), ([], FINDINGS), (nodes, NODES), ([], LIBRARY), ([], FILES)))).cache()
    whole = O.OrphanState(spark)
    whole.apply(events)
    for cuts in ([T(31)], [T(0), T(30), T(31), T(60), T(100)]):
        parts = O.OrphanState(spark)
        for n, (a, b) in enumerate(zip([T(-99), *cuts], [*cuts, T(999)])):
            parts.apply(events.where((F.col("at") >= F.lit(a)) & (F.col("at") < F.lit(b))), number=n)
        parts.apply(events, number=0)  # brought in before
        assert rows(parts.orphans()) == rows(whole.orphans()) and rows(parts.counts()) == rows(whole.counts())
        again = O.OrphanState(spark, parts.folder)
        assert rows(again.counts()) == rows(whole.counts())
    late = O.OrphanState(spark)
    late.apply(events.where("kind <> 2"))
    late.apply(events.where("kind = 2"))
    assert rows(late.orphans()) == rows(whole.orphans())


def test_a_batch_that_fails_changes_nothing(spark, rows):
    state = _state(spark, [_node(1, 0, "p", "a")], [(1, "nil", T(1), "")])
    before, now = rows(state.orphans()), dict(state.now)
    bad = spark.createDataFrame([("to_id", "x", T(2), 2, 5)], "field string, key string, at timestamp, kind int, row_no long").withColumn("row_no", F.raise_error(F.lit("no")).cast("bigint"))
    with pytest.raises(Exception, match="no"):
        state.apply(bad)
    assert state.now == now and rows(state.orphans()) == before


def test_pending_counts(spark, rows):
    nodes = [_node(1, 31, "p", "a"), _node(2, 59, "p", "b"), _node(3, 90, "p", "a")]
    keys = [(1, "a", T(1), ""), (2, "a", T(2), ""), (3, "a", T(40), ""), (4, "nil", T(3), "")]
    state = _state(spark, nodes, keys)
    assert [r[2:] for r in rows(state.counts().select('table_name', 'field', 'period', 'orphaned', 'resolved', 'reopened', 'pending'))] == [("2025-01", 3, 0, 0, 3), ("2025-02", 0, 2, 0, 1), ("2025-03", 0, 0, 3, 4), ("2025-04", 0, 3, 0, 1)]


def test_a_parent_in_every_delivery_changes_nothing(spark, rows):
    nodes = [_node(n, 30 * n, "p", "a") for n in range(1, 5)]
    assert rows(_state(spark, nodes, [(1, "a", T(35), "")]).counts()) == []


def test_empty_tables(spark, rows):
    state = _state(spark)
    assert rows(state.orphans()) == [] and rows(state.counts()) == []
