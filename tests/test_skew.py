from collections import Counter

from codeloom.operators import skew

EDGES = "source string, target string, edges long, node_id string"
NODES = "id string, callee_count long, callees string"


def _edges(spark, pairs):
    return spark.createDataFrame([(s, t, -1, "clash") for s, t in pairs], EDGES)


def test_heavy_keys_count_rows_as_they_stand(spark, rows):
    pairs = [("a", "hot")] * 500 + [(f"s{i}", f"t{i}") for i in range(499)] + [(None, "x"), ("y", None), ("y", None)]
    got = rows(skew.heavy_keys(_edges(spark, pairs).repartition(7), ["target", "source"]))
    assert got == [("source", "a", 500), ("target", "hot", 500)]


def test_key_figures_match_brute_force(spark, rows):
    pairs = [(f"s{i % 7}", "hot") for i in range(300)] + [(f"s{i}", f"t{i % 5}") for i in range(60)] + [(None, "hot"), ("s1", None)]
    nodes = spark.createDataFrame([("s1", 3, "z"), ("s1", 4, "z"), ("s2", None, "z"), (None, 9, "z"), ("hot", 0, "z"), ("lone", 5, "z")], NODES)
    got = {(f, k): (e, p, c) for f, k, e, p, c in rows(skew.key_figures(_edges(spark, pairs), nodes))}
    callees = {"s1": 7, "hot": 0}
    for field, i in (("source", 0), ("target", 1)):
        for key, n in Counter(p[i] for p in pairs if p[i]).items():
            partners = len({p[1 - i] for p in pairs if p[i] == key and p[1 - i]})
            assert got.pop((field, key)) == (n, partners, callees.get(key))
    assert got == {("source", "lone"): (0, 0, 5)}


def test_a_small_dictionary_gives_the_same_sums(spark, rows, monkeypatch):
    df = spark.createDataFrame([(f"k{i % 50}", i) for i in range(1000)], "k string, w int").coalesce(1)
    want = rows(skew.dense_key_sums(df, ["k"], {"n": None, "w": "w"}))
    monkeypatch.setattr(skew, "DICTIONARY_KEYS", 10)
    assert rows(skew.dense_key_sums(df, ["k"], {"n": None, "w": "w"})) == want
    assert sum(r[2] for r in want) == 1000 and sum(r[3] for r in want) == sum(range(1000))


def test_empty_tables_give_nothing(spark, rows):
    none = _edges(spark, [])
    assert rows(skew.heavy_keys(none, ["target"])) == []
    assert rows(skew.key_figures(none, spark.createDataFrame([], NODES))) == []
    assert rows(skew.heaviest_callers(spark.createDataFrame([], NODES))) == []
