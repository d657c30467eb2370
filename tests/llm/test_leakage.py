import random
import time

import numpy as np

from codeloom.llm import leakage
from codeloom.llm.leakage import Items, leaked
from codeloom.llm.wikitext import page_words, render

ITEM = "The lukewarm chandler trades 973 barrels of which 810 belong to Corunval near the weightless mill during the knotted fair while Gantes sleeps"


def _found(spark, texts, items=((1, ITEM),)):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    bench = spark.createDataFrame(list(items), "item_id long, text string")
    return sorted((r["doc_id"], r["item_id"]) for r in leaked(docs, bench).where("leak = 'passage'").collect())


def test_rendering():
    text = "'''A''' [[b|c]]d <!-- x -->[[e]]s{{t|{{u}}|v}} <ref name=a>n</ref>f<ref name=a/> [http://h.x label]\n{| class=x\n|-\n| style=\"q\" | g || h\n|}\n== i ==\n[[Category:J]] k&nbsp;l<br>m <b>n</b>o {{ open"
    assert page_words(text) == "a cd es f label g h i k l m no open".split()
    assert render("x <!-- open") == "x " and page_words("[[File:a.png|thumb|the caption]] z") == ["the", "caption", "z"]


def test_deep_nesting_takes_linear_time():
    deep = "{{a|" * 60_000 + "b" + "}}" * 60_000 + " end"
    assert page_words(deep) == ["end"]
    assert page_words("<ref>" * 50_000 + "x")[-1] == "x"


def test_passages_whatever_their_dress(spark):
    w = ITEM.split()
    thirteen, twelve = " ".join(w[3:16]), " ".join(w[3:15])
    dressed = " ".join(w[3:8]).upper() + ",\n''" + " ".join(w[8:11]) + "''<!-- c -->{{citation needed}} [[x|" + w[11] + "]] " + " ".join(w[12:16]).replace("e", "е")
    texts = [f"so {thirteen}, and", f"so {twelve} and", dressed, f"x <!-- {thirteen} -->", f"<ref>{thirteen}</ref>", "{{quote|" + thirteen + "}}", thirteen.replace("belong", "belongs"), None, "", thirteen.replace(" ", "\u00a0\u200b"), f"{thirteen} {thirteen}"]
    assert _found(spark, texts) == [(0, 1), (2, 1), (9, 1), (10, 1)]


def test_short_null_and_shared_items(spark):
    items = [(1, ITEM), (2, "prefix words " + ITEM), (3, "too short"), (4, None), (5, "")]
    assert _found(spark, [ITEM], items) == [(0, 1), (0, 2)]
    assert _found(spark, [], items) == [] and _found(spark, [ITEM], []) == []


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    items = [(i, f"{i} " + ITEM) for i in range(9)]
    monkeypatch.setattr(leakage, "BLOCK_CHARS", 300)
    assert _found(spark, ["z " + ITEM], items) == [(0, i) for i in range(9)]


def test_reordered_passages_are_covered_by_tiles():
    a, b = ITEM.split()[:13], ITEM.split()[13:]
    known = Items([(1, ITEM)], least=7)
    tiles = known.tiles([x.lower() for x in [*b, "gap", *a]])[1]
    assert sum(t[0] for t in tiles) == len(a) + len(b) and len(tiles) == 2


def test_a_cut_up_item_leaks_by_coverage(spark):
    w = ITEM.lower().split()
    moved = " and then ".join(" ".join(w[i : i + 6]) for i in (18, 0, 12, 6))
    docs = spark.createDataFrame([(1, moved), (2, " and then ".join(" ".join(w[i : i + 4]) for i in range(0, 24, 4))), (3, " ".join(w[:8]))], "doc_id int, text string")
    got = [tuple(r) for r in leaked(docs, spark.createDataFrame([(9, ITEM)], "item_id long, text string")).collect()]
    assert got == [(1, 9, 6, len(w), len(w), "coverage")]


def test_time_is_linear_in_long_copies():
    rng = random.Random(4)
    long = [f"w{rng.randrange(3000)}" for _ in range(4000)]
    for item, doc, n in ((long, long, 4000), (["a"] * 200, ["a"] * 400, 200)):
        known = Items([(1, " ".join(item))])
        began = time.process_time()
        tiles = known.tiles(doc)[1]
        assert time.process_time() - began < 0.5 and tiles[0] == (n, 0, 0) and sum(t[0] for t in tiles) == n


def test_the_running_hash_is_that_of_each_window():
    ids = np.random.default_rng(1).integers(0, 1000, 300)
    ids[200:240] = ids[100:140]
    h = leakage.rolling(ids, 7)
    assert len(h) == 294 and h[205] == h[105] and len(set(h.tolist())) == len({tuple(ids[i : i + 7]) for i in range(294)})
    assert len(leakage.rolling(ids[:6], 7)) == 0


def test_seeds_in_many_parts_give_the_same(monkeypatch):
    item, doc = "a b a b a a b b a b a".split(), "a b a a b a b a b b a b a a".split()
    known = Items([(1, " ".join(item)), (2, " ".join(item[3:]))], least=3)
    want = known.tiles(doc)
    monkeypatch.setattr(leakage, "_PAIRS", 2)
    assert known.tiles(doc) == want


def _tiled(doc, item, least):
    """Greedy string tiling by its definition."""
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = None
        for p in range(len(doc)):
            for q in range(len(item)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and free_d[p + n] and free_i[q + n]:
                    n += 1
                if n >= least and (best is None or (-n, p, q) < best):
                    best = (-n, p, q)
        if best is None:
            return out
        n, p, q = -best[0], best[1], best[2]
        out.append((n, p, q))
        for k in range(n):
            free_d[p + k] = free_i[q + k] = False


def test_tiles_agree_with_the_definition():
    rng = random.Random(8)
    for _ in range(150):
        item, doc = ([rng.choice("abc") for _ in range(n)] for n in (rng.randrange(3, 16), rng.randrange(0, 30)))
        assert Items([(1, " ".join(item))], least=3).tiles(doc).get(1, []) == _tiled(doc, item, 3)


def test_tiles_agree_with_brute_force():
    rng = random.Random(2)
    for _ in range(60):
        item, doc = ([rng.choice("abc") for _ in range(n)] for n in (rng.randrange(4, 14), rng.randrange(0, 25)))
        known = Items([(1, " ".join(item))], least=4)
        longest = max((n for p in range(len(doc)) for q in range(len(item)) for n in range(1, 14) if doc[p : p + n] == item[q : q + n] and p + n <= len(doc) and q + n <= len(item)), default=0)
        tiles = known.tiles(doc).get(1, [])
        assert max((t[0] for t in tiles), default=0) == (longest if longest >= 4 else 0)
        for spans in ([(p, p + n) for n, p, _ in tiles], [(q, q + n) for n, _, q in tiles]):
            assert all(x[1] <= y[0] for x, y in zip(sorted(spans), sorted(spans)[1:]))
        assert all(doc[p : p + n] == item[q : q + n] for n, p, q in tiles)
