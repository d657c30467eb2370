import random
import unicodedata

from codeloom.llm import chars
from codeloom.llm.lookalike import consistent_form, lookalike_pairs

BASE = "The wooden abbey of Çalven, p. 12: ½ of the café – open since 1204"


def _docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")


ALIKE = [
    BASE, BASE.replace("wooden", "wооden"), BASE.replace("wooden", "wοoden").replace("abbey", "аbbey"), unicodedata.normalize("NFD", BASE), BASE.replace(" of ", "\u00a0of\u2009"), BASE.replace("abbey", "ab\u200bbey"), BASE.replace("1204", "１２０４"), BASE.replace("café", "ca\u00adfe\u2060\u0301"), BASE.replace("of", "оf"), BASE,
]
APART = [BASE.upper(), BASE.replace("é", "e"), BASE.replace("½", "1/2"), BASE.replace("–", "-"), BASE.replace(" of ", "\nof "), BASE.replace("12", "¹²"), BASE + " "]


def test_pairs_of_texts_that_look_the_same(spark, rows):
    got = rows(lookalike_pairs(_docs(spark, [*ALIKE, *APART, None, "", ""])))
    want = [(a, b) for a in range(len(ALIKE)) for b in range(a + 1, len(ALIKE)) if ALIKE[a] != ALIKE[b]]
    assert sorted(got) == want


def test_words_that_only_mixed_spellings_share_meet(spark, rows):
    assert rows(lookalike_pairs(_docs(spark, ["xq flоodеd zq", "xq flооded zq"]))) == [(0, 1)]


def test_real_words_of_other_scripts_stay(spark):
    texts = ["Старый мост около леса", "Η πόλη και το ποτάμι", "ordinary wоrds", "ordinary words"]
    got = {r["doc_id"]: r["form"] for r in consistent_form(_docs(spark, texts)).collect()}
    assert got == {0: texts[0], 1: texts[1], 2: texts[3], 3: texts[3]}


def test_a_repair_nobody_writes_is_left(spark):
    docs = _docs(spark, ["unique wоrdz here", None, ""])
    assert {r["doc_id"]: r["form"] for r in consistent_form(docs).collect()} == {0: "unique wоrdz here", 1: None, 2: ""}


def test_words_of_one_script_stay_in_texts_of_another(spark):
    greek, russian = "Η πόλη και το ποτάμι The THE is λιμάνι", "Старый мост is The ТНЕ река"
    texts = [greek, russian, "plain words is The THE", "more plain words is The THE", "is іѕ THE ΤΗΕ cat"]
    got = {r["doc_id"]: r["form"] for r in consistent_form(_docs(spark, texts)).collect()}
    # the look-alike spellings occur in Latin texts as well: there they are repaired
    assert got == {0: greek, 1: russian, 2: texts[2], 3: texts[3], 4: "is is THE THE cat"}


def test_words_of_look_alikes_only_agree_within_texts_of_one_script(spark, rows):
    texts = ["Старый мост х река", "Старый мост x река", "Новый х лес", "plain x words", "plain х words", "plain x other"]
    got = {r["doc_id"]: r["form"] for r in consistent_form(_docs(spark, texts)).collect()}
    assert got == {0: texts[0], 1: texts[0], 2: texts[2], 3: texts[3], 4: texts[3], 5: texts[5]}
    assert rows(lookalike_pairs(_docs(spark, texts))) == [(0, 1), (3, 4)]


def test_a_repair_is_whole_or_none(spark):
    # q has no Greek look-alike: the word can't be written in one script, its most frequent spelling is taken
    texts = ["Ωqο leaf", "Ωqο tree", "Ωqo leaf"]
    got = {r["doc_id"]: r["form"] for r in consistent_form(_docs(spark, texts)).collect()}
    assert got == {0: texts[0], 1: texts[1], 2: texts[0]}


def test_forms_are_equal_for_texts_that_look_alike_and_for_no_others(spark):
    rng = random.Random(6)
    words = ["is", "sea", "The", "THE", "wooden", "мост", "река", "а", "о", "Η", "πόλη", "x", "café", "cοde"]
    swap = {"a": "а", "e": "е", "o": "оο", "c": "с", "x": "х", "s": "ѕ", "i": "і", "T": "ТΤ", "H": "НΗ", "E": "ЕΕ", "а": "a", "о": "oο", "Η": "HН"}
    texts = []
    for _ in range(60):
        plain = " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5)))
        texts += [plain, "".join(rng.choice(swap[ch]) if ch in swap and rng.random() < 0.5 else ch for ch in plain)]
    got = {r["doc_id"]: r["form"] for r in consistent_form(_docs(spark, texts)).collect()}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts[:i]):
            assert (got[i] == got[j]) == (chars.skeleton(a) == chars.skeleton(b)), (a, b, got[i], got[j])


def test_a_large_group_is_joined_in_parts(spark, rows, monkeypatch):
    from codeloom.llm import lookalike

    monkeypatch.setattr(lookalike, "GROUP_ROWS", 4)
    docs = _docs(spark, ["same text"] * 9 + ["same\u00a0text"] * 3)
    assert sorted(rows(lookalike_pairs(docs))) == [(a, b) for a in range(9) for b in range(9, 12)]


def test_joiners_stay_where_they_are_seen():
    assert chars.clean("👨\u200d👩\u200d👧") == "👨\u200d👩\u200d👧" and chars.clean("a\u200db") == "ab"
    assert chars.clean("می\u200cخواهم") == "می\u200cخواهم"


def test_empty_table(spark, rows):
    assert rows(lookalike_pairs(_docs(spark, []))) == [] and rows(consistent_form(_docs(spark, []))) == []
