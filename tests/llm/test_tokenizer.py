import base64

import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import tokenizer as T

TEXTS = ["", "plain text, it's 12 o'clock", "  two  blanks \n\n\t tabs ", "naïve façade — ½ m² 日本語テキスト", "Ünïcödé е а", "👨‍👩‍👧 ok \x00 end", "<|endoftext|>", "▁under", "x" * 5000, "\u00a0\u202f \u3000"]


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(T.sentencepiece_model(T.read_ranks(T.VOCABULARY)))


@pytest.fixture(scope="module")
def other():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(T.VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=T.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_as_another_library_and_back(encoder, other, text):
    ids = encoder.encode(text)
    assert ids == other.encode_ordinary(text) and encoder.decode(ids) == text


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])))
def test_any_text_goes_there_and_back(encoder, other, text):
    ids = encoder.encode(text)
    assert encoder.decode(ids) == text and ids == other.encode_ordinary(text)


def test_every_row_has_ids(spark, encoder, monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 3)
    docs = spark.createDataFrame([(i, t, [9]) for i, t in enumerate([*TEXTS, None, TEXTS[1]])], "doc_id int, text string, ids array<int>")
    got = {r["doc_id"]: r["ids"] for r in T.encoded(docs).collect()}
    assert got == {i: encoder.encode(t) for i, t in enumerate([*TEXTS, None, TEXTS[1]])}
    assert T.encoded(docs.where("false")).collect() == []
