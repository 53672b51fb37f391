import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import token_counts as K

PATH = public_tokenizers.path(K.TOKENIZER)
TOK = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counts():
    return K.Counts(PATH)


def library(t):
    return len(TOK.encode(t, add_special_tokens=False))


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("abcXYZ0189 \t\n\r\x0b\x0c\x1c\x1f\x85\xa0'’!?.,;:-_()[]{}|<>éßñ漢字가あア😀​ ́Ωж٣²Ⅷ")), max_size=80))
def test_counts_as_the_library(text):
    assert K.Counts(PATH).many([text]) == [library(text)] if not text else _shared.many([text]) == [library(text)]


_shared = K.Counts(PATH)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert _shared.many([text]) == [library(text)]


@pytest.mark.parametrize("text", ["", "<|endoftext|>", "a<|endoftext|> b<|endoftext|><|endoftext|>", "it's I'LL we've  \n\n x", "x" * 5000, " " * 3000 + "y", "a \n" * 4000])
def test_special_and_long(counts, text):
    assert counts.many([text]) == [library(text)]


def test_cut_texts_and_small_memo(monkeypatch):
    monkeypatch.setattr(K, "CHUNK", 64)
    monkeypatch.setattr(K, "MEMO", 50)
    rng = random.Random(1)
    texts = [" ".join("".join(rng.choices("abcde,.'\n é", k=rng.randint(1, 9))) for _ in range(200)) for _ in range(20)]
    assert K.Counts(PATH).many(texts) == [library(t) for t in texts]


def test_odd_characters_are_cut_and_counted_by_pre_token(monkeypatch):
    monkeypatch.setattr(K, "CHUNK", 64)
    monkeypatch.setattr(K, "MEMO", 200)
    rng = random.Random(2)
    words = ["שלום", "العربية", "हिन्दी", "ภาษาไทย", "😀👍🏽", "5 €", "ёлка", "e\u0301te\u0301", "it's", "don’t", "\u200b", "x1", "...", "\n\n", "<|endoftext|>", "\u0378", "\x85", "Ⅷ²", "  "]
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(60)]
    counts = K.Counts(PATH)
    longest = []
    encode = counts._encode
    monkeypatch.setattr(counts, "_encode", lambda t: longest.extend(map(len, t)) or encode(t))
    assert counts.many(texts) == [library(t) for t in texts]
    assert max(longest) < 100  # pre-tokens only, never a text


def test_rows(make, odd_rows):
    got = K.token_counts(make(odd_rows)).collect()
    want = sorted(((r[0], len((r[1] or "").encode()), library(r[1] or "")) for r in odd_rows), key=str)
    assert sorted(((r.doc_id, r.n_bytes, r.n_tokens) for r in got), key=str) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in got)
    assert K.token_counts(make([])).count() == 0
