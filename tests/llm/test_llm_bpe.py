"""Byte-pair encoding against the tokenizers library."""

import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plantpulse.llm import bpe
from plantpulse.llm.queries import vocabulary

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
WORDS = vocabulary()
ENCODER = bpe.Encoder(WORDS)


def want(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(
    "text",
    ["", " \n", "Hello  World's", "a<|endoftext|>b <|startoftext|>", "ΟΔΟΣ σας", "İstanbul", "e\u0301 ﬁ", "\x1c a\x85b\xa0c", "日本語 👍🏽",
     "I'LL we'Re --''s", "٣ ½", "\x00", "x" * 500, "<|endoftext", "don't"],
)
def test_special_cases(text):
    assert ENCODER.encode(text).tolist() == want(text)


@settings(max_examples=300, deadline=None)
@given(st.text(st.characters(codec="utf-8", exclude_categories=["Cn", "Co", "Cs"]), max_size=40))
def test_any_text(text):
    assert ENCODER.encode(text).tolist() == want(text)


def test_joined_tokens():
    rng = random.Random(1)
    tokens = [t.replace(bpe.WORD_END, "") for t in WORDS.tokens if t.isascii()]
    for _ in range(3000):
        text = "".join(rng.choice(tokens) for _ in range(rng.randint(2, 5)))
        assert ENCODER.encode(text).tolist() == want(text)


def test_memo_of_any_size(monkeypatch):
    for name in ("MEMO_WORDS", "MEMO_CHUNKS", "MEMO_PAIRS"):
        monkeypatch.setattr(bpe, name, 3)
    small = bpe.Encoder(WORDS)
    text = "one two three four five one two six seven one"
    assert small.encode(text).tolist() == want(text)


def test_encode_and_decode(spark):
    texts = [None, "", "A b", "A b", "x <|endoftext|>", "grüße " * 20_000]
    docs = spark.createDataFrame([(None if i == 3 else i, t, i) for i, t in enumerate(texts)], "doc_id bigint, text string, ids int")
    rows = bpe.decode(bpe.encode(docs, WORDS), WORDS).collect()
    assert sorted((r["ids"], r["decoded"]) for r in rows) == sorted(
        (want(t or ""), LIBRARY.decode(want(t or ""), skip_special_tokens=False)) for t in texts
    )
    assert bpe.encode(docs.limit(0), WORDS).count() == 0


def test_decode_leaves_out_what_is_no_token(spark):
    df = spark.createDataFrame([([1, None, -1, 10**6, 49407], "x"), (None, "x"), ([], "x")], "ids array<int>, decoded string")
    assert [r["decoded"] for r in bpe.decode(df, WORDS).collect()] == ['" <|endoftext|>', "", ""]


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        bpe.Vocabulary.from_file(public_tokenizers.path("byte_bpe_50k.json"))
