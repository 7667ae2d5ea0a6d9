import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rinkline.llm import bpe as B

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = B.Codec(PATH)
ODD = "aBe'sStrvl<|endoftext|> \t\n\x0b\x1c\x85\xa0　 é É ß İ 12३Ⅷ² ,.!?—’ﬁªµº\x00中文😀́͸ ​"


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def same(text):
    own = CODEC.encode(text)
    assert np.frombuffer(own, "<u4").tolist() == ids(text)
    assert CODEC.decode(own) == LIBRARY.decode(ids(text), skip_special_tokens=False) == text


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet=ODD, max_size=60)))
def test_ids_and_texts_are_the_librarys(text):
    same(text)


@pytest.mark.parametrize(
    "text",
    ["", " ", "\n\n  \n x", "It's  we'LL they'll 'tis", "a<|endoftext|>b <|endoftext|>", "<|endoftext|><|endoftext|>", "<|endoftext|", "x" * 300, "ab" * 5000, "é" * 700 + "!" * 900, " " * 5000 + "y", "中文" * 3000, "1234567890" * 50],
)
def test_odd_and_long_texts(text):
    same(text)


def test_every_character_is_cut_as_the_library_cuts_it():
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000]
    for i in range(0, len(points), 4000):
        text = "".join(f"a{chr(p)}1{chr(p)}! {chr(p)} " for p in points[i : i + 4000 : 7])
        assert np.frombuffer(CODEC.encode(text), "<u4").tolist() == ids(text)


def test_the_heap_does_what_the_array_does():
    rng = np.random.default_rng(3)
    for alphabet in ("ab", "the ", "abcdefghijklmnopqrstuvwxyz", "\x00\xff"):
        for n in (1, 2, 3, 17, 200):
            word = "".join(rng.choice(list(alphabet), n)).encode("latin-1")
            assert CODEC.merged(word) == CODEC.merged_long(word)


def test_texts_beyond_the_step_are_worked_on_in_parts(monkeypatch):
    monkeypatch.setattr(B, "AT_ONCE", 5)
    same("a longer text of words — and  more, «ünï» 中文 " * 20)


def test_words_that_are_kept_stay_bounded(monkeypatch):
    monkeypatch.setattr(B, "KEPT_WORDS", 10)
    codec = B.Codec(PATH)
    for i in range(50):
        codec.encode(f"word{i} w{i * i}")
    assert len(codec.kept) <= 10 and np.frombuffer(codec.encode("word1 again"), "<u4").tolist() == ids("word1 again")


def test_ids_that_are_no_text():
    lone = np.array([LIBRARY.token_to_id("Ã"), 7, 4_000_000_000], "<u4").tobytes()
    assert CODEC.decode(lone) == "�" + LIBRARY.id_to_token(7)


def test_rows(spark):
    rows = [(1, "five words of plain text", "x", 1), (None, "no id", "x", 1), (3, None, "y", 2), (4, "", "z", 3), (5, "tale " * 40000, "x", 1), (1, "five words of plain text", "x", 1), (6, "ünï <|endoftext|> 中", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int").repartition(3)
    got = sorted(map(tuple, B.digests(df).collect()), key=str)
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(i, len(ids(t)), sha(np.array(ids(t), "<u4").tobytes()), sha((t or "").encode())) for i, t, *_ in rows]
    assert got == sorted(want, key=str)
    texts = {r.doc_id: r.text for r in B.decode(B.encode(df, PATH), PATH).collect()}
    assert texts[6] == "ünï <|endoftext|> 中" and texts[3] == ""
    assert B.digests(df.limit(0)).collect() == []
    assert [r.text for r in B.decode(spark.createDataFrame([(1, None)], "doc_id long, ids binary"), PATH).collect()] == [""]


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        B.Codec(public_tokenizers.path("word_bpe_49k.json"))
