import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rinkline import session
from rinkline.llm import token_files as T

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = T.WordEncoder(PATH)
ODD = "aB'sSt<|endoftext|> \t\n\x0b\x1c\x85　 é É ß ẞ İ Σς 12३ ,.!?—’ĳﬁéñÑ×÷ªµº\x00中文😀"


def ids(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet=ODD, max_size=40)))
def test_words_give_the_librarys_ids(text):
    assert ENCODER.encode([text])[0] == np.asarray(ids(text), dtype="<u2").tobytes()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_other_tokenizers_too(name):
    path = public_tokenizers.path(name)
    encoder, library = T.WordEncoder(path), Tokenizer.from_file(path)
    texts = ["", "It's  a  test.", "x " * 3000, "ünï code\n\nlines", "a" * 5000]
    assert encoder.encode(texts) == [np.asarray(library.encode(t, add_special_tokens=False).ids, dtype=encoder.kind).tobytes() for t in texts]
    assert encoder.by_word == (name == "word_bpe_49k.json")


def test_round_trip(spark):
    rows = [(5, "five words of plain text", "x", 1), (3, None, "x", 1), (4, "", "y", 2), (1, "Ä long " + "tale " * 30000, "x", 3), (2, "<|endoftext|> mark", None, None), (7, "same", "a", 1), (7, "same", "a", 1), (7, "other", "a", 1)]
    rows += [(100 + i, f"document number {i} says {'very ' * (i % 7)}little", "z", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, n_tokens int").repartition(5)
    got = sorted(T.token_files(df, PATH).collect(), key=lambda r: r.start)
    want, start = [], 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0], len(r[1] or ""), 0)):
        own = [*ids(text), 1]
        want.append((doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got] == want


def test_a_short_document_is_read_alone_and_the_dictionary_is_checked(spark, tmp_path):
    df = spark.createDataFrame([(i, f"a short text about the number {i} and little else, again and again") for i in range(500)], "doc_id long, text string")
    path = str(tmp_path / "store")
    T.write(df, path, PATH)
    data, digest = T.dictionary(spark, path)
    assert data, "five hundred short texts are enough for a dictionary"
    row = T.manifest(spark, path).orderBy("part").first()
    shard = T.Shard(f"{path}/shards/{row['file']}", data, digest, row["width"])
    assert shard.ids(7).tolist() == [*ids("a short text about the number 7 and little else, again and again"), 1]
    assert len(shard.index) == row["documents"] and int(shard.index["doc_id"][7]) == 7
    with pytest.raises(ValueError):
        T.Shard(f"{path}/shards/{row['file']}", data, "00" * 32, row["width"])
    back = {r.doc_id: r.ids for r in T.read(spark, path, with_ids=True).collect()}
    assert back[499] == [*ids("a short text about the number 499 and little else, again and again"), 1]


def test_files_of_lost_attempts_do_not_count(spark, tmp_path):
    path = str(tmp_path / "store")
    T.write(spark.createDataFrame([(1, "one")], "doc_id long, text string"), path, PATH)
    (tmp_path / "store" / "shards" / "left-over.tok").write_bytes(b"half a file")
    assert [r.doc_id for r in T.read(spark, path).collect()] == [1]


def test_empty_table_and_null_id(spark):
    assert T.token_files(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    got = T.token_files(spark.createDataFrame([(None, "a"), (1, None)], "doc_id long, text string"), PATH).collect()
    assert [(r.doc_id, r.n_tokens) for r in sorted(got, key=lambda r: r.start)] == [(None, 2), (1, 1)]


def test_staged_folder_is_the_shared_one(spark):
    assert session.new_path(spark, "x").startswith(session.shared_folder(spark))
