import random

import numpy as np
import pyarrow as pa
import pytest

from rinkline.llm import decontaminate as D
from rinkline.llm.words import shingles_of, words_of


def random_words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def fixture():
    rng = random.Random(2)
    items = [(i, " ".join(random_words(rng, rng.randint(15, 60)))) for i in range(40)] + [(100, "two words"), (101, ""), (102, None), (103, "one more benchmark item of seven words")]
    docs, planted = [], set()
    for d in range(300):
        w = random_words(rng, rng.choice([0, 3, 50, 400]))
        if d % 5 == 0:
            i = rng.randrange(40)
            p = items[i][1].split()
            if d % 10 == 0 and len(p) > 40:
                p[0] = "changed"  # one shingle of about forty
            at = rng.randrange(len(w) + 1)
            w = w[:at] + [x.upper() if d % 15 == 0 else x for x in p] + w[at:]
            planted.add((d, i))
        docs.append((d, " ".join(w)))
    return items, docs, planted


def brute(items, docs):
    """Best similarity of any item-sized window, without SimHash."""
    index = D.build([i for i, _ in items], [t or "" for _, t in items])
    out = {}
    for doc_id, text in docs:
        s, _ = shingles_of(words_of(pa.array([text or ""], pa.string())), D.K)
        for n, item in enumerate(index.ids):
            size = max(index.lengths[n] - D.K + 1, 1)
            if not np.isin(s, index.shingles[n]).any():
                continue
            best = max(D.similarity(index, n, s[a : a + size]) for a in range(max(len(s) - size, 0) + 1))
            if best >= D.SIMILARITY:
                out[doc_id, int(item)] = best
    return out


def test_every_similar_window_is_found(spark):
    items, docs, planted = fixture()
    rows = [(d, t, "clash") for d, t in docs]
    got = D.contamination(spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(3), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r.doc_id, r.item_id): r.similarity for r in got}
    assert found == pytest.approx(brute(items, docs))
    assert planted <= set(found) and len(got) == len(found)


def test_window_place(spark):
    items = spark.createDataFrame([(1, "a b c d e f g h i j")], "item_id long, text string")
    r = D.contamination(spark.createDataFrame([(9, "x y z A B C D E F G H I J q")], "doc_id long, text string"), items).first()
    assert (r.first_word, r.n_words, r.similarity) == (3, 10, 1.0)


def test_edge_rows(spark):
    items = spark.createDataFrame([(1, "two words"), (2, None), (3, "  "), (1, "two words")], "item_id long, text string")
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "two words"), (None, "two words"), (3, "two words"), (4, "two words more")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in D.contamination(docs, items).collect())
    assert got == [("3", 1)] * 4 + [("None", 1)] * 2
    assert D.contamination(docs, items.where("false")).collect() == []
    assert D.contamination(docs.where("false"), items).collect() == []


def test_items_in_blocks_give_the_same(spark, monkeypatch):
    items, docs, _ = fixture()
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    one = {(r.doc_id, r.item_id) for r in D.contamination(d, i).collect()}
    monkeypatch.setattr(D, "ITEMS_AT_ONCE", 7)
    assert {(r.doc_id, r.item_id) for r in D.contamination(d, i).collect()} == one


def test_similarity_does_not_depend_on_blocks(spark, monkeypatch):
    rng = random.Random(8)
    template = [f"t{i}" for i in range(12)]
    items = [(i, " ".join(template + random_words(rng, 20))) for i in range(25)]
    docs = []
    for i, text in items:
        w = text.split()
        w[8] = "changed"
        docs += [(2 * i, " ".join(random_words(rng, 30) + w)), (2 * i + 1, text)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = lambda: {(r.doc_id, r.item_id): r.similarity for r in D.contamination(d, i, least=0.5).collect()}
    one = rows()
    monkeypatch.setattr(D, "ITEMS_AT_ONCE", 8)
    assert len(one) >= 50 and rows() == pytest.approx(one)
    monkeypatch.setattr(D, "ITEMS_AT_ONCE", 20_000)
    monkeypatch.setattr(D, "BYTES_AT_ONCE", 700)
    assert rows() == pytest.approx(one)


def test_block_index_guarantees_the_radius():
    rng = np.random.default_rng(3)
    index = D.build(list(range(50)), [" ".join(f"v{x}" for x in rng.integers(0, 999, 30)) for _ in range(50)])
    bits = np.unpackbits(index.hashes.view(np.uint8), axis=1)
    for flips in (0, 1, 16, 30, 31, 32, 45):
        for n in range(0, 50, 7):
            b = bits[n].copy()
            b[rng.permutation(D.BITS)[:flips]] ^= 1
            window = np.packbits(b).view(np.uint16)[None, :]
            _, item = D.near(index, window)
            apart = (np.unpackbits(window.view(np.uint8)) != bits).sum(axis=1)
            assert item.tolist() == np.flatnonzero(apart <= D.RADIUS).tolist()
