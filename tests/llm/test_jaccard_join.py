import random

import brute
import numpy as np
import pyarrow as pa
import pytest

from rinkline.llm.components import components
from rinkline.llm.count_tree import CountTree
from rinkline.llm.jaccard_join import plan_of, sets_of, signatures, similar_groups


def edited(rng, base, vocabulary, edits):
    out = list(base)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[at] = rng.choice(vocabulary)
        elif kind < 0.7:
            out.insert(at, rng.choice(vocabulary))
        elif len(out) > 3:
            del out[at]
    return out


def texts(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    out = []
    for size in (6, 7, 8, 9, 10, 12, 15, 20, 33, 65, 130, 300, 1450, 1550):
        for _ in range(2):
            base = [rng.choice(vocabulary) for _ in range(size)]
            out += [" ".join(edited(rng, base, vocabulary, rng.choice([0, 0, 1, 1, 2, 3, 4]))) for _ in range(10)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    out += [shared + " " + " ".join(rng.choice(vocabulary) for _ in range(70)) for _ in range(20)]
    return dict(enumerate(out))


@pytest.mark.parametrize("k,num,den", [(4, 85, 100), (5, 80, 100)])
def test_components_equal_brute_force(spark, k, num, den):
    fixture = texts(3)
    want = brute.components(fixture, k, num, den)
    df = spark.createDataFrame([(i, t, "x") for i, t in fixture.items()], "doc_id long, text string, node string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(df, k, num, den).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "É deux"), (None, "one two"), (7, "x " * 20000), (8, "x " * 20000 + "y"), (9, "one two"), (9, "one two")]
    got = sorted(similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: (r[0] is None, r[0] or 0))
    assert [(r.doc_id, r.n_shingles, r.component_id) for r in got] == [
        (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 1, 4), (6, 1, 6), (7, 1, 7), (8, 2, 8), (9, 1, 4), (9, 1, 4), (None, 1, None),
    ]


def test_empty_table(spark):
    assert similar_groups(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_star_of_copies_hangs_together(spark):
    """Copies that link with their original but not with one another are one component."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(200)]
    rows = [(i, " ".join(w if j not in range(i % 40 * 5, i % 40 * 5 + 14) else f"c{i}_{j}" for j, w in enumerate(base))) for i in range(1, 60)]
    rng.shuffle(rows)
    fixture = dict(rows + [(100, " ".join(base))])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(spark.createDataFrame(list(fixture.items()), "doc_id long, text string")).collect()}
    assert got == brute.components(fixture, 4, 85, 100)


def test_similar_sets_share_a_signature():
    rng = np.random.default_rng(0)
    for n in [6, 7, 9, 15, 16, 17, 31, 40, 100, 255, 256, 700]:
        for _ in range(30):
            a = rng.integers(0, 2**63, n).astype(np.uint64)
            drop = rng.integers(0, max(1, int(n * 0.15)) + 1)
            more = rng.integers(0, 2**63, rng.integers(0, max(1, int(n * 0.15)) + 1)).astype(np.uint64)
            b = np.unique(np.concatenate((rng.permutation(a)[drop:], more)))
            a = np.unique(a)
            shared = len(np.intersect1d(a, b))
            if len(b) and shared != len(a) | len(b) and 100 * shared >= 85 * (len(a) + len(b) - shared) and not np.array_equal(a, b):
                assert set(signatures(a, 85, 100)) & set(signatures(b, 85, 100)), (n, len(a), len(b), shared)


def test_small_sizes_link_only_when_equal():
    assert plan_of(0, 85, 100) is None and plan_of(2, 85, 100) is None
    a, b = sets_of(pa.array(["a b c d e", "e d c b a"]), 4)
    assert len(a) == len(b) == 2 and not np.array_equal(a, b)


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(1)
    points = rng.poisson(3, (500, 16))
    tree = CountTree(points, 85, 100)
    for i in range(0, 500, 25):
        shared = np.minimum(points, points[i]).sum(axis=1)
        want = np.flatnonzero(100 * shared >= 85 * (points[i].sum() + points.sum(axis=1) - shared))
        assert sorted(tree.search(points[i])) == want.tolist()


def test_components_of_long_chain_star_and_repeats(spark):
    links = [(i, i + 1) for i in range(200)] + [(1000, i) for i in range(1001, 1100)] + [(5, 4), (4, 5), (7, 7), (None, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1100), 1000)}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_blocks_ask_each_other_and_fold_points(monkeypatch, spark):
    """The same groups when every block holds a handful of sets, with coarse and fine points in one block."""
    from rinkline.llm import jaccard_join as J

    monkeypatch.setattr(J, "BLOCK_SHINGLES", 3000)
    rng = random.Random(11)
    base = [f"b{i}" for i in range(330)]
    fixture = {i: " ".join(w for j, w in enumerate(base) if j not in range(i * 5, i * 5 + rng.randrange(60, 130))) for i in range(40)}
    df = spark.createDataFrame(list(fixture.items()), "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar_groups(df, 4, 94, 100).collect()}
    assert got == brute.components(fixture, 4, 94, 100)
