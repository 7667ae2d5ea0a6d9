import hashlib
import math

import numpy as np
import pytest

from rinkline.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


def plain(rows):
    """The rules by loops over Python integers."""
    good = [(i, v, lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    whole = [[math.floor(1024 * float(np.float32(x))) for x in v] + [0] * (-len(v) % 4) for _, v, _ in good]
    span = len(whole[0]) // 4
    cut = [[v[p * span : (p + 1) * span] for v in whole] for p in range(4)]
    books = [[list(v) for v in c[:256]] for c in cut]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    look = lambda p: [min((away(v, e), i) for i, e in enumerate(books[p])) for v in cut[p]]
    for _ in range(4):
        for p in range(4):
            held = {}
            for v, (_, i) in zip(cut[p], look(p)):
                held.setdefault(i, []).append(v)
            for i, vs in held.items():
                books[p][i] = [sum(c) // len(vs) for c in zip(*vs)]
    last = [look(p) for p in range(4)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(r[0], "".join(f"{last[p][n][1]:02x}" for p in range(4)), sum(last[p][n][0] for p in range(4)), r[2]) for n, r in enumerate(good)]
    totals = {}
    for *_, error, label in out:
        totals[label] = totals.get(label, 0) + error
    return [(i, c, e, totals[lab], sha) for i, c, e, lab in out]


def coded(spark, rows, parts=3):
    df = spark.createDataFrame([(i, v, lab, "x", 1) for i, v, lab in rows], SCHEMA).repartition(parts)
    got = V.with_label_errors(V.encode(df)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
    return sorted(map(tuple, got.collect()), key=str)


@pytest.mark.parametrize("n, width, parts", [(700, 16, 3), (400, 20, 1), (120, 12, 4), (300, 7, 2), (5, 4, 2)])
def test_equals_the_plain_rules(spark, n, width, parts):
    rng = np.random.default_rng(n)
    rows = [(int(i), rng.normal(0, 0.3, width).astype(np.float32).tolist(), int(i) % 3 or None) for i in rng.permutation(n)]
    assert coded(spark, rows, parts) == sorted(plain(rows), key=str)


def test_repeated_vectors_and_ties(spark):
    rng = np.random.default_rng(1)
    some = rng.integers(-2, 3, (40, 8)) / 1024 + 0.0
    rows = [(i, some[i % 40].tolist(), 1) for i in range(600)]
    assert coded(spark, rows) == sorted(plain(rows), key=str)


def test_unusable_rows_take_no_part(spark):
    rows = [(0, [1.0, 0.0, 0.5, -0.25], 1), (1, None, 1), (2, [], 1), (3, [1.0, None, 0.0, 0.0], 1), (4, [float("nan"), 0.0, 0.0, 0.0], 1), (5, [float("-inf"), 0.0, 0.0, 0.0], 1), (None, [0.3, 0.0, -0.0, 0.1], None), (0, [1.0, 0.0, 0.5, -0.25], 1), (0, [0.5, 0.0, 0.5, -0.25], None), (7, [0.0, 0.0, 0.0, 0.0], 2), (8, [1.0], 2)]
    assert coded(spark, rows) == sorted(plain(rows), key=str)
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, (rng.normal(0, 1, 8) * 10.0 ** rng.integers(0, 7)).astype(np.float32).tolist(), 0) for i in range(60)]
    assert coded(spark, rows) == sorted(plain(rows), key=str)
    far = [(i, [float(np.float32(1e20)) * (i + 1), 1.0, 1.0, 1.0], 0) for i in range(300)]
    want = [(i, c, e if e < 1 << 63 else None, sha) for i, c, e, _, sha in plain(far)]
    assert [(i, c, e, sha) for i, c, e, _, sha in coded(spark, far)] == sorted(want, key=str)
    assert coded(spark, [(1, [1e36, 0.0, 0.0, 0.0], 0)]) == []


def test_transform_keeps_distances_and_orders_by_sequency():
    for size in (1, 2, 4, 16, 32):
        h = V.hadamard(size)
        assert (h @ h.T == size * np.eye(size, dtype=np.int64)).all()
        assert ((h[:, 1:] != h[:, :-1]).sum(axis=1) == np.arange(size)).all()


def test_search_equals_all_distances():
    rng = np.random.default_rng(2)
    for width in (1, 3, 4, 16, 21):
        rows, book = rng.integers(-400, 400, (3000, width)), rng.integers(-400, 400, (256, width))
        book[17] = book[3]
        index, error = V.nearest(rows, book)
        all_ = ((rows[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (index == all_.argmin(axis=1)).all() and (error == all_.min(axis=1)).all()
