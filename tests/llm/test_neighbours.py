import numpy as np

from rinkline.llm import neighbours as N

SCHEMA = "vec_id long, embedding array<float>, score string"


def search(spark, rows, where="vec_id % 20 = 0", k=20):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = {}
    for r in N.nearest(df, df.where(where), k).collect():
        out.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    return {q: [x[i + 1] for i in range(len(x))] for q, x in out.items()}


def exact(rows, q, k=20):
    vectors = {i: np.array(v, dtype=np.float32).astype(float) for i, v, _ in rows}
    scores = [(-float((vectors[q] * v).sum()), i) for i, v in vectors.items() if i != q]
    return [(i, -s) for s, i in sorted(scores)[:k]]


def test_recall_and_scores(spark):
    rng = np.random.default_rng(0)
    rows = [(i, v.tolist(), None) for i, v in enumerate(rng.standard_normal((4000, 32)) * rng.uniform(0.5, 2, (4000, 1)))]
    got = search(spark, rows)
    hits = total = 0
    for q, found in got.items():
        want = exact(rows, q)
        hits += len({i for i, _ in want} & {i for i, _ in found})
        total += 20
        assert len(found) == 20 and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        vectors = np.array([rows[i][1] for i, _ in found], dtype=np.float32).astype(float)
        assert np.allclose(vectors @ np.array(rows[q][1], dtype=np.float32).astype(float), [s for _, s in found], atol=1e-12)
    assert len(got) == 200 and hits / total >= 0.9


def test_few_vectors_are_searched_in_whole_and_ties_go_to_smaller_ids(spark):
    rows = [(i, [1.0, float(i % 2)], None) for i in range(12)]
    got = search(spark, rows, "vec_id = 1", 20)
    assert [i for i, _ in got[1]] == [3, 5, 7, 9, 11, 0, 2, 4, 6, 8, 10]


def test_unusable_vectors_take_no_part(spark):
    rows = [(0, [1.0, 0.0], None), (20, None, None), (40, [], None), (60, [0.0, 0.0], None), (80, [1.0, None], None), (100, [float("nan"), 1.0], None), (120, [float("inf"), 1.0], None), (None, [1.0, 1.0], None), (140, [1.0, 1.0, 1.0], None), (1, [0.5, 0.5], None), (1, [0.5, 0.5], None), (2, [1.0, 1.0], None)]
    assert search(spark, rows) == {0: [(2, 1.0), (1, 0.5)]}
    assert search(spark, []) == {} and search(spark, [(20, None, None)]) == {}


def test_one_very_common_vector(spark, monkeypatch):
    monkeypatch.setattr(N, "PAGE_ROWS", 100)
    rng = np.random.default_rng(2)
    other = rng.standard_normal((1500, 3))
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    rows = [(i, [0.6, 0.8, 0.0] if i % 3 else other[i].tolist(), None) for i in range(1500)]
    got = search(spark, rows, "vec_id in (1, 700)", 10)
    for q in (1, 700):
        assert [i for i, _ in got[q]] == [i for i, _ in exact(rows, q, 10)]


def test_hilbert_keys_walk_over_neighbours():
    for dims, bits in ((2, 4), (3, 3)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        keys = N.hilbert_keys(grid, bits)
        assert sorted(keys.tolist()) == list(range(len(grid)))
        assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
