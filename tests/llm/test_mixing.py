import random

import brute
from pyspark.sql import functions as F

from rinkline.llm.mixing import mix_sources, repeating_weights


def mixed(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, taken string, _note string").repartition(3)
    return mix_sources(df, repeating_weights).collect()


def fixture(n=3000):
    rng = random.Random(4)
    sources = ["a", "b", "B", "é", "", None, "tiny"]
    rows = []
    for i in range(n):
        s = rng.choices(sources, weights=[30, 5, 5, 5, 5, 5, 0.3])[0]
        rows.append((i, " ".join(["w"] * int(rng.paretovariate(1.2) * 20)), s, "clash", None))
    return rows + [(None, None, "a", "x", "y"), (n, "", "b", None, None)]


def test_targets_and_taken(spark):
    rows = fixture()
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    sizes, taken = {}, {}
    for r in got:
        assert r.size == len(brute.words(r.text))
        assert r.taken == r.repetitions * r.size <= 3 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = brute.targets(sizes, 3)
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6
    for s, target in want.items():
        assert abs(taken[s] - target) <= max(0.02 * target, 3), (s, taken[s], target)
    assert any(abs(want[s] - 3 * sizes[s]) < 1e-9 for s in sizes) and {r.repetitions for r in got} >= {0, 1, 3}


def test_reruns_agree_and_order_does_not_matter(spark):
    rows = fixture(400)
    one = sorted((str(r.doc_id), r.taken) for r in mixed(spark, rows))
    assert one == sorted((str(r.doc_id), r.taken) for r in mixed(spark, rows[::-1]))


def test_repeated_rows_share_a_decision_and_empty_sources_take_nothing(spark):
    rows = [(1, "a b c", "s", None, None)] * 3 + [(2, None, "empty", None, None), (3, "d " * 50, "t", None, None)]
    got = mixed(spark, rows)
    assert len({r.repetitions for r in got if r.doc_id == 1}) == 1
    assert [(r.target, r.taken, r.repetitions) for r in got if r.source == "empty"] == [(0.0, 0, 0)]


def test_empty_table(spark):
    assert mixed(spark, []) == []


def test_runs_without_python(spark):
    df = spark.createDataFrame(fixture(50), "doc_id long, text string, source string, taken string, _note string")
    plan = mix_sources(df, repeating_weights)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_a_given_budget_is_shared(spark):
    df = spark.createDataFrame([(i, "w " * 10, s) for i, s in enumerate("aabb" * 50)], "doc_id long, text string, source string")
    got = mix_sources(df, lambda s: s.withColumn("weight", F.lit(1)), budget=F.lit(500))
    assert [r[0] for r in got.groupBy("source").agg(F.sum("taken").alias("t")).select("t").collect()] == [250, 250]
