"""Boosted trees against hand-computed and plainly grown ones, and the model store."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import test_rules
from rinkline.operators import boosting as B
from rinkline.operators.quality import QualityError
from rinkline.plans import model as MO
from rinkline.plans import model_store as S
from rinkline.session import staged

player_seasons = test_rules.player_seasons


def frame(spark, columns, parts=3):
    return staged(spark.createDataFrame(pd.DataFrame(columns)).repartition(parts), "numbers")


def test_two_rounds_by_hand(spark):
    """Mean 3; errors -3 -3 1 5, best gain 24 at 2 with leaves of -1 and 1; errors -2 -2 0 4, best gain 12 at 3 with -0.5 and 1."""
    df = frame(spark, {"x": [1.0, 2.0, 3.0, 4.0], "y": [0.0, 0.0, 4.0, 8.0]})
    model = B.fit(df, ["x"], "y", B.Settings(step_size=0.5, rounds=2, leaves=2, l2=1.0, least_rows=1))
    assert model.base == 3 and model.limits == [[1.0, 2.0, 3.0]]
    assert [(t.feature, t.cut, t.value[1:]) for t in model.trees] == [([0, -1, -1], [1, 0, 0], [-1.0, 1.0]), ([0, -1, -1], [2, 0, 0], [-0.5, 1.0])]
    got = {r.x: r.p for r in df.withColumn("p", model.predictor()).collect()}
    assert got == {1: 1.5, 2: 1.5, 3: 3.5, 4: 5.0}


def test_l2_and_the_leaf_limit_by_hand(spark):
    """Of the root's halves only the right one gains by another split: 1/2 + 25/2 - 36/3 = 1, the left one loses 3."""
    df = frame(spark, {"x": [1.0, 2.0, 3.0, 4.0], "y": [0.0, 0.0, 4.0, 8.0]})
    fit = lambda **s: B.fit(df, ["x"], "y", B.Settings(step_size=0.5, rounds=1, least_rows=1, **s)).trees[0]
    assert fit(leaves=3, l2=1.0).value[1:] == [-1.0, 1.0, 0.25, 1.25]
    assert fit(leaves=31, l2=1.0).value[1:] == [-1.0, 1.0, 0.25, 1.25]
    assert fit(leaves=31, l2=0.0, depth=1).value[1:] == [-1.5, 1.5]
    assert fit(leaves=2, l2=1000.0).feature == [0, -1, -1] and fit(leaves=1, l2=1.0).feature == [-1]


def plain_tree(bins, error, settings):
    """Best-first growth one split at a time."""
    leaves = {(): np.arange(len(error))}
    shape = (bins.shape[1], settings.bins)

    def best(rows):
        e, n = np.zeros(shape), np.zeros(shape)
        for f in range(shape[0]):
            np.add.at(e[f], bins[rows, f], error[rows])
            np.add.at(n[f], bins[rows, f], 1)
        return B.best_split(e, n, settings)

    while len(leaves) < settings.leaves:
        gains = [(s.gain, path) for path, rows in leaves.items() if (s := best(rows))]
        if not gains:
            break
        path = max(gains)[1]
        rows = leaves.pop(path)
        s = best(rows)
        low = bins[rows, s.feature] <= s.cut
        leaves[*path, 0], leaves[*path, 1] = rows[low], rows[~low]
    out = np.zeros(len(error))
    for rows in leaves.values():
        out[rows] = settings.step_size * error[rows].sum() / (len(rows) + settings.l2)
    return out


def test_trees_equal_plain_best_first_growth(spark, monkeypatch):
    monkeypatch.setattr(B, "STORED_EVERY", 2)
    draw = np.random.default_rng(4)
    x = draw.normal(size=(1500, 5))
    x[:, 4] = draw.integers(0, 3, 1500)
    y = 2 * x[:, 0] + np.sin(3 * x[:, 1]) + x[:, 2] * x[:, 3] + x[:, 4]
    settings = B.Settings(step_size=0.3, rounds=3, leaves=12, l2=1.0, least_rows=20, bins=64)
    names = [f"f{i}" for i in range(5)]
    df = frame(spark, {**{n: x[:, i] for i, n in enumerate(names)}, "y": y})
    model = B.fit(df, names, "y", settings)
    bins = model.bins(list(x.T))
    want = np.full(1500, y.mean())
    for _ in range(settings.rounds):
        want += plain_tree(bins, y - want, settings)
    got = df.withColumn("p", model.predictor()).toPandas()
    assert np.allclose(np.sort(got.p), np.sort(want)) and max(len(lim) for lim in model.limits) <= 63
    again = B.Booster.from_json(model.to_json())
    assert np.allclose(df.withColumn("p", again.predictor()).toPandas().sort_values("y").p, got.sort_values("y").p)
    assert ((got.p - got.y) ** 2).mean() < 0.5 * y.var()


def test_constant_labels_and_empty_frames(spark):
    df = frame(spark, {"x": [1.0, 2.0] * 30, "y": [5.0] * 60})
    model = B.fit(df, ["x"], "y", B.Settings(rounds=1))
    assert model.trees[0].feature == [-1] and [r.p for r in df.withColumn("p", model.predictor()).limit(2).collect()] == [5.0, 5.0]
    with pytest.raises(ValueError):
        B.fit(df.limit(0), ["x"], "y")
    with pytest.raises(ValueError):
        B.fit(df, ["x"], "y", B.Settings(bins=300))


@pytest.fixture(scope="module")
def data(player_seasons):
    return staged(MO.training_data(player_seasons), "targets")


@pytest.fixture(scope="module")
def trained(data):
    return MO.train(data, MO.Options(iterations=2))


def test_model_store(spark, data, trained, tmp_path):
    path = str(tmp_path / "models")
    with pytest.raises(QualityError):
        S.load(spark, path)
    assert S.publish(trained, path, "first", spark) == 1 and S.publish(trained, path, "second", spark) == 2
    with pytest.raises(QualityError):
        S.publish(trained, path, "first", spark)
    for name, number in (("first", 1), ("second", 2)):
        S.activate(spark, path, name)
        assert S.load(spark, path)[0] == number and S.versions(spark, path).where("active").count() == 1
    with pytest.raises(QualityError):
        S.activate(spark, path, "third")
    number, fitted, metadata = S.load(spark, path, "first")
    assert metadata == json.loads(MO.metadata_json(trained.metadata))
    want = {(r.player_id, r.season): r.ml_prediction for r in trained.final.predict(data).collect()}
    assert {(r.player_id, r.season): r.ml_prediction for r in fitted.predict(data).collect()} == want
    assert {r.model_version_id for r in S.predict(data.drop("target_season"), path).collect()} == {2}
    stored = S.store_predictions(MO.prediction_frame(fitted.predict(data)), path, number)
    assert stored.count() == len(want)
    with pytest.raises(Exception, match="EXISTS|exists"):
        S.store_predictions(stored, path, number)


def test_changed_bytes_are_refused(spark, trained, tmp_path):
    path = str(tmp_path / "models")
    S.publish(trained, path, "one", spark)
    folder = S.versions(spark, path).first().folder
    spark.createDataFrame([("{}",)], "model string").write.mode("overwrite").parquet(f"{path}/{folder}")
    with pytest.raises(QualityError):
        S.load(spark, path, "one")


def test_metrics_equal_those_that_sql_finds_in_stored_predictions(data, trained, tmp_path):
    import duckdb

    first = MO.fit(data.where(F.col("target_season") < trained.metadata["validation_target_season"]), MO.Options(iterations=2))
    stored = S.store_predictions(first.predict(data).select("target_season", MO.TARGET, "ml_prediction"), str(tmp_path), 1)
    found = duckdb.sql(f"""SELECT target_season, count(*), avg(abs(p - y)), sqrt(avg((p - y) ** 2)) FROM
        (SELECT target_season, ml_prediction AS p, {MO.TARGET} AS y FROM '{tmp_path}/predictions/version=1/*.parquet') GROUP BY 1""").fetchall()
    assert stored.count() == sum(r[1] for r in found)
    test = trained.metadata["metrics"]["test"]
    want = {r[0]: r[1:] for r in found}[trained.metadata["test_target_season"]]
    assert (test["rows"], test["mae"], test["rmse"]) == pytest.approx(want)
