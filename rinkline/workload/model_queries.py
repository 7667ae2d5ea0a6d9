"""Model dataset, features, targets, evaluation and training."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkline.plans import features as X
from rinkline.plans import model as M
from rinkline.plans import model_store
from rinkline.session import new_path, staged
from rinkline.workload.registry import query, rounded
from rinkline.workload.season_queries import MODEL_CTES

TABLES = ["players", "skater_season_stats", "skater_advanced_season_stats", "seasons"]


def dataset(lg) -> DataFrame:
    return X.model_dataset(lg.with_stored_facts().tables(*TABLES), check=False)


_T = "ice_time_seconds"
_RATE = ", ".join(f"{c} * 3600.0::DOUBLE / (CASE WHEN {_T} > 0 THEN {_T} END) AS {n}" for n, c in X.RATES.items())
_ZONE_SUM = " + ".join(f"coalesce({c}, 0)" for c in X.ZONES.values())
_ZONE = ", ".join(f"{c}::DOUBLE / nullif({_ZONE_SUM}, 0) AS {n}" for n, c in X.ZONES.items())
FEATURE_CTES = {
    **MODEL_CTES,
    "dataset": """SELECT r.*, s.label AS season_label, s.salary_cap_cents, s.salary_cap_cents / 100.0::DOUBLE / 100000000 AS salary_cap_fraction,
        CASE WHEN position = 'D' THEN 'defense' WHEN position IN ('C', 'LW', 'RW', 'F') THEN 'forward' END AS position_group
        FROM model_rows r LEFT JOIN seasons s ON s.start_year = r.season AND s.salary_cap_cents IS NOT NULL WHERE coalesce(r.games_played, 0) >= 1""",
    "rates": f"SELECT *, {_T} / 3600.0::DOUBLE AS toi_hours, {_RATE}, {_ZONE}, goals - individual_expected_goals AS goals_above_expected, coalesce(games_played, 0) >= 20 AND coalesce({_T}, 0) > 0 AS eligible_for_training FROM dataset",
    "features": f"""SELECT *, takeaways_per_60 - giveaways_per_60 AS net_takeaways_per_60, penalties_drawn_per_60 - penalties_per_60 AS penalty_differential_per_60,
        goals_above_expected * 3600.0::DOUBLE / (CASE WHEN {_T} > 0 THEN {_T} END) AS goals_above_expected_per_60, {_T} / 60.0::DOUBLE / nullif(games_played, 0) AS toi_per_game FROM rates""",
    "usable": "SELECT * FROM features WHERE eligible_for_training AND position_group IS NOT NULL AND toi_per_game IS NOT NULL",
    "limits": "SELECT season, position_group, quantile_cont(toi_per_game, 0.2) AS threshold FROM usable GROUP BY 1, 2",
    "pool": "SELECT u.*, l.threshold FROM usable u JOIN limits l ON l.season = u.season AND l.position_group = u.position_group WHERE u.toi_per_game <= l.threshold",
    "baselines": f"SELECT season, position_group, {', '.join(f'median({m}) AS base_{m}' for m in X.REPLACEMENT_METRICS)} FROM pool GROUP BY 1, 2",
    "over": f"""SELECT f.*, l.threshold AS replacement_toi_per_game_threshold, coalesce(f.eligible_for_training AND f.position_group IS NOT NULL AND f.toi_per_game <= l.threshold, FALSE) AS is_replacement_pool,
        {', '.join((f'f.{m} - b.base_{m}' if m in X.HIGHER_IS_BETTER else f'b.base_{m} - f.{m}') + f' AS {m}_above_replacement' for m in X.REPLACEMENT_METRICS)}
        FROM features f LEFT JOIN limits l ON l.season = f.season AND l.position_group = f.position_group LEFT JOIN baselines b ON b.season = f.season AND b.position_group = f.position_group""",
    "valued": "SELECT *, game_score_per_60_above_replacement * toi_hours AS v FROM over",
    "targets": """SELECT a.player_id, a.season, a.season + 1 AS target_season, a.v AS current_hockey_value, coalesce(b.v, 0) AS next_season_hockey_value, a.position_group, a.game_score_per_60
        FROM valued a LEFT JOIN valued b ON b.player_id = a.player_id AND b.season = a.season + 1
        WHERE a.eligible_for_training AND a.position_group IS NOT NULL AND a.season + 1 <= (SELECT max(season) FROM valued)""",
}


@query("SELECT player_id, season, position, position_group, season_label, salary_cap_cents, round(salary_cap_fraction, 6) AS salary_cap_fraction, games_played FROM dataset", **FEATURE_CTES)
def model_dataset(lg):
    return dataset(lg).select("player_id", "season", "position", "position_group", "season_label", "salary_cap_cents", "salary_cap_fraction", "games_played")


_FEATURE_COLUMNS = [*X.RATES, *X.ZONES, "toi_hours", "net_takeaways_per_60", "penalty_differential_per_60", "goals_above_expected_per_60"]


@query(f"SELECT player_id, season, eligible_for_training, {rounded(*_FEATURE_COLUMNS)} FROM features", **FEATURE_CTES)
def feature_frame(lg):
    return X.feature_frame(dataset(lg)).select("player_id", "season", "eligible_for_training", *_FEATURE_COLUMNS)


_OVER = [f"{m}_above_replacement" for m in X.REPLACEMENT_METRICS]


@query(f"SELECT player_id, season, is_replacement_pool, {rounded('replacement_toi_per_game_threshold', *_OVER)} FROM over", **FEATURE_CTES)
def above_replacement(lg):
    return X.above_replacement(dataset(lg)).select("player_id", "season", "is_replacement_pool", "replacement_toi_per_game_threshold", *_OVER)


@query(f"SELECT player_id, season, is_replacement_pool, {rounded('replacement_toi_per_game_threshold', *_OVER)} FROM over", **FEATURE_CTES)
def above_replacement_large_path(lg):
    """The same under its earlier name; quantiles have one path for every size."""
    rows = X.above_replacement(dataset(lg))
    return rows.select("player_id", "season", "is_replacement_pool", "replacement_toi_per_game_threshold", *_OVER)


@query("SELECT position_group, count(*) AS rows FROM over WHERE is_replacement_pool GROUP BY 1", **FEATURE_CTES)
def replacement_pool_sizes(lg):
    return X.replacement_report(X.above_replacement(dataset(lg)))["pool_by_position"]


@query("SELECT player_id, season, target_season, position_group, round(current_hockey_value, 6) AS current_hockey_value, round(next_season_hockey_value, 6) AS next_season_hockey_value FROM targets", **FEATURE_CTES)
def training_targets(lg):
    return M.training_data(dataset(lg)).select("player_id", "season", "target_season", "position_group", "current_hockey_value", "next_season_hockey_value")


_SPLIT = {**FEATURE_CTES, "splits": """SELECT *, CASE WHEN target_season = (SELECT max(target_season) FROM targets) THEN 'test'
    WHEN target_season = (SELECT max(target_season) FROM targets WHERE target_season < (SELECT max(target_season) FROM targets)) THEN 'validation' ELSE 'train' END AS split FROM targets"""}


@query("SELECT split, count(*) AS rows, min(target_season) AS first_season, max(target_season) AS last_season FROM splits GROUP BY 1", **_SPLIT)
def temporal_split(lg):
    rows = staged(M.training_data(dataset(lg)), "targets")
    split = M.split_of(*M.target_seasons(rows))
    return rows.groupBy(split.alias("split")).agg(F.count(F.lit(1)).alias("rows"), F.min("target_season").alias("first_season"), F.max("target_season").alias("last_season"))


@query("""SELECT split, count(*) AS rows, round(avg(abs(current_hockey_value - next_season_hockey_value)), 6) AS mae, round(sqrt(avg((current_hockey_value - next_season_hockey_value) ** 2)), 6) AS rmse,
    round(1 - sum((current_hockey_value - next_season_hockey_value) ** 2) / (var_pop(next_season_hockey_value) * count(*)), 6) AS r2 FROM splits GROUP BY 1""", **_SPLIT)
def naive_benchmark_metrics(lg):
    """Errors of 'same value again' on the three splits."""
    rows = staged(M.training_data(dataset(lg)), "targets")
    split = M.split_of(*M.target_seasons(rows))
    return M.regression_metrics(rows.withColumn("split", split), M.TARGET, "current_hockey_value", ["split"])


_JUDGED = {**_SPLIT,
    "test_rows": "SELECT *, game_score_per_60 AS ml FROM splits WHERE split = 'test'",
    "edges": "SELECT list_distinct(quantile_cont(ml, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) AS e FROM test_rows",
    "judged": """SELECT t.*, abs(ml - next_season_hockey_value) AS absolute_error, (SELECT count(*) FROM (SELECT unnest(e) AS x FROM edges) WHERE x < t.ml AND x > (SELECT min(ml) FROM test_rows) AND x < (SELECT max(ml) FROM test_rows)) AS tier,
        abs(current_hockey_value - next_season_hockey_value) - abs(ml - next_season_hockey_value) AS improvement FROM test_rows t"""}


def _judged(lg) -> DataFrame:
    """Evaluation of a stand-in prediction (the current rate) on the test season."""
    rows = staged(M.training_data(dataset(lg)), "targets")
    return M.evaluate(rows.withColumn("ml_prediction", F.col("game_score_per_60")), M.target_seasons(rows)[1])


@query("SELECT tier AS prediction_tier, count(*) AS players, round(avg(ml), 6) AS avg_prediction, round(avg(next_season_hockey_value), 6) AS avg_actual FROM judged GROUP BY 1", **_JUDGED)
def calibration_by_tier(lg):
    return M.calibration(_judged(lg))


@query("SELECT player_id, round(absolute_error, 6) AS absolute_error, round(improvement, 6) AS improvement_vs_naive FROM judged ORDER BY absolute_error DESC, player_id LIMIT 20", **_JUDGED)
def largest_errors(lg):
    return M.largest(_judged(lg), "absolute_error").select("player_id", "absolute_error", "improvement_vs_naive")


@query("SELECT player_id, target_season AS season, round(greatest(current_hockey_value, 0), 6) AS prediction FROM targets WHERE current_hockey_value IS NOT NULL", **FEATURE_CTES)
def clipped_predictions(lg):
    rows = staged(M.training_data(dataset(lg)), "targets").filter("current_hockey_value is not null")
    return M.prediction_frame(rows, "current_hockey_value")


_MEDIANS = ["games_played", "toi_hours", "goals_per_60", "game_score_per_60", "on_ice_expected_goals_pct"]


@query(f"SELECT {', '.join(f'round(median({c}), 6) AS {c}' for c in _MEDIANS)} FROM features", **FEATURE_CTES)
def fill_medians(lg):
    from rinkline.operators.quantiles import group_quantiles

    rows = staged(X.feature_frame(dataset(lg)).select(F.lit(1).alias("_all"), *_MEDIANS), "medians")
    return group_quantiles(rows, ["_all"], _MEDIANS, 0.5).drop("_all")


@query(f"""SELECT {', '.join(f'round(median({c}), 6) AS {c}' for c in M.NUMERIC_FEATURES)},
    (SELECT position_group FROM over WHERE position_group IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, position_group LIMIT 1) AS position_group FROM over""", **FEATURE_CTES)
def model_fills(lg):
    """The fill of every model input: 37 medians and the most frequent position group."""
    fills = M.fill_values(staged(X.above_replacement(dataset(lg)), "above"))
    return lg.spark.createDataFrame([tuple(fills.values())], ", ".join(f"{c} {'string' if c == 'position_group' else 'double'}" for c in fills))


@query("""SELECT player_id, season, round(coalesce(goals_per_60, (SELECT median(goals_per_60) FROM over)), 6) AS goals_per_60, (coalesce(position_group, usual) = 'defense')::INT AS is_defense,
    (coalesce(position_group, usual) = 'forward')::INT AS is_forward FROM over, (SELECT position_group AS usual FROM over WHERE position_group IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)""", **FEATURE_CTES)
def model_indicators(lg):
    """Filled inputs with an indicator for each position group."""
    table = staged(X.above_replacement(dataset(lg)), "above")
    rows = M.with_indicators(M.model_inputs(table, M.fill_values(table)), ["defense", "forward"])
    return rows.select("player_id", "season", "goals_per_60", F.col("is_defense").cast("int").alias("is_defense"), F.col("is_forward").cast("int").alias("is_forward"))


@query("""SELECT 'test' AS split, metric, round(CASE WHEN metric = 'r2' THEN was - now ELSE now - was END, 6) AS regression FROM (
      SELECT unnest(['mae', 'rmse', 'r2']) AS metric, unnest([b.mae, b.rmse, b.r2]) AS was, unnest([t.mae, t.rmse, t.r2]) AS now FROM gate_metrics t, gate_metrics b WHERE t.split = 'test' AND b.split = 'train')
    WHERE CASE WHEN metric = 'r2' THEN was - now > 0 ELSE now - was > 0 END
    UNION ALL SELECT 'validation', metric, NULL FROM (VALUES ('mae'), ('rmse'), ('r2')) v(metric)""", **_SPLIT, gate_metrics="""SELECT split, avg(abs(current_hockey_value - next_season_hockey_value)) AS mae,
    sqrt(avg((current_hockey_value - next_season_hockey_value) ** 2)) AS rmse, 1 - sum((current_hockey_value - next_season_hockey_value) ** 2) / (var_pop(next_season_hockey_value) * count(*)) AS r2 FROM splits GROUP BY 1""")
def metric_gate(lg):
    """The test split held against the train split as its baseline, without tolerance; the validation metrics are missing, which counts as a regression."""
    rows = staged(M.training_data(dataset(lg)), "targets")
    split = M.split_of(*M.target_seasons(rows))
    found = staged(M.metric_rows(M.regression_metrics(rows.withColumn("split", split), M.TARGET, "current_hockey_value", ["split"])), "metrics")
    train = found.filter("split = 'train'").drop("split")
    was = train.select(F.explode(F.array(F.lit("test"), F.lit("validation"))).alias("split"), "metric", "value")
    return M.metric_regressions(found.filter("split = 'test'"), was, {"mae": 0.0, "rmse": 0.0, "r2": 0.0})


#: Rounds of the registered queries; a round costs about one Spark job per level of its tree, so the published 300 take long here.
FEW_ROUNDS = M.Options(step_size=0.3, iterations=5, leaves=15)


def _active_version(lg, targets: DataFrame | None = None) -> str:
    """A store whose active version was trained and published from the league's targets (stored ones, if given)."""
    path = new_path(lg.spark, "models")
    trained = M.train(staged(M.training_data(dataset(lg)), "targets") if targets is None else targets, FEW_ROUNDS)
    model_store.publish(trained, path, "league", lg.spark)
    model_store.activate(lg.spark, path, "league")
    return path


@query()
def trained_model_metrics(lg):
    """A model trained, published, activated and loaded again; the metrics are those of its stored predictions, by split."""
    rows = staged(M.training_data(dataset(lg)), "targets")
    path = _active_version(lg, rows)
    number, fitted, metadata = model_store.load(lg.spark, path)
    split = M.split_of(metadata["validation_target_season"], metadata["test_target_season"])
    scored = fitted.predict(rows).select("player_id", split.alias("split"), M.TARGET, "ml_prediction")
    return M.regression_metrics(model_store.store_predictions(scored, path, number), M.TARGET, "ml_prediction", ["split"])


def _scored(lg):
    """Predictions for the newest season, whose next season lies beyond the data, by the active version of a model store."""
    table = staged(X.above_replacement(dataset(lg)), "above")
    newest = table.agg(F.max("season")).scalar()
    return model_store.predict(table.filter(F.col("season") == newest), _active_version(lg)).drop("created_at")


@query()
def scored_predictions(lg):
    """Next-season predictions of the newest season as rows of the predictions table."""
    return _scored(lg)


@query("SELECT player_id, season + 1 AS target_season, 1 AS predictions, true AS not_negative FROM over WHERE season = (SELECT max(season) FROM over)", **FEATURE_CTES)
def scored_prediction_keys(lg):
    """Whom the newest season's predictions are for: each player once, with a value that isn't negative."""
    value = F.get_json_object("input_features", "$.predicted_hockey_value").cast("double")
    return _scored(lg).groupBy("player_id", "target_season").agg(F.count("*").alias("predictions"), F.min(value >= 0).alias("not_negative"))
