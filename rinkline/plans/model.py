"""Next-season value model: targets, temporal split, training, scoring and evaluation."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkline.operators.boosting import Booster, Settings
from rinkline.operators.boosting import fit as boost
from rinkline.operators.quality import QualityError, assert_frame, assert_none, grain_violations
from rinkline.functions.numbers import finite
from rinkline.operators.quantiles import group_quantiles, quantile_tiers
from rinkline.plans.features import above_replacement
from rinkline.session import staged

TARGET = "next_season_hockey_value"

# fixed values: model inputs in their published order
NUMERIC_FEATURES = [
    "games_played",
    "toi_hours",
    "toi_per_game",
    "goals_per_60",
    "primary_assists_per_60",
    "secondary_assists_per_60",
    "points_per_60",
    "xg_per_60",
    "shots_on_goal_per_60",
    "unblocked_attempts_per_60",
    "game_score_per_60",
    "takeaways_per_60",
    "giveaways_per_60",
    "net_takeaways_per_60",
    "blocks_per_60",
    "penalties_per_60",
    "penalties_drawn_per_60",
    "penalty_differential_per_60",
    "goals_above_expected_per_60",
    "on_ice_expected_goals_pct",
    "offensive_zone_start_pct",
    "defensive_zone_start_pct",
    "neutral_zone_start_pct",
    "goals_per_60_above_replacement",
    "primary_assists_per_60_above_replacement",
    "secondary_assists_per_60_above_replacement",
    "points_per_60_above_replacement",
    "xg_per_60_above_replacement",
    "game_score_per_60_above_replacement",
    "takeaways_per_60_above_replacement",
    "giveaways_per_60_above_replacement",
    "blocks_per_60_above_replacement",
    "penalties_per_60_above_replacement",
    "penalties_drawn_per_60_above_replacement",
    "penalty_differential_per_60_above_replacement",
    "goals_above_expected_per_60_above_replacement",
    "on_ice_expected_goals_pct_above_replacement",
]
CATEGORICAL_FEATURES = ["position_group"]

# fixed values: default tolerances of the metric gate and its published limits
TOLERANCES = {"mae": 0.25, "rmse": 0.35, "r2": 0.05}
GATE_LIMITS = {
    "train": {"mae": 7.6307295257, "rmse": 10.3311876346, "r2": 0.6501067487},
    "validation": {"mae": 8.2497447023, "rmse": 11.3177165668, "r2": 0.6429673612},
    "test": {"mae": 9.3361370822, "rmse": 13.2279709137, "r2": 0.5664511622},
}
SPLITS = ["train", "validation", "test"]
MODEL_TYPE = "skater_value"


class Options(NamedTuple):
    """Fixed values of the published model: step 0.05, 300 rounds, 31 leaves, L2 of 1; trees have no depth limit there."""

    step_size: float = 0.05
    iterations: int = 300
    leaves: int = 31
    l2: float = 1.0
    depth: int | None = None


# --- targets ---------------------------------------------------------------------------


def training_data(df: DataFrame, **options) -> DataFrame:
    """Training rows with the value of the next season.

    A player without a next season, or with an unknown value in it, gets 0.
    Rows whose target season lies beyond the newest season of all rows are
    dropped.
    """
    rows = above_replacement(df, **options)
    value = F.col("game_score_per_60_above_replacement") * F.col("toi_hours")
    targets = rows.select("player_id", F.col("season").alias("target_season"), value.alias(TARGET))
    newest = rows.agg(F.max("season")).scalar()
    current = (
        rows.filter("eligible_for_training and position_group is not null")
        .withColumn("current_hockey_value", value)
        .withColumn("target_season", F.col("season") + 1)
        .filter(F.col("target_season") <= newest)
    )
    joined = current.join(targets, ["player_id", "target_season"], "left")
    return joined.withColumn(TARGET, F.coalesce(F.col(TARGET), F.lit(0.0)))


def target_seasons(df: DataFrame) -> tuple[int, int]:
    """(validation, test) target seasons: the last two of at least three."""
    season = F.col("target_season").cast("double")
    bad = df.filter(season.isNull() | F.isnan(season) | (season != F.floor(season)))
    assert_none(bad.select("target_season"), "target season")
    newest = [int(r[0]) for r in df.select("target_season").distinct().orderBy(F.desc("target_season")).limit(3).collect()]
    if len(newest) < 3:
        raise QualityError(f"at least three target seasons are needed, found {sorted(newest)}")
    return newest[1], newest[0]


def split_of(validation: int, test: int) -> Column:
    at = F.col("target_season")
    return F.when(at == test, "test").when(at == validation, "validation").when(at < validation, "train")


def temporal_split(df: DataFrame) -> dict[str, DataFrame]:
    validation, test = target_seasons(df)
    split = split_of(validation, test)
    return {name: df.filter(split == name) for name in SPLITS}


# --- fitting ---------------------------------------------------------------------------


def fill_values(stored: DataFrame) -> dict[str, float | str]:
    """Median of every numeric input and the most frequent position group of a stored frame."""
    numbers = stored.select(F.lit(1).alias("_all"), *[finite(F.col(c).cast("double")).alias(c) for c in NUMERIC_FEATURES])
    medians = group_quantiles(numbers, ["_all"], NUMERIC_FEATURES, 0.5).first()
    usual = (
        stored.filter("position_group is not null")
        .groupBy("position_group")
        .count()
        .orderBy(F.desc("count"), "position_group")
        .first()
    )
    fills = {c: (medians[c] if medians and medians[c] is not None else 0.0) for c in NUMERIC_FEATURES}
    return fills | {"position_group": usual[0] if usual else "forward"}


def model_inputs(df: DataFrame, fills: Mapping[str, float | str]) -> DataFrame:
    """Inputs as doubles with the training fills; NaN and infinities count as missing."""
    numbers = [F.coalesce(finite(F.col(c).cast("double")), F.lit(float(fills[c]))).alias(c) for c in NUMERIC_FEATURES]
    group = F.coalesce("position_group", F.lit(fills["position_group"])).alias("position_group")
    rest = [c for c in df.columns if c not in NUMERIC_FEATURES and c not in CATEGORICAL_FEATURES]
    return df.select(*rest, *numbers, group)


class Fitted(NamedTuple):
    """Trees, the fills of their inputs and the position groups they know; of another group all indicators are 0."""

    trees: Booster
    fills: dict[str, float | str]
    groups: list[str]

    def predict(self, df: DataFrame) -> DataFrame:
        rows = with_indicators(model_inputs(df, self.fills), self.groups)
        return rows.withColumn("ml_prediction", self.trees.predictor()).drop(*indicators(self.groups))

    def to_json(self) -> str:
        return json.dumps({"trees": self.trees.to_json(), "fills": self.fills, "groups": self.groups})

    @classmethod
    def from_json(cls, text: str) -> Fitted:
        held = json.loads(text)
        return cls(Booster.from_json(held["trees"]), held["fills"], held["groups"])


def indicators(groups: list[str]) -> list[str]:
    return [f"is_{g}" for g in groups]


def with_indicators(df: DataFrame, groups: list[str]) -> DataFrame:
    """One 0/1 column for each known position group."""
    return df.withColumns({name: F.coalesce(F.col("position_group") == g, F.lit(False)).cast("double") for name, g in zip(indicators(groups), groups)})


def fit(stored: DataFrame, options: Options = Options()) -> Fitted:
    """Fit on a stored frame: fills, one-hot position group, boosted trees."""
    fills = fill_values(stored)
    rows = model_inputs(stored, fills)
    groups = [r[0] for r in rows.select("position_group").distinct().orderBy("position_group").collect()]
    settings = Settings(options.step_size, options.iterations, options.leaves, options.l2, depth=options.depth)
    features = [*NUMERIC_FEATURES, *indicators(groups)]
    return Fitted(boost(with_indicators(rows, groups), features, TARGET, settings), fills, groups)


class Trained(NamedTuple):
    final: Fitted
    metadata: dict


def train(df: DataFrame, options: Options = Options()) -> Trained:
    """Fit on the train split, score all three, refit on everything before the test season."""
    assert_frame(df, ["player_id", "season", "target_season", TARGET, *NUMERIC_FEATURES, *CATEGORICAL_FEATURES], ["player_id", "season"])
    assert_none(df.filter(F.col(TARGET).isNull()).select("player_id", "season"), "missing target")
    stored = staged(df, "training")
    validation, test = target_seasons(stored)
    split = split_of(validation, test)
    first = fit(stored.filter(split == "train"), options)
    scored = first.predict(stored).withColumn("split", split)
    rows = regression_metrics(scored, TARGET, "ml_prediction", ["split"]).collect()  # three rows
    metrics = {r["split"]: {k: r[k] for k in ("rows", "mae", "rmse", "r2")} for r in rows}
    final = fit(stored.filter(F.col("target_season") < test), options)
    metadata = {
        "model_type": MODEL_TYPE,
        "target": TARGET,
        "contract_features_used": False,
        "numeric_features": NUMERIC_FEATURES,
        "categorical_features": CATEGORICAL_FEATURES,
        "validation_target_season": validation,
        "test_target_season": test,
        "metrics": metrics,
    }
    assert_metadata(metadata)
    return Trained(final, metadata)


def assert_metadata(metadata: Mapping) -> None:
    """Refuse metadata with contract features, other inputs, bad season order or no metrics."""
    expected = {
        "model_type": MODEL_TYPE,
        "target": TARGET,
        "contract_features_used": False,
        "numeric_features": NUMERIC_FEATURES,
        "categorical_features": CATEGORICAL_FEATURES,
    }
    for name, value in expected.items():
        if metadata.get(name) != value:
            raise QualityError(f"model metadata: {name} is {metadata.get(name)!r}")
    if not metadata["validation_target_season"] < metadata["test_target_season"]:
        raise QualityError("model metadata: validation season must come before the test season")
    for split in SPLITS:
        found = metadata["metrics"].get(split, {})
        whole = all(math.isfinite(found.get(k, math.nan)) for k in ("mae", "rmse", "r2"))
        if not whole or found.get("rows", 0) <= 0:
            raise QualityError(f"model metadata: no usable {split} metrics")


# --- metrics ---------------------------------------------------------------------------


def regression_metrics(
    df: DataFrame, actual: str, predicted: str, group: list[str] | None = None
) -> DataFrame:
    """rows, mae, rmse and r2 (null for a constant target), overall or per group; one aggregate."""
    y, error = F.col(actual), F.col(predicted) - F.col(actual)
    found = df.groupBy(*(group or [])).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(F.abs(error)).alias("mae"),
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.sum(error * error).alias("_sse"),
        (F.var_pop(y) * F.count(y)).alias("_sst"),
    )
    r2 = 1 - F.col("_sse") / F.nullif("_sst", F.lit(0.0))
    return found.select(*(group or []), "rows", "mae", "rmse", r2.alias("r2"))


def metric_regressions(current: DataFrame, baseline: DataFrame, tolerance: Mapping[str, float] = TOLERANCES) -> DataFrame:
    """(split, metric, regression) worse than the baseline by more than the tolerance.

    Both frames have split, metric and value. mae and rmse are worse when
    higher, r2 when lower. Metrics that are missing or not finite count as
    regressions too.
    """
    if set(tolerance) != {"mae", "rmse", "r2"} or not all(math.isfinite(t) and t >= 0 for t in tolerance.values()):
        raise QualityError("tolerances for mae, rmse and r2 must be finite and not negative")
    limits = F.create_map(*[F.lit(x) for pair in tolerance.items() for x in pair])
    both = baseline.select("split", "metric", F.col("value").alias("was")).join(
        current.select("split", "metric", F.col("value").alias("now")), ["split", "metric"], "left"
    )
    change = F.when(F.col("metric") == "r2", F.col("was") - F.col("now")).otherwise(F.col("now") - F.col("was"))
    unusable = F.col("now").isNull() | F.isnan("now") | (F.abs("now") == float("inf"))
    return both.withColumn("regression", change).filter(
        unusable | (F.col("regression") > limits[F.col("metric")])
    ).select("split", "metric", "regression")


def metric_rows(metrics: DataFrame) -> DataFrame:
    """Wide metric rows (split, mae, rmse, r2) as (split, metric, value)."""
    return metrics.unpivot(["split"], ["mae", "rmse", "r2"], "metric", "value")


# --- scoring and evaluation --------------------------------------------------------------


def prediction_frame(df: DataFrame, predicted: str = "ml_prediction") -> DataFrame:
    """(player_id, season, prediction): never negative, finite, one per key."""
    keyed = df.select("player_id", F.col("target_season").alias("season"), F.col(predicted).cast("double").alias("_p"))
    assert_none(grain_violations(keyed, ["player_id", "season"]), "prediction grain")
    unusable = F.col("_p").isNull() | F.isnan("_p") | (F.abs("_p") == float("inf"))
    assert_none(keyed.filter(unusable), "prediction value")
    return keyed.select("player_id", "season", F.greatest("_p", F.lit(0.0)).alias("prediction"))


def evaluate(scored: DataFrame, test_season: int) -> DataFrame:
    """Test-season rows with errors of the model and of 'same value again', and quintile tiers."""
    rows = scored.filter(F.col("target_season") == test_season)
    if rows.isEmpty():
        raise QualityError(f"no rows for season {test_season}")
    ours, naive, actual = F.col("ml_prediction"), F.col("current_hockey_value"), F.col(TARGET)
    judged = rows.withColumns(
        {
            "naive_prediction": naive,
            "prediction_error": ours - actual,
            "absolute_error": F.abs(ours - actual),
            "ml_absolute_error": F.abs(ours - actual),
            "naive_absolute_error": F.abs(naive - actual),
            "improvement_vs_naive": F.abs(naive - actual) - F.abs(ours - actual),
        }
    )
    return quantile_tiers(judged, "ml_prediction", "prediction_tier", 5)


def calibration(judged: DataFrame) -> DataFrame:
    return (
        judged.filter("prediction_tier is not null")
        .groupBy("prediction_tier")
        .agg(
            F.count("player_id").alias("players"),
            F.avg("ml_prediction").alias("avg_prediction"),
            F.avg(TARGET).alias("avg_actual"),
        )
    )


def largest(judged: DataFrame, column: str, n: int = 20) -> DataFrame:
    """Rows with the largest value of a column, e.g. absolute_error or improvement_vs_naive."""
    return judged.orderBy(F.col(column).desc_nulls_last(), "player_id").limit(n)


def score(fitted: Fitted, features: DataFrame, model_version_id: int) -> DataFrame:
    """Rows for the ``predictions`` table; the value travels in the JSON payload."""
    scored = fitted.predict(features)
    value = F.greatest("ml_prediction", F.lit(0.0)).alias("predicted_hockey_value")
    return scored.select(
        F.lit(model_version_id).cast("bigint").alias("model_version_id"),
        "player_id",
        (F.col("season") + 1).cast("int").alias("target_season"),
        "position_group",
        F.to_json(F.struct(value)).alias("input_features"),
        F.current_timestamp().alias("created_at"),
    )


def activate(model_versions: DataFrame, version_id: int) -> DataFrame:
    """Make one version the only active one of its type."""
    kind = model_versions.filter(F.col("id") == version_id).agg(F.max("model_type")).scalar()
    same = F.col("model_type") == kind
    return model_versions.withColumn(
        "active", F.when(same, F.col("id") == version_id).otherwise(F.col("active"))
    )


def metadata_json(metadata: Mapping) -> str:
    assert_metadata(metadata)
    return json.dumps(metadata, indent=2, sort_keys=True) + "\n"
