"""Model dataset, features and replacement level per (season, position group)."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkline.functions.numbers import above, finite, per_60, positive, share_of
from rinkline.functions.text import position_group
from rinkline.operators.quality import (
    assert_columns,
    assert_frame,
    assert_no_leakage,
    check_feature_options,
)
from rinkline.plans.stats import model_player_seasons, salary_caps
from rinkline.plans.value import replacement_baseline
from rinkline.session import staged

MINIMUM_GAMES = 20
PERCENTILE = 0.20
CAP_SCALE_DOLLARS = 100_000_000.0

# fixed values: rate features and the counts they come from
RATES = {
    "goals_per_60": "goals",
    "assists_per_60": "assists",
    "points_per_60": "points",
    "xg_per_60": "individual_expected_goals",
    "shots_on_goal_per_60": "individual_shots_on_goal",
    "unblocked_attempts_per_60": "individual_unblocked_attempts",
    "game_score_per_60": "game_score",
    "primary_assists_per_60": "individual_primary_assists",
    "secondary_assists_per_60": "individual_secondary_assists",
    "takeaways_per_60": "takeaways",
    "giveaways_per_60": "giveaways",
    "blocks_per_60": "shots_blocked",
    "penalties_per_60": "penalties",
    "penalties_drawn_per_60": "penalties_drawn",
}
ZONES = {
    "offensive_zone_start_pct": "offensive_zone_shift_starts",
    "defensive_zone_start_pct": "defensive_zone_shift_starts",
    "neutral_zone_start_pct": "neutral_zone_shift_starts",
}
# fixed values: metrics held against the replacement level, by direction
HIGHER_IS_BETTER = [
    "goals_per_60",
    "primary_assists_per_60",
    "secondary_assists_per_60",
    "points_per_60",
    "xg_per_60",
    "shots_on_goal_per_60",
    "unblocked_attempts_per_60",
    "game_score_per_60",
    "takeaways_per_60",
    "blocks_per_60",
    "penalties_drawn_per_60",
    "penalty_differential_per_60",
    "goals_above_expected_per_60",
    "on_ice_expected_goals_pct",
]
LOWER_IS_BETTER = ["giveaways_per_60", "penalties_per_60"]
REPLACEMENT_METRICS = HIGHER_IS_BETTER + LOWER_IS_BETTER

REQUIRED = [
    "player_id",
    "season",
    "games_played",
    "ice_time_seconds",
    *RATES.values(),
    *ZONES.values(),
    "on_ice_expected_goals_pct",
]
GRAIN = ["player_id", "season"]


def join_salary_caps(players: DataFrame, caps: DataFrame) -> DataFrame:
    """Player-seasons with their season's cap, its fixed-scale fraction and the position group."""
    wanted = caps.select("season", "season_label", "salary_cap_cents", "salary_cap_dollars")
    joined = players.join(wanted, "season", "left")
    fraction = F.col("salary_cap_dollars") / CAP_SCALE_DOLLARS
    return joined.withColumn("position_group", position_group(F.col("position"))).withColumn(
        "salary_cap_fraction", fraction
    )


def model_dataset(tables: Mapping[str, DataFrame], min_games: int = 1, check: bool = True) -> DataFrame:
    """Player seasons with caps; checked for grain, unique caps and contract leakage."""
    players = model_player_seasons(tables, min_games)
    caps = salary_caps(tables["seasons"])
    if check:
        assert_frame(caps, ["season", "salary_cap_cents"], ["season"])
        assert_frame(players, ["player_id", "season", "position", "games_played"], GRAIN)
    kept = players.filter(F.coalesce("games_played", F.lit(0)) >= min_games)
    dataset = join_salary_caps(kept, caps)
    assert_no_leakage(dataset)
    return dataset


def feature_frame(df: DataFrame, min_games: int = MINIMUM_GAMES, check: bool = False) -> DataFrame:
    """Rates per 60, differentials, zone-start shares and the training eligibility flag."""
    check_feature_options(min_games, PERCENTILE, CAP_SCALE_DOLLARS)
    assert_columns(df, REQUIRED)
    if check:
        assert_frame(df, REQUIRED, GRAIN)
    if "position_group" not in df.columns:
        df = df.withColumn("position_group", position_group(F.col("position")))
    time = F.col("ice_time_seconds").cast("double")
    rates = {name: per_60(F.col(source), time) for name, source in RATES.items()}
    expected = (F.col("goals") - F.col("individual_expected_goals")).cast("double")
    zones = {name: share_of(F.col(c), *[F.col(z) for z in ZONES.values()]) for name, c in ZONES.items()}
    eligible = (F.coalesce("games_played", F.lit(0)) >= min_games) & (F.coalesce(time, F.lit(0.0)) > 0)
    out = {
        "toi_minutes": time / 60.0,
        "toi_hours": time / 3600.0,
        **rates,
        "net_takeaways_per_60": rates["takeaways_per_60"] - rates["giveaways_per_60"],
        "penalty_differential_per_60": rates["penalties_drawn_per_60"] - rates["penalties_per_60"],
        "goals_above_expected": expected,
        "goals_above_expected_per_60": per_60(expected, time),
        **zones,
        "eligible_for_training": eligible,
    }
    flag = "eligible_for_training"
    # an infinite or NaN input (or a quotient of one) counts as missing
    clean = {n: v if n == flag else finite(v.cast("double")) for n, v in out.items()}
    return df.select(*[c for c in df.columns if c not in out], *[v.alias(n) for n, v in clean.items()])


def training_rows(df: DataFrame, min_games: int = MINIMUM_GAMES) -> DataFrame:
    return feature_frame(df, min_games).filter("eligible_for_training")


def above_replacement(
    df: DataFrame,
    percentile: float = PERCENTILE,
    min_games: int = MINIMUM_GAMES,
) -> DataFrame:
    """Features with thresholds, baselines, pool flag and metrics above replacement."""
    check_feature_options(min_games, percentile)
    games = positive(F.col("games_played"))
    featured = feature_frame(df, min_games).withColumn("toi_per_game", F.col("toi_minutes") / games)
    rows = staged(featured, "features")
    eligible = rows.filter(
        F.col("eligible_for_training")
        & F.col("position_group").isNotNull()
        & F.col("toi_per_game").isNotNull()
    )
    group = ["season", "position_group"]
    thresholds, baselines = replacement_baseline(
        eligible, group, "toi_per_game", REPLACEMENT_METRICS, percentile
    )
    baselines = baselines.select(*group, *[F.col(m).alias(f"replacement_{m}") for m in REPLACEMENT_METRICS])
    thresholds = thresholds.withColumnRenamed("threshold", "replacement_toi_per_game_threshold")
    level = thresholds.join(baselines, group, "left")
    in_pool = (
        F.col("eligible_for_training")
        & F.col("position_group").isNotNull()
        & (F.col("toi_per_game") <= F.col("replacement_toi_per_game_threshold"))
    )
    gains = [
        above(F.col(m), F.col(f"replacement_{m}"), m in HIGHER_IS_BETTER).alias(f"{m}_above_replacement")
        for m in REPLACEMENT_METRICS
    ]
    # the grain is unique, so membership by key equals the row's own condition
    return rows.join(level, group, "left").select(
        "*", F.coalesce(in_pool, F.lit(False)).alias("is_replacement_pool"), *gains
    )


def replacement_report(df: DataFrame) -> dict[str, DataFrame]:
    """Pool size, pool by position, the newest twelve thresholds and the top fifteen players."""
    pool = df.filter("is_replacement_pool")
    group = ["season", "position_group", "replacement_toi_per_game_threshold"]
    limits = df.select(*group).distinct().orderBy(F.desc("season"), F.desc("position_group")).limit(12)
    top = df.filter("eligible_for_training").orderBy(
        F.col("game_score_per_60_above_replacement").desc_nulls_last(), "player_id", "season"
    )
    return {
        "pool_size": pool.agg(F.count(F.lit(1)).alias("pool_rows")),
        "pool_by_position": pool.groupBy("position_group").agg(F.count(F.lit(1)).alias("rows")),
        "thresholds": limits,
        "top": top.limit(15),
    }
