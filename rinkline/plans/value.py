"""Replacement level, player value and the player-season summary."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkline.functions.dates import whole_years
from rinkline.functions.text import display_name, read_position_group
from rinkline.operators.keyed import first_per_key
from rinkline.operators.quantiles import group_quantiles
from rinkline.plans.stats import (
    PLAYER_SEASON,
    advanced_lines,
    goalie_games,
    skater_lines,
)
from rinkline.session import staged

MINIMUM_GAMES = 20
PERCENTILE = 0.20
MODEL_TYPES = ["skater_value", "skater-value"]
PAYLOAD_KEY = "predicted_hockey_value"
FALLBACK_VERSION = "replacement-level-v1"


def season_team(stints: DataFrame, teams: DataFrame) -> DataFrame:
    """Current team per player-season: an open stint first, then the latest one."""
    # a league's team ids go to every task: a shuffle by team would move every stint
    known = stints.join(F.broadcast(teams.select(F.col("id").alias("team_id"))), "team_id", "left_semi")
    order = [
        F.col("departed_on").isNull().desc(),
        F.col("departed_on").desc_nulls_last(),
        F.col("joined_on").desc_nulls_last(),
        F.col("id").desc(),
    ]
    return first_per_key(known, PLAYER_SEASON, order).select(*PLAYER_SEASON, "team_id")


def latest_team(stints: DataFrame, by_join_date: bool = True) -> DataFrame:
    """Latest team per player over all seasons.

    The roster counts use the variant that ignores the join date.
    """
    order = [
        F.col("season_start_year").desc(),
        F.col("departed_on").isNull().desc(),
        F.col("departed_on").desc_nulls_last(),
        *([F.col("joined_on").desc_nulls_last()] if by_join_date else []),
        F.col("id").desc(),
    ]
    return first_per_key(stints, ["player_id"], order).select("player_id", "team_id")


def active_model(model_versions: DataFrame) -> DataFrame:
    """The newest active value model (at most one row)."""
    active = model_versions.filter(F.col("active") & F.col("model_type").isin(MODEL_TYPES))
    newest = active.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(1)
    return newest.select(F.col("id").alias("model_version_id"), "version")


def projections(
    predictions: DataFrame, model_versions: DataFrame, payload_key: str = PAYLOAD_KEY
) -> DataFrame:
    """Latest prediction per player-season by the active model that carries the value.

    A payload with the key but a JSON null (or '') still counts as the latest
    prediction, with a null value. Ties on the time go to the higher id.
    """
    has_key = F.array_contains(F.json_object_keys("input_features"), payload_key)
    value = F.nullif(F.get_json_object("input_features", f"$.{payload_key}"), F.lit(""))
    kept = predictions.filter(has_key).join(
        F.broadcast(active_model(model_versions)), "model_version_id"
    )
    rows = kept.select(
        "player_id",
        (F.col("target_season") - 1).alias("season_start_year"),
        value.try_cast("double").alias("projected_hockey_value"),
        "created_at",
        "id",
    )
    order = [F.col("created_at").desc(), F.col("id").desc()]
    return first_per_key(rows, PLAYER_SEASON, order).drop("created_at", "id")


def cap_hits(contracts: DataFrame, contract_seasons: DataFrame) -> DataFrame:
    """Highest cap hit per player-season."""
    owner = contracts.select(F.col("id").alias("contract_id"), "player_id")
    return (
        contract_seasons.select("contract_id", "season_start_year", "cap_hit_cents")
        .join(owner, "contract_id")
        .groupBy(*PLAYER_SEASON)
        .agg(F.max("cap_hit_cents").cast("bigint").alias("cap_hit_cents"))
    )


# --- replacement level ----------------------------------------------------------------


def replacement_baseline(
    df: DataFrame,
    group: list[str],
    usage: str,
    metrics: list[str],
    percentile: float = PERCENTILE,
) -> tuple[DataFrame, DataFrame]:
    """(thresholds, baselines) per group of a stored frame of eligible rows.

    The pool is every row whose usage is at or under the group's usage
    percentile; the baseline is the pool's median of each metric.
    """
    thresholds = staged(group_quantiles(df, group, [usage], percentile).withColumnRenamed(usage, "threshold"), "thresholds")
    pool = df.join(thresholds, group).filter(F.col(usage) <= F.col("threshold"))
    baselines = group_quantiles(pool, group, metrics, 0.5)
    return thresholds, baselines


def skater_usage(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Games, ice time and rate per player-season with both kinds of line."""
    games = skater_lines(tables["skater_season_stats"]).select(
        *PLAYER_SEASON, F.col("games_played").alias("skater_games")
    )
    advanced = advanced_lines(tables["skater_advanced_season_stats"])
    return games.join(advanced, PLAYER_SEASON)


def read_eligible(lines: DataFrame, players: DataFrame, min_games: int = MINIMUM_GAMES) -> DataFrame:
    """Skater-seasons that set the replacement level on the read path.

    ``lines`` has skater_games, ice_time_seconds and game_score_per_60. A
    player without a position is left out of the pool (although the value
    join treats it as a forward).
    """
    skaters = players.filter(F.col("primary_position") != "G").select(
        F.col("id").alias("player_id"),
        read_position_group(F.col("primary_position")).alias("position_group"),
    )
    used = lines.filter((F.col("ice_time_seconds") > 0) & (F.col("skater_games") >= min_games))
    return used.join(skaters, "player_id").select(
        *PLAYER_SEASON,
        "position_group",
        (F.col("ice_time_seconds") / F.col("skater_games")).alias("toi_per_game"),
        "game_score_per_60",
    )


def read_replacement(eligible: DataFrame) -> DataFrame:
    """Baseline game score per 60 by season and position group, with its threshold."""
    stored = staged(eligible, "eligible")
    group = ["season_start_year", "position_group"]
    thresholds, baselines = replacement_baseline(
        stored, group, "toi_per_game", ["game_score_per_60"], PERCENTILE
    )
    return thresholds.withColumnRenamed("threshold", "toi_threshold").join(
        baselines.withColumnRenamed("game_score_per_60", "replacement_gs60"), group
    )


# --- summary -------------------------------------------------------------------------


def player_season_summary(
    tables: Mapping[str, DataFrame], season: int | None = None, payload_key: str = PAYLOAD_KEY
) -> DataFrame:
    """One row per player-season with lines, team, value, projection and cap hit.

    With a season every player gets a row for it, data or not; without one,
    every player-season that has any data gets its row. All parts are
    aggregated to the same key first, stacked and folded by one aggregate, so
    no part is joined to another through a shuffle of its own. The folded
    lines are stored once; the replacement level and the final projection
    both read them.
    """
    t = dict(tables)
    if season is not None:
        for name in (
            "player_team_stints",
            "skater_season_stats",
            "skater_advanced_season_stats",
            "goalie_season_stats",
            "contract_seasons",
        ):
            t[name] = t[name].filter(F.col("season_start_year") == season)
        t["predictions"] = t["predictions"].filter(F.col("target_season") == season + 1)
    players, teams = t["players"], t["teams"]
    basic = skater_lines(t["skater_season_stats"])
    goalies = goalie_games(t["goalie_season_stats"]).withColumnRenamed("games_played", "goalie_games")
    projected = projections(t["predictions"], t["model_versions"], payload_key)
    parts = [
        season_team(t["player_team_stints"], teams),
        basic.withColumnRenamed("games_played", "skater_games"),
        advanced_lines(t["skater_advanced_season_stats"]),
        goalies,
        projected.withColumn("has_projection", F.lit(True)),
        cap_hits(t["contracts"], t["contract_seasons"]),
    ]
    if season is not None:
        everyone = players.select(
            F.col("id").alias("player_id"), F.lit(season).alias("season_start_year")
        )
        parts.append(everyone)
    folded = staged(_fold(parts, PLAYER_SEASON), "lines")
    baselines = read_replacement(read_eligible(folded, players))
    version = active_model(t["model_versions"]).select("version")
    club = teams.select(
        F.col("id").alias("team_id"),
        "nhl_team_id",
        "abbreviation",
        F.col("name").alias("team_name"),
        F.col("city").alias("team_city"),
        F.col("active").alias("team_active"),
    )
    who = players.withColumnRenamed("id", "player_id").withColumn(
        "position_group", read_position_group(F.col("primary_position"))
    )
    over = F.col("game_score_per_60") - F.col("replacement_gs60")
    model = F.when(F.col("has_projection"), version.scalar()).when(
        F.col("game_score_per_60").isNotNull(),
        F.coalesce(version.scalar(), F.lit(FALLBACK_VERSION)),
    )
    level = F.broadcast(baselines.drop("toi_threshold"))  # a row per season and position group
    return (
        folded.join(who, "player_id")
        .join(club, "team_id", "left")
        .join(level, ["season_start_year", "position_group"], "left")
        .select(
            F.col("player_id").alias("id"),
            "first_name",
            "last_name",
            display_name(F.col("first_name"), F.col("last_name")).alias("full_name"),
            "birth_date",
            whole_years(F.col("birth_date"), F.current_date()).alias("age"),
            "primary_position",
            "shoots_catches",
            "nationality",
            "active",
            "roster_status",
            "team_id",
            "nhl_team_id",
            "abbreviation",
            "team_name",
            "team_city",
            "team_active",
            F.col("season_start_year").alias("season"),
            F.coalesce("skater_games", "goalie_games").alias("games_played"),
            "goals",
            "assists",
            "points",
            "plus_minus",
            "penalty_minutes",
            "power_play_goals",
            "power_play_points",
            "short_handed_goals",
            "shots",
            "shooting_percentage",
            "ice_time_seconds",
            "shifts",
            "game_score",
            "game_score_per_60",
            "individual_expected_goals",
            "expected_goals_per_60",
            "on_ice_expected_goals_pct",
            "takeaways",
            "giveaways",
            "shots_blocked",
            "penalties",
            "penalties_drawn",
            (over * F.col("ice_time_seconds") / 3600.0).alias("hockey_value"),
            "projected_hockey_value",
            over.alias("gs60_above_replacement"),
            model.alias("model_version"),
            "cap_hit_cents",
        )
    )


def _fold(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Frames with one row per key and disjoint columns, folded to one row per key."""
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part, allowMissingColumns=True)
    values = [c for c in stacked.columns if c not in keys]
    return stacked.groupBy(*keys).agg(*[F.expr(f"max({c}) as {c}") for c in values])
