"""Season lines per player: totals never double-count a traded player.

Two rules exist for the same idea and both are kept, by name: the read path
sums every TOTAL row (else the team rows) and keeps missing as missing; the
model path takes the newest TOTAL row and counts missing as zero when it has
to add team rows up.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkline.functions.numbers import per_60, ratio
from rinkline.functions.dates import season_age
from rinkline.functions.text import plain_concat
from rinkline.operators.keyed import coverage_gap, prefer_newest_total, prefer_total

PLAYER_SEASON = ["player_id", "season_start_year"]
REGULAR_SEASON = 2

BASIC_COUNTS = [
    "games_played",
    "goals",
    "assists",
    "points",
    "plus_minus",
    "penalty_minutes",
    "power_play_goals",
    "power_play_points",
    "short_handed_goals",
    "shots",
]
ADVANCED_COUNTS = [
    "shifts",
    "takeaways",
    "giveaways",
    "shots_blocked",
    "penalties",
    "penalties_drawn",
]
GOALIE_COUNTS = [
    "games_played",
    "wins",
    "losses",
    "overtime_losses",
    "shots_against",
    "saves",
    "goals_against",
    "time_on_ice_seconds",
    "shutouts",
]


def regular(df: DataFrame, situation: str | None = None, any_case: bool = False) -> DataFrame:
    """Regular-season rows, of one situation for the advanced tables."""
    kept = df.filter(F.col("game_type") == REGULAR_SEASON)
    if situation is None:
        return kept
    value = F.lower("situation") if any_case else F.col("situation")
    return kept.filter(value == situation)


def _long(*names: str) -> dict[str, Column]:
    return {n: F.col(n).cast("bigint") for n in names}


def skater_lines(basic: DataFrame) -> DataFrame:
    """Traditional skater line per player-season, with shooting percentage."""
    lines = prefer_total(regular(basic), PLAYER_SEASON, _long(*BASIC_COUNTS))
    return lines.withColumn("shooting_percentage", ratio(F.col("goals"), F.col("shots")))


def advanced_lines(advanced: DataFrame) -> DataFrame:
    """Advanced skater line per player-season, with rates per 60 minutes.

    The on-ice share is weighted by ice time; a row without a share still
    counts its ice time in the weight.
    """
    time = F.col("ice_time_seconds")
    measures = {
        "ice_time_seconds": time,
        "game_score": F.col("game_score"),
        "individual_expected_goals": F.col("individual_expected_goals"),
        **_long(*ADVANCED_COUNTS),
        "_weighted": F.col("on_ice_expected_goals_pct") * time,
    }
    lines = prefer_total(regular(advanced, "all"), PLAYER_SEASON, measures)
    return lines.select(
        *PLAYER_SEASON,
        *[m for m in measures if m != "_weighted"],
        per_60(F.col("game_score"), time).alias("game_score_per_60"),
        per_60(F.col("individual_expected_goals"), time).alias("expected_goals_per_60"),
        ratio(F.col("_weighted"), time).alias("on_ice_expected_goals_pct"),
    )


def goalie_games(basic: DataFrame) -> DataFrame:
    return prefer_total(regular(basic), PLAYER_SEASON, _long("games_played"))


def goalie_lines(basic: DataFrame, advanced: DataFrame) -> DataFrame:
    """Goalie line per player-season: save share, goals-against average, saved above expected."""
    counts = prefer_total(regular(basic), PLAYER_SEASON, _long(*GOALIE_COUNTS))
    expected = prefer_total(
        regular(advanced, "all"),
        PLAYER_SEASON,
        {"xga": F.col("expected_goals_against"), "ga": F.col("goals_against").cast("double")},
    )
    return (
        counts.withColumn("save_percentage", ratio(F.col("saves").cast("double"), F.col("shots_against")))
        .withColumn("gaa", per_60(F.col("goals_against"), F.col("time_on_ice_seconds")))
        .join(expected, PLAYER_SEASON, "full")
        .withColumn("gsae", F.col("xga") - F.col("ga"))
    )


def stat_seasons(
    skaters: DataFrame,
    goalies: DataFrame,
    played_only: bool = False,
    first: int | None = None,
    last: int | None = None,
) -> DataFrame:
    """Distinct player-seasons with a regular-season line in either table."""
    rows = regular(skaters).select(*PLAYER_SEASON, "games_played").unionByName(
        regular(goalies).select(*PLAYER_SEASON, "games_played")
    )
    if played_only:
        rows = rows.filter(F.coalesce("games_played", F.lit(0)) > 0)
    return season_range(rows, first, last).select(*PLAYER_SEASON).distinct()


def season_range(df: DataFrame, first: int | None, last: int | None) -> DataFrame:
    """Optional bounds on the season; an absent bound adds no filter."""
    if first is not None:
        df = df.filter(F.col("season_start_year") >= first)
    if last is not None:
        df = df.filter(F.col("season_start_year") <= last)
    return df


def uncovered_seasons(played: DataFrame, contracts: DataFrame, contract_seasons: DataFrame) -> DataFrame:
    """Player-seasons without any contract season."""
    return coverage_gap(played, covered_seasons(contracts, contract_seasons), PLAYER_SEASON)


def covered_seasons(contracts: DataFrame, contract_seasons: DataFrame) -> DataFrame:
    owner = contracts.select(F.col("id").alias("contract_id"), "player_id")
    return contract_seasons.select("contract_id", "season_start_year").join(owner, "contract_id").select(*PLAYER_SEASON).distinct()


# --- model path ---------------------------------------------------------------------

MODEL_BASIC = BASIC_COUNTS
MODEL_ADVANCED = [
    "ice_time_seconds",
    "shifts",
    "game_score",
    "individual_points",
    "individual_goals",
    "individual_primary_assists",
    "individual_secondary_assists",
    "individual_expected_goals",
    "individual_shots_on_goal",
    "individual_unblocked_attempts",
    "shots_blocked",
    "takeaways",
    "giveaways",
    "penalties",
    "penalties_drawn",
    "offensive_zone_shift_starts",
    "defensive_zone_shift_starts",
    "neutral_zone_shift_starts",
]


def _newest() -> list[Column]:
    return [F.col("updated_at").isNull(), F.col("updated_at"), F.col("id")]


def _zero(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(0))


def model_skater_lines(basic: DataFrame) -> DataFrame:
    share = "shooting_percentage"
    return prefer_newest_total(
        regular(basic),
        PLAYER_SEASON,
        totals={**_long(*MODEL_BASIC), share: F.col(share)},
        parts=lambda only: {
            **{n: F.sum(only(_zero(n))) for n in MODEL_BASIC},
            share: ratio(F.sum(only(_zero("goals"))).cast("double"), F.sum(only(_zero("shots")))),
        },
        newest=_newest(),
    )


def model_advanced_lines(advanced: DataFrame) -> DataFrame:
    share, time = "on_ice_expected_goals_pct", "ice_time_seconds"
    doubles = {"ice_time_seconds", "game_score", "individual_expected_goals"}
    return prefer_newest_total(
        regular(advanced, "all", any_case=True),
        PLAYER_SEASON,
        totals={
            **{n: F.col(n).cast("double" if n in doubles else "bigint") for n in MODEL_ADVANCED},
            share: F.col(share),
        },
        parts=lambda only: {
            **{n: F.sum(only(_zero(n))) for n in MODEL_ADVANCED},
            share: ratio(F.sum(only(_zero(share) * _zero(time))), F.sum(only(_zero(time)))),
        },
        newest=_newest(),
    )


def model_player_seasons(tables: Mapping[str, DataFrame], min_games: int = 1) -> DataFrame:
    """Model input rows per skater-season (goalies out, unknown positions in)."""
    from rinkline.operators.quality import check_feature_options

    check_feature_options(min_games, 0.0)
    players = tables["players"].filter(F.coalesce("primary_position", F.lit("")) != "G")
    who = players.select(
        F.col("id").alias("player_id"),
        "first_name",
        "last_name",
        plain_concat(F.col("first_name"), F.lit(" "), F.col("last_name")).alias("player_name"),
        "birth_date",
        F.col("primary_position").alias("position"),
    )
    basic = model_skater_lines(tables["skater_season_stats"])
    advanced = model_advanced_lines(tables["skater_advanced_season_stats"])
    rows = (
        basic.join(advanced, PLAYER_SEASON, "left")
        .join(who, "player_id")
        .withColumn("age", season_age(F.col("birth_date"), F.col("season_start_year")))
        .withColumnRenamed("season_start_year", "season")
    )
    if min_games > 1:
        rows = rows.filter(F.coalesce("games_played", F.lit(0)) >= min_games)
    return rows


def salary_caps(seasons: DataFrame) -> DataFrame:
    return seasons.filter("salary_cap_cents is not null").select(
        F.col("start_year").alias("season"),
        "end_year",
        F.col("label").alias("season_label"),
        "salary_cap_cents",
        (F.col("salary_cap_cents").cast("double") / 100.0).alias("salary_cap_dollars"),
    )
