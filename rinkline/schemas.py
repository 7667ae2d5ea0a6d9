"""Declared table schemas, reference data and table constraints.

Everything here is data: nothing is inferred from files, so every reader
passes an explicit schema and a typo in a feed fails at the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

# --- fixed values: table columns (the public data model) -------------------

TABLES: dict[str, str] = {
    "data_sources": "id bigint, code string, display_name string, base_url string",
    "seasons": (
        "start_year int, end_year int, label string, regular_start_date date, "
        "regular_end_date date, salary_cap_cents bigint"
    ),
    "teams": (
        "id bigint, nhl_team_id int, nhl_franchise_id int, abbreviation string, "
        "name string, city string, active boolean"
    ),
    "players": (
        "id bigint, first_name string, last_name string, birth_date date, "
        "primary_position string, shoots_catches string, nationality string, "
        "active boolean, roster_status string, roster_status_updated_at timestamp"
    ),
    "player_external_ids": (
        "id bigint, player_id bigint, source_id bigint, external_id string, "
        "source_slug string, source_name string"
    ),
    "ltir_overrides": (
        "id bigint, player_id bigint, start_date date, end_date date, notes string"
    ),
    "player_team_stints": (
        "id bigint, player_id bigint, season_start_year int, team_id bigint, "
        "joined_on date, departed_on date, roster_status string"
    ),
    "contracts": (
        "id bigint, player_id bigint, signing_team_id bigint, source_id bigint, "
        "external_id string, signed_on date, start_season int, end_season int, "
        "term_years int, contract_type string, expiry_status string, "
        "total_value_cents bigint, average_value_cents bigint, "
        "is_entry_level boolean, source_payload string"
    ),
    "contract_seasons": (
        "id bigint, contract_id bigint, season_start_year int, owning_team_id bigint, "
        "base_salary_cents bigint, signing_bonus_cents bigint, "
        "performance_bonus_cents bigint, total_cash_cents bigint, "
        "cap_hit_cents bigint, cap_percentage decimal(9,8), is_slide boolean, "
        "clauses string"
    ),
    "games": (
        "id bigint, nhl_game_id bigint, season_start_year int, game_type int, "
        "game_date date, start_time_utc timestamp, away_team_id bigint, "
        "home_team_id bigint, venue string, game_state string, away_score int, "
        "home_score int, last_synced_at timestamp"
    ),
    "ingestion_runs": (
        "id bigint, source_id bigint, job_name string, status string, "
        "started_at timestamp, finished_at timestamp, records_read bigint, "
        "records_created bigint, records_updated bigint, records_skipped bigint, "
        "error_message string, metadata string"
    ),
    "source_records": (
        "source_id bigint, entity_type string, external_key string, "
        "payload_hash string, payload string, fetched_at timestamp"
    ),
    "skater_season_stats": (
        "id bigint, player_id bigint, season_start_year int, team_id bigint, "
        "stat_scope string, game_type int, source_id bigint, games_played int, "
        "goals int, assists int, points int, plus_minus int, penalty_minutes int, "
        "power_play_goals int, power_play_points int, short_handed_goals int, "
        "shots int, shooting_percentage double, source_row_hash string, "
        "updated_at timestamp"
    ),
    "goalie_season_stats": (
        "id bigint, player_id bigint, season_start_year int, team_id bigint, "
        "stat_scope string, game_type int, source_id bigint, games_played int, "
        "wins int, losses int, overtime_losses int, shots_against int, saves int, "
        "save_percentage double, goals_against int, goals_against_average double, "
        "shutouts int, time_on_ice_seconds int, source_row_hash string, "
        "updated_at timestamp"
    ),
    "skater_advanced_season_stats": (
        "id bigint, player_id bigint, season_start_year int, team_id bigint, "
        "stat_scope string, game_type int, situation string, source_id bigint, "
        "games_played int, ice_time_seconds double, shifts int, game_score double, "
        "individual_points int, individual_goals int, "
        "individual_primary_assists int, individual_secondary_assists int, "
        "individual_expected_goals double, individual_shots_on_goal int, "
        "individual_unblocked_attempts int, on_ice_expected_goals_pct double, "
        "shots_blocked int, takeaways int, giveaways int, penalties int, "
        "penalties_drawn int, offensive_zone_shift_starts int, "
        "defensive_zone_shift_starts int, neutral_zone_shift_starts int, "
        "extra_metrics string, source_row_hash string, updated_at timestamp"
    ),
    "goalie_advanced_season_stats": (
        "id bigint, player_id bigint, season_start_year int, team_id bigint, "
        "stat_scope string, game_type int, situation string, source_id bigint, "
        "games_played int, ice_time_seconds double, expected_goals_against double, "
        "goals_against double, unblocked_shot_attempts int, "
        "blocked_shot_attempts int, expected_rebounds double, rebounds int, "
        "expected_freezes double, freezes int, expected_shots_on_goal double, "
        "shots_on_goal int, flurry_adjusted_expected_goals double, "
        "low_danger_shots int, medium_danger_shots int, high_danger_shots int, "
        "low_danger_expected_goals double, medium_danger_expected_goals double, "
        "high_danger_expected_goals double, low_danger_goals int, "
        "medium_danger_goals int, high_danger_goals int, extra_metrics string, "
        "source_row_hash string, updated_at timestamp"
    ),
    "player_game_stats": (
        "id bigint, game_id bigint, player_id bigint, team_id bigint, "
        "source_id bigint, position_type string, time_on_ice_seconds int, "
        "goals int, assists int, points int, shots int, saves int, "
        "goals_against int, extra_metrics string, source_row_hash string"
    ),
    "model_versions": (
        "id bigint, model_type string, version string, artifact_uri string, "
        "feature_schema string, training_start_season int, "
        "training_end_season int, evaluation_metrics string, active boolean, "
        "created_at timestamp"
    ),
    "predictions": (
        "id bigint, model_version_id bigint, player_id bigint, target_season int, "
        "actual_contract_season_id bigint, position_group string, "
        "predicted_aav_cents bigint, predicted_cap_percentage decimal(9,8), "
        "input_features string, created_at timestamp"
    ),
}

# --- fixed values: reference rows ------------------------------------------

SOURCES = [
    (1, "nhl", "NHL", "https://www.nhl.com"),
    (2, "moneypuck", "MoneyPuck", "https://moneypuck.com"),
    (3, "capwages", "CapWages", "https://capwages.com"),
    (4, "capspace", "CapSpace", None),
]

SALARY_CAP_MILLION_CENTS = {
    2005: 3900, 2006: 4400, 2007: 5030, 2008: 5670, 2009: 5680, 2010: 5940,
    2011: 6430, 2012: 7020, 2013: 6430, 2014: 6900, 2015: 7140, 2016: 7300,
    2017: 7500, 2018: 7950, 2019: 8150, 2020: 8150, 2021: 8150, 2022: 8250,
    2023: 8350, 2024: 8800, 2025: 9550, 2026: 10400,
}

ROSTER_STATUSES = ["ACTIVE", "MINORS", "LTIR", "UNKNOWN"]
POSITIONS = ["C", "LW", "RW", "D", "G", "F"]

# --- fixed values: row checks, unique keys, foreign keys --------------------

_SCOPE = (
    "(stat_scope = 'TEAM' AND team_id IS NOT NULL) "
    "OR (stat_scope = 'TOTAL' AND team_id IS NULL)"
)
_STAT_CHECKS = [("valid_scope", _SCOPE), ("valid_game_type", "game_type IN (2, 3)")]

CHECKS: dict[str, list[tuple[str, str]]] = {
    "seasons": [
        ("consecutive_years", "end_year = start_year + 1"),
        ("positive_salary_cap", "salary_cap_cents >= 0"),
        ("valid_dates", "regular_end_date >= regular_start_date"),
    ],
    "players": [
        ("valid_position", "primary_position IN ('C', 'LW', 'RW', 'D', 'G', 'F')"),
        ("valid_handedness", "shoots_catches IN ('L', 'R')"),
        ("roster_status", "roster_status IN ('ACTIVE', 'MINORS', 'LTIR', 'UNKNOWN')"),
    ],
    "ltir_overrides": [("valid_dates", "end_date >= start_date")],
    "player_team_stints": [("valid_dates", "departed_on >= joined_on")],
    "contracts": [
        ("valid_seasons", "end_season >= start_season"),
        ("positive_term", "term_years > 0"),
        ("valid_expiry_status", "expiry_status IN ('RFA', 'UFA')"),
        ("nonnegative_value", "total_value_cents >= 0"),
        ("nonnegative_average", "average_value_cents >= 0"),
    ],
    "contract_seasons": [
        ("nonnegative_base", "base_salary_cents >= 0"),
        ("nonnegative_signing_bonus", "signing_bonus_cents >= 0"),
        ("nonnegative_performance_bonus", "performance_bonus_cents >= 0"),
        ("nonnegative_cash", "total_cash_cents >= 0"),
        ("nonnegative_cap_hit", "cap_hit_cents >= 0"),
        ("nonnegative_cap_percentage", "cap_percentage >= 0"),
    ],
    "games": [
        ("valid_game_type", "game_type IN (1, 2, 3)"),
        ("distinct_teams", "away_team_id <> home_team_id"),
        ("nonnegative_away_score", "away_score >= 0"),
        ("nonnegative_home_score", "home_score >= 0"),
    ],
    "ingestion_runs": [
        ("valid_status", "status IN ('running', 'succeeded', 'failed', 'cancelled')"),
        ("nonnegative_read", "records_read >= 0"),
        ("nonnegative_created", "records_created >= 0"),
        ("nonnegative_updated", "records_updated >= 0"),
        ("nonnegative_skipped", "records_skipped >= 0"),
    ],
    "skater_season_stats": _STAT_CHECKS,
    "goalie_season_stats": _STAT_CHECKS,
    "skater_advanced_season_stats": _STAT_CHECKS,
    "goalie_advanced_season_stats": _STAT_CHECKS,
    "player_game_stats": [
        ("valid_position_type", "position_type IN ('skater', 'goalie')"),
    ],
    "model_versions": [
        ("valid_training_range", "training_end_season >= training_start_season"),
    ],
    "predictions": [
        ("valid_group", "position_group IN ('forward', 'defense', 'goalie')"),
        ("nonnegative_aav", "predicted_aav_cents >= 0"),
        ("nonnegative_cap_percentage", "predicted_cap_percentage >= 0"),
    ],
}


@dataclass(frozen=True)
class UniqueKey:
    """Key expressions, compared null-safely, over rows matching ``where``."""

    name: str
    exprs: tuple[str, ...]
    where: str = "true"


_BASIC_GRAIN = UniqueKey(
    "grain",
    ("player_id", "season_start_year", "coalesce(team_id, 0)", "stat_scope",
     "game_type", "source_id"),
)
_ADVANCED_GRAIN = UniqueKey(
    "grain",
    ("player_id", "season_start_year", "coalesce(team_id, 0)", "stat_scope",
     "game_type", "situation", "source_id"),
)

UNIQUE_KEYS: dict[str, list[UniqueKey]] = {
    "data_sources": [UniqueKey("code", ("code",))],
    "seasons": [UniqueKey("start_year", ("start_year",)), UniqueKey("label", ("label",))],
    "teams": [
        UniqueKey("abbreviation", ("abbreviation",)),
        UniqueKey("nhl_team_id", ("nhl_team_id",), "nhl_team_id IS NOT NULL"),
    ],
    "players": [UniqueKey("id", ("id",))],
    "player_external_ids": [UniqueKey("source_key", ("source_id", "external_id"))],
    "player_team_stints": [
        UniqueKey(
            "identity",
            ("player_id", "season_start_year", "team_id",
             "coalesce(joined_on, DATE '0001-01-01')"),
        )
    ],
    "contracts": [
        UniqueKey(
            "source_external_id",
            ("source_id", "external_id"),
            "source_id IS NOT NULL AND external_id IS NOT NULL",
        )
    ],
    "contract_seasons": [UniqueKey("contract_year", ("contract_id", "season_start_year"))],
    "games": [UniqueKey("nhl_game_id", ("nhl_game_id",))],
    "source_records": [
        UniqueKey("version", ("source_id", "entity_type", "external_key", "payload_hash"))
    ],
    "skater_season_stats": [_BASIC_GRAIN],
    "goalie_season_stats": [_BASIC_GRAIN],
    "skater_advanced_season_stats": [_ADVANCED_GRAIN],
    "goalie_advanced_season_stats": [_ADVANCED_GRAIN],
    "player_game_stats": [UniqueKey("row", ("game_id", "player_id", "team_id", "source_id"))],
    "model_versions": [
        UniqueKey("model_version", ("model_type", "version")),
        UniqueKey("one_active_per_type", ("model_type",), "active"),
    ],
}

# table -> (column, parent table, parent column)
FOREIGN_KEYS: dict[str, list[tuple[str, str, str]]] = {
    "player_external_ids": [("player_id", "players", "id"), ("source_id", "data_sources", "id")],
    "ltir_overrides": [("player_id", "players", "id")],
    "player_team_stints": [
        ("player_id", "players", "id"),
        ("season_start_year", "seasons", "start_year"),
        ("team_id", "teams", "id"),
    ],
    "contracts": [
        ("player_id", "players", "id"),
        ("signing_team_id", "teams", "id"),
        ("source_id", "data_sources", "id"),
        ("start_season", "seasons", "start_year"),
        ("end_season", "seasons", "start_year"),
    ],
    "contract_seasons": [
        ("contract_id", "contracts", "id"),
        ("season_start_year", "seasons", "start_year"),
        ("owning_team_id", "teams", "id"),
    ],
    "games": [
        ("season_start_year", "seasons", "start_year"),
        ("away_team_id", "teams", "id"),
        ("home_team_id", "teams", "id"),
    ],
    "ingestion_runs": [("source_id", "data_sources", "id")],
    "source_records": [("source_id", "data_sources", "id")],
    "player_game_stats": [
        ("game_id", "games", "id"),
        ("player_id", "players", "id"),
        ("team_id", "teams", "id"),
        ("source_id", "data_sources", "id"),
    ],
    "predictions": [
        ("model_version_id", "model_versions", "id"),
        ("player_id", "players", "id"),
        ("target_season", "seasons", "start_year"),
        ("actual_contract_season_id", "contract_seasons", "id"),
    ],
    **{
        table: [
            ("player_id", "players", "id"),
            ("season_start_year", "seasons", "start_year"),
            ("team_id", "teams", "id"),
            ("source_id", "data_sources", "id"),
        ]
        for table in (
            "skater_season_stats",
            "goalie_season_stats",
            "skater_advanced_season_stats",
            "goalie_advanced_season_stats",
        )
    },
}


# --- fixed values: metric layouts (column, source field, is integer) ---------


@dataclass(frozen=True)
class Metric:
    column: str
    field: str
    integer: bool = False


def _layout(integers: str, spec: str) -> list[Metric]:
    whole = set(integers.split())
    pairs = [item.split(":") for item in spec.split()]
    return [Metric(column, field, column in whole) for column, field in pairs]


ADVANCED_SKATER = _layout(
    "games_played shifts individual_points individual_goals "
    "individual_primary_assists individual_secondary_assists "
    "individual_shots_on_goal individual_unblocked_attempts shots_blocked "
    "takeaways giveaways penalties penalties_drawn offensive_zone_shift_starts "
    "defensive_zone_shift_starts neutral_zone_shift_starts",
    "games_played:games_played ice_time_seconds:icetime shifts:shifts "
    "game_score:gameScore individual_points:I_F_points individual_goals:I_F_goals "
    "individual_primary_assists:I_F_primaryAssists "
    "individual_secondary_assists:I_F_secondaryAssists "
    "individual_expected_goals:I_F_xGoals "
    "individual_shots_on_goal:I_F_shotsOnGoal "
    "individual_unblocked_attempts:I_F_unblockedShotAttempts "
    "on_ice_expected_goals_pct:onIce_xGoalsPercentage "
    "shots_blocked:shotsBlockedByPlayer takeaways:I_F_takeaways "
    "giveaways:I_F_giveaways penalties:penalties penalties_drawn:penaltiesDrawn "
    "offensive_zone_shift_starts:I_F_oZoneShiftStarts "
    "defensive_zone_shift_starts:I_F_dZoneShiftStarts "
    "neutral_zone_shift_starts:I_F_neutralZoneShiftStarts",
)

ADVANCED_GOALIE = _layout(
    "games_played unblocked_shot_attempts blocked_shot_attempts rebounds freezes "
    "shots_on_goal low_danger_shots medium_danger_shots high_danger_shots "
    "low_danger_goals medium_danger_goals high_danger_goals",
    "games_played:games_played ice_time_seconds:icetime "
    "expected_goals_against:xGoals goals_against:goals "
    "unblocked_shot_attempts:unblocked_shot_attempts "
    "blocked_shot_attempts:blocked_shot_attempts expected_rebounds:xRebounds "
    "rebounds:rebounds expected_freezes:xFreeze freezes:freeze "
    "expected_shots_on_goal:xOnGoal shots_on_goal:ongoal "
    "flurry_adjusted_expected_goals:flurryAdjustedxGoals "
    "low_danger_shots:lowDangerShots medium_danger_shots:mediumDangerShots "
    "high_danger_shots:highDangerShots low_danger_expected_goals:lowDangerxGoals "
    "medium_danger_expected_goals:mediumDangerxGoals "
    "high_danger_expected_goals:highDangerxGoals low_danger_goals:lowDangerGoals "
    "medium_danger_goals:mediumDangerGoals high_danger_goals:highDangerGoals",
)

BASIC_SKATER = _layout(
    "games_played goals assists points plus_minus penalty_minutes "
    "power_play_goals power_play_points short_handed_goals shots",
    "games_played:gamesPlayed goals:goals assists:assists points:points "
    "plus_minus:plusMinus penalty_minutes:penaltyMinutes power_play_goals:ppGoals "
    "power_play_points:ppPoints short_handed_goals:shGoals shots:shots "
    "shooting_percentage:shootingPct",
)

BASIC_GOALIE = _layout(
    "games_played wins losses overtime_losses shots_against saves goals_against "
    "shutouts time_on_ice_seconds",
    "games_played:gamesPlayed wins:wins losses:losses overtime_losses:otLosses "
    "shots_against:shotsAgainst saves:saves save_percentage:savePct "
    "goals_against:goalsAgainst goals_against_average:goalsAgainstAverage "
    "shutouts:shutouts time_on_ice_seconds:timeOnIce",
)


def layout(kind: str, advanced: bool) -> list[Metric]:
    """Metric layout of one feed: ``kind`` is 'skater' or 'goalie'."""
    return {
        ("skater", True): ADVANCED_SKATER,
        ("goalie", True): ADVANCED_GOALIE,
        ("skater", False): BASIC_SKATER,
        ("goalie", False): BASIC_GOALIE,
    }[(kind, advanced)]


def stat_table(kind: str, advanced: bool) -> str:
    return f"{kind}_advanced_season_stats" if advanced else f"{kind}_season_stats"


# --- helpers -----------------------------------------------------------------


def struct(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], struct(table))


def conform(df: DataFrame, table: str) -> DataFrame:
    """Project onto a table's columns and types; absent columns become null."""
    have = set(df.columns)
    return df.selectExpr(
        *[
            f"cast({f.name if f.name in have else 'null'} as {f.dataType.simpleString()}) as {f.name}"
            for f in struct(table).fields
        ]
    )


def seed_sources(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SOURCES, struct("data_sources"))


def seed_seasons(spark: SparkSession) -> DataFrame:
    rows = [
        (y, y + 1, f"{y}-{(y + 1) % 100:02d}", None, None, cap * 1_000_000)
        for y, cap in SALARY_CAP_MILLION_CENTS.items()
    ]
    return spark.createDataFrame(rows, struct("seasons"))
