"""A league of our own with answers worked out by hand.

Season 2023. Forwards by seconds a game: Reed 600, Oak 800, Ash 1000, Quill 1200,
Elm 1400; the 20th percentile is 760, so Reed alone sets their replacement level
of 1.5 * 3600 / 15000 = 0.36 an hour. Quill: 40 * 3600 / 60000 = 2.4, hence
(2.4 - 0.36) * 60000 / 3600 = 34. Fir is the only defender and his own level.
"""

from datetime import date, datetime

from rinkline import schemas

YEAR = 2023
NOR, SUD, GON = 11, 12, 13
QUILL, REED, ASH, ELM, FIR, YEW, OAK, NIL = 21, 22, 23, 24, 25, 26, 27, 28

TEAMS = [
    (NOR, 7, "NOR", "Lanterns", "Nordhavn", True),
    (SUD, 8, "SUD", "Herons", "Sudmere", True),
    (GON, 9, "GON", "Gliders", "Gondal", False),
]
PLAYERS = [
    (QUILL, "Ada", "Quill", date(1999, 3, 14), "C", "R", "NOR", True, "ACTIVE"),
    (REED, "Bo", "Reed", date(2003, 11, 30), "LW", "L", "DEN", True, "ACTIVE"),
    (ASH, "Cy", "Ash", date(1992, 8, 19), "RW", "R", "LAT", True, "LTIR"),
    (ELM, "Di", "Elm", date(1995, 12, 1), "C", "L", "CAN", True, "ACTIVE"),
    (FIR, "Gus", "Fir", date(1990, 7, 7), "D", "R", "SVK", True, "ACTIVE"),
    (YEW, "Hal", "Yew", date(1997, 10, 25), "G", "L", "GER", True, "MINORS"),
    (OAK, "Fay", "Oak", date(2001, 1, 9), "RW", "L", "USA", True, "ACTIVE"),
    (NIL, "Ivy", "Nil", None, "F", None, None, False, "UNKNOWN"),
]
STINTS = [
    (1, QUILL, YEAR, NOR, date(2023, 10, 1), date(2024, 1, 15)),
    (2, QUILL, YEAR, SUD, date(2024, 1, 16), None),
    (3, REED, YEAR, NOR, date(2023, 10, 4), date(2023, 12, 20)),
    (4, REED, YEAR, SUD, date(2023, 12, 21), None),
    (5, ASH, YEAR, SUD, date(2023, 10, 1), None),
    (6, ELM, YEAR, SUD, date(2023, 10, 1), None),
    (7, FIR, YEAR, NOR, date(2023, 10, 9), None),
    (8, YEW, YEAR, NOR, date(2023, 11, 2), None),
    (9, OAK, YEAR, NOR, date(2023, 10, 1), None),
]
BASIC_COLUMNS = "player_id team_id stat_scope games_played goals assists points plus_minus penalty_minutes power_play_goals power_play_points short_handed_goals shots"
BASIC = [
    (QUILL, NOR, "TEAM", 30, 9, 12, 21, 3, 10, 2, 6, 0, 70),
    (QUILL, SUD, "TEAM", 20, 6, 10, 16, -1, 4, 1, 5, 1, 50),
    (QUILL, None, "TOTAL", 50, 15, 22, 37, 2, 14, 3, 11, 1, 120),
    (REED, NOR, "TEAM", 10, 1, 0, 1, -2, 0, 0, 0, 0, 9),
    (REED, SUD, "TEAM", 15, 2, 1, 3, -1, 6, 0, 1, 0, 14),
    (ASH, None, "TOTAL", 40, 8, 16, 24, 0, 12, 1, 4, 0, 88),
    (ELM, None, "TOTAL", 60, 31, 40, 71, 15, 8, 9, 22, 2, 210),
    (FIR, None, "TOTAL", 35, 3, 14, 17, 6, 20, 0, 5, 0, 64),
    (OAK, None, "TOTAL", 30, 5, 9, 14, -4, 2, 0, 2, 0, 40),
]
ADVANCED_COLUMNS = "player_id team_id stat_scope games_played ice_time_seconds shifts game_score individual_expected_goals on_ice_expected_goals_pct shots_blocked takeaways giveaways penalties penalties_drawn"
ADVANCED = [
    (QUILL, NOR, "TEAM", 30, 36000.0, 800, 24.0, 6.0, 0.52, 9, 7, 5, 4, 3),
    (QUILL, SUD, "TEAM", 20, 24000.0, 550, 16.0, 4.5, 0.545, 6, 5, 4, 2, 3),
    (QUILL, None, "TOTAL", 50, 60000.0, 1350, 40.0, 10.5, 0.53, 15, 12, 9, 6, 6),
    (REED, NOR, "TEAM", 10, 6000.0, 200, 0.5, 0.7, 0.40, 2, 1, 2, 0, 1),
    (REED, SUD, "TEAM", 15, 9000.0, 310, 1.0, 1.1, 0.45, 3, 2, 1, 3, 1),
    (ASH, None, "TOTAL", 40, 40000.0, 950, 12.0, 7.25, 0.49, 21, 9, 14, 6, 4),
    (ELM, None, "TOTAL", 60, 84000.0, 1700, 70.0, 26.0, 0.58, 25, 31, 16, 4, 13),
    (FIR, None, "TOTAL", 35, 42000.0, 1010, 14.0, 2.5, 0.51, 66, 8, 12, 9, 2),
    (OAK, None, "TOTAL", 30, 24000.0, 640, 6.0, 4.75, 0.47, 11, 6, 7, 1, 3),
]
GOALIE_COLUMNS = "player_id team_id stat_scope games_played wins losses overtime_losses shots_against saves goals_against shutouts time_on_ice_seconds"
GOALIE = [
    (YEW, NOR, "TEAM", 8, 5, 2, 1, 240, 222, 18, 1, 28800),
    (YEW, SUD, "TEAM", 6, 2, 3, 1, 180, 162, 18, 0, 21600),
    (YEW, None, "TOTAL", 14, 7, 5, 2, 420, 384, 36, 1, 50400),
]
CONTRACT_COLUMNS = "id player_id signing_team_id source_id external_id signed_on start_season end_season term_years contract_type expiry_status total_value_cents average_value_cents is_entry_level source_payload"
CONTRACTS = [
    (31, QUILL, NOR, 3, "deal-a", date(2023, 6, 20), 2023, 2024, 2, "STANDARD", "UFA", 1_240_000_000, 620_000_000, False, "{}"),
    (32, ASH, SUD, 3, "deal-b", date(2023, 8, 2), 2023, 2023, 1, "STANDARD", "UFA", 310_000_000, 310_000_000, False, "{}"),
    (33, YEW, NOR, 3, "deal-c", date(2023, 7, 11), 2023, 2023, 1, "ONE_WAY", "RFA", 90_000_000, 90_000_000, False, "{}"),
]
SEASON_COLUMNS = "id contract_id season_start_year owning_team_id base_salary_cents signing_bonus_cents total_cash_cents cap_hit_cents is_slide clauses"
CONTRACT_SEASONS = [
    (1, 31, 2023, SUD, 500_000_000, 120_000_000, 620_000_000, 620_000_000, False, "{}"),
    (2, 31, 2024, SUD, 620_000_000, 0, 620_000_000, 620_000_000, False, "{}"),
    (3, 32, 2023, SUD, 310_000_000, 0, 310_000_000, 310_000_000, False, "{}"),
    (4, 33, 2023, NOR, 90_000_000, 0, 90_000_000, 90_000_000, False, "{}"),
]
MODEL_COLUMNS = "id model_type version active created_at"
MODELS = [(5, "skater_value", "heron-1", True, datetime(2023, 9, 1))]
PREDICTION_COLUMNS = "id model_version_id player_id target_season position_group input_features created_at"
PREDICTIONS = [(1, 5, QUILL, 2024, "forward", '{"predicted_hockey_value": 33.25}', datetime(2023, 9, 2))]


def table(spark, name, columns, rows, **same):
    """A table of the schema; ``same`` columns hold one value in all rows."""
    types = {f.name: f.dataType.simpleString() for f in schemas.struct(name)}
    names = [*columns.split(), *same]
    full = [(*r, *same.values()) for r in rows]
    return schemas.conform(spark.createDataFrame(full, ", ".join(f"{c} {types[c]}" for c in names)), name)


def basic(spark, rows=BASIC):
    return table(spark, "skater_season_stats", BASIC_COLUMNS, rows, season_start_year=YEAR, game_type=2, source_id=1)


def advanced(spark, rows=ADVANCED):
    return table(spark, "skater_advanced_season_stats", ADVANCED_COLUMNS, rows, season_start_year=YEAR, game_type=2, situation="all", source_id=2)


def stints(spark, rows=STINTS):
    return table(spark, "player_team_stints", "id player_id season_start_year team_id joined_on departed_on", rows)


def players(spark, rows=PLAYERS):
    return table(spark, "players", "id first_name last_name birth_date primary_position shoots_catches nationality active roster_status", rows)


def tables(spark):
    expected = "player_id team_id stat_scope games_played ice_time_seconds expected_goals_against goals_against"
    return {
        "data_sources": schemas.seed_sources(spark),
        "seasons": schemas.seed_seasons(spark),
        "teams": table(spark, "teams", "id nhl_team_id abbreviation name city active", TEAMS),
        "players": players(spark),
        "player_team_stints": stints(spark),
        "skater_season_stats": basic(spark),
        "skater_advanced_season_stats": advanced(spark),
        "goalie_season_stats": table(spark, "goalie_season_stats", GOALIE_COLUMNS, GOALIE, season_start_year=YEAR, game_type=2, source_id=1),
        "goalie_advanced_season_stats": table(
            spark, "goalie_advanced_season_stats", expected, [(YEW, None, "TOTAL", 14, 50400.0, 40.5, 36.0)], season_start_year=YEAR, game_type=2, situation="all", source_id=2
        ),
        "contracts": table(spark, "contracts", CONTRACT_COLUMNS, CONTRACTS),
        "contract_seasons": table(spark, "contract_seasons", SEASON_COLUMNS, CONTRACT_SEASONS),
        "model_versions": table(spark, "model_versions", MODEL_COLUMNS, MODELS),
        "predictions": table(spark, "predictions", PREDICTION_COLUMNS, PREDICTIONS),
        "player_external_ids": schemas.empty(spark, "player_external_ids"),
        "ltir_overrides": schemas.empty(spark, "ltir_overrides"),
        "games": schemas.empty(spark, "games"),
    }
