"""Read views over the summary: lists, careers, leaders, teams, search, comparison.

Every view takes the stored summary frame (``player_season_summary`` once,
for all seasons) and is a filter, join or bounded sort of it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkline.functions.dates import whole_years
from rinkline.functions.text import display_name
from rinkline.operators.keyed import top_per_key
from rinkline.plans import contracts as C
from rinkline.plans.stats import goalie_lines, stat_seasons
from rinkline.plans.value import latest_team
from rinkline.schemas import ROSTER_STATUSES

ROSTER_LIMIT = 100
CAREER_LIMIT = 40
LEADERS = 5

# fixed values: public sort keys and the columns they stand for
SORT_COLUMNS = {
    "name": "full_name",
    "team": "abbreviation",
    "gamesPlayed": "games_played",
    "goals": "goals",
    "assists": "assists",
    "points": "points",
    "gameScore": "game_score",
    "gameScorePer60": "game_score_per_60",
    "hockeyValue": "hockey_value",
    "capHitCents": "cap_hit_cents",
}

TEAM_COLUMNS = ["team_id", "nhl_team_id", "abbreviation", "team_name", "team_city", "team_active"]
IDENTITY_COLUMNS = [
    "id",
    "first_name",
    "last_name",
    "full_name",
    "birth_date",
    "age",
    "primary_position",
    "shoots_catches",
    "nationality",
    "active",
    "roster_status",
]


class RequestError(ValueError):
    """A query argument that cannot be served."""


# --- shapes -----------------------------------------------------------------------


def team_struct() -> Column:
    """The team as a struct, null when the row has no team."""
    fields = F.struct(
        F.col("team_id").alias("id"),
        "nhl_team_id",
        "abbreviation",
        F.col("team_name").alias("name"),
        F.col("team_city").alias("city"),
        F.col("team_active").alias("active"),
    )
    return F.when(F.col("team_id").isNotNull(), fields)


def list_rows(summary: DataFrame) -> DataFrame:
    """The list form of summary rows: nested team, ice time rounded half-even."""
    return summary.select(
        *IDENTITY_COLUMNS,
        team_struct().alias("team"),
        "season",
        "games_played",
        "goals",
        "assists",
        "points",
        F.bround("ice_time_seconds").cast("bigint").alias("toi_seconds"),
        "game_score",
        "game_score_per_60",
        "hockey_value",
        F.col("projected_hockey_value").alias("projected_next_season_hockey_value"),
        "cap_hit_cents",
    )


# --- seasons ------------------------------------------------------------------------


def latest_started(day: date) -> int:
    return day.year - (1 if day.month < 7 else 0)


def visible_seasons(seasons: DataFrame, as_of: date) -> DataFrame:
    return seasons.filter(F.col("start_year") <= latest_started(as_of)).select(
        "start_year", "end_year", "label", "salary_cap_cents"
    )


def current_season(seasons: DataFrame, as_of: date) -> int:
    found = visible_seasons(seasons, as_of).agg(F.max("start_year")).first()[0]
    if found is None:
        raise RequestError("no season has started")
    return found


def require_season(seasons: DataFrame, season: int, as_of: date) -> None:
    if visible_seasons(seasons, as_of).filter(F.col("start_year") == season).isEmpty():
        raise RequestError(f"season {season} is not available")


def season_catalog(seasons: DataFrame, as_of: date) -> DataFrame:
    """Visible seasons with their caps and which one is current."""
    visible = visible_seasons(seasons, as_of)
    newest = visible.agg(F.max("start_year")).scalar()
    return visible.withColumn("is_current", F.col("start_year") == newest).orderBy("start_year")


# --- player list ---------------------------------------------------------------------


@dataclass(frozen=True)
class PlayerQuery:
    season: int | None = None
    team: str | None = None
    position: str | None = None
    roster_status: str | None = None
    search: str | None = None
    sort: str = "name"
    order: str = "asc"
    page: int = 1
    page_size: int = 25


def is_visible() -> Column:
    return (
        F.col("games_played").isNotNull()
        | F.col("team_id").isNotNull()
        | F.col("cap_hit_cents").isNotNull()
    )


def name_like(text: Column, query: str) -> Column:
    """Case-insensitive substring match; % and _ in the query act as wildcards."""
    return text.ilike(f"%{query.strip()}%")


def same_text(column: str, value: str) -> Column:
    return F.upper(column) == F.upper(F.lit(value))


def filtered(summary: DataFrame, query: PlayerQuery) -> DataFrame:
    rows = summary.filter(is_visible())
    if query.season is not None:
        rows = rows.filter(F.col("season") == query.season)
    if query.team is not None:
        rows = rows.filter(same_text("abbreviation", query.team))
    if query.position is not None:
        rows = rows.filter(F.col("primary_position") == query.position)
    if query.roster_status is not None:
        rows = rows.filter(F.col("roster_status") == query.roster_status)
    if query.search:
        rows = rows.filter(name_like(F.col("full_name"), query.search))
    return rows


def sort_order(sort: str, order: str, tie: str = "id") -> list[Column]:
    """Whitelisted sort key, nulls last in both directions, id as tie break."""
    if sort not in SORT_COLUMNS or order not in ("asc", "desc"):
        raise RequestError(f"cannot sort by {sort!r} {order!r}")
    column = F.col(SORT_COLUMNS[sort])
    directed = column.asc_nulls_last() if order == "asc" else column.desc_nulls_last()
    return [directed, F.col(tie).asc()]


def list_players(summary: DataFrame, query: PlayerQuery) -> tuple[DataFrame, DataFrame]:
    """(page rows, one pagination row)."""
    if query.page < 1 or not 1 <= query.page_size <= ROSTER_LIMIT:
        raise RequestError("page must be positive and the page size within 1..100")
    rows = filtered(summary, query)
    page = (
        rows.orderBy(*sort_order(query.sort, query.order))
        .offset((query.page - 1) * query.page_size)
        .limit(query.page_size)
    )
    return list_rows(page), pagination(rows, query.page, query.page_size)


def pagination(rows: DataFrame, page: int, page_size: int) -> DataFrame:
    counted = rows.agg(F.count(F.lit(1)).alias("total_items"))
    return counted.select(
        F.lit(page).alias("page"),
        F.lit(page_size).alias("page_size"),
        "total_items",
        F.ceil(F.col("total_items") / page_size).alias("total_pages"),
    )


def value_leaders(
    summary: DataFrame, season: int, limit: int, position: str | None = None, team: str | None = None
) -> DataFrame:
    rows = summary.filter((F.col("season") == season) & F.col("hockey_value").isNotNull())
    if position is not None:
        rows = rows.filter(F.col("primary_position") == position)
    if team is not None:
        rows = rows.filter(same_text("abbreviation", team))
    return list_rows(rows.orderBy(F.col("hockey_value").desc_nulls_last(), "id").limit(limit))


# --- one player, any number of players -------------------------------------------------


def _club(teams: DataFrame) -> DataFrame:
    return teams.select(
        F.col("id").alias("team_id"),
        "nhl_team_id",
        "abbreviation",
        F.col("name").alias("team_name"),
        F.col("city").alias("team_city"),
        F.col("active").alias("team_active"),
    )


def player_identities(
    tables: Mapping[str, DataFrame], ids: Sequence[int] | None = None
) -> DataFrame:
    """Identity with the latest team, for all players or the given ids."""
    players, stints = tables["players"], tables["player_team_stints"]
    if ids is not None:
        players = players.filter(F.col("id").isin(list(ids)))
        stints = stints.filter(F.col("player_id").isin(list(ids)))
    latest = latest_team(stints).withColumnRenamed("player_id", "id")
    return (
        players.join(latest, "id", "left")
        .join(_club(tables["teams"]), "team_id", "left")
        .withColumn("full_name", display_name(F.col("first_name"), F.col("last_name")))
        .withColumn("age", whole_years(F.col("birth_date"), F.current_date()))
        .select(*IDENTITY_COLUMNS, team_struct().alias("team"))
    )


def player_stats(summary: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Stat bundle per summary row: traditional, advanced and goalie structs, null where absent."""
    goalies = goalie_lines(
        tables["goalie_season_stats"], tables["goalie_advanced_season_stats"]
    ).select(
        F.col("player_id").alias("id"),
        F.col("season_start_year").alias("season"),
        F.when(
            F.col("games_played").isNotNull(),
            F.struct(
                "games_played",
                "wins",
                "losses",
                "overtime_losses",
                "shots_against",
                "saves",
                "save_percentage",
                F.col("gaa").alias("goals_against_average"),
                "shutouts",
                "time_on_ice_seconds",
                F.col("xga").alias("expected_goals_against"),
                F.col("gsae").alias("goals_saved_above_expected"),
            ),
        ).alias("_goalie"),
    )
    skater = F.coalesce("primary_position", F.lit("")) != "G"
    traditional = F.struct(
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
        "shooting_percentage",
    )
    advanced = F.struct(
        F.lit("all").alias("situation"),
        F.bround("ice_time_seconds").cast("bigint").alias("ice_time_seconds"),
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
    )
    return summary.join(goalies, ["id", "season"], "left").select(
        F.col("id").alias("player_id"),
        "season",
        team_struct().alias("team"),
        F.when(skater & F.col("games_played").isNotNull(), traditional).alias("traditional"),
        F.when(skater & F.col("ice_time_seconds").isNotNull(), advanced).alias("advanced"),
        F.when(F.col("primary_position") == "G", F.col("_goalie")).alias("goalie"),
    )


def value_records(summary: DataFrame) -> DataFrame:
    return summary.select(
        F.col("id").alias("player_id"),
        "season",
        "hockey_value",
        F.col("projected_hockey_value").alias("projected_next_season_hockey_value"),
        F.col("gs60_above_replacement").alias("game_score_per_60_above_replacement"),
        (F.col("ice_time_seconds") / 3600.0).alias("toi_hours"),
        "model_version",
    )


def career(summary: DataFrame, tables: Mapping[str, DataFrame], limit: int = CAREER_LIMIT) -> DataFrame:
    """Seasons with a stat line per player, newest first, at most 40: all players in one job."""
    played = stat_seasons(tables["skater_season_stats"], tables["goalie_season_stats"])
    newest = top_per_key(played, ["player_id"], [F.col("season_start_year").desc()], limit)
    keys = newest.select(F.col("player_id").alias("id"), F.col("season_start_year").alias("season"))
    return summary.join(keys, ["id", "season"]).select(
        F.col("id").alias("player_id"),
        "season",
        team_struct().alias("team"),
        "games_played",
        "goals",
        "assists",
        "points",
        "game_score_per_60",
        "hockey_value",
    )


def value_history(summary: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    return career(summary, tables).select("player_id", "season", "hockey_value")


def comparison_ids(text: str) -> list[int]:
    """2 to 4 distinct positive ids of a comma list."""
    try:
        ids = [int(v.strip()) for v in text.split(",") if v.strip()]
    except ValueError:
        raise RequestError("comparison ids must be integers") from None
    if not 2 <= len(ids) <= 4 or min(ids) <= 0 or len(set(ids)) != len(ids):
        raise RequestError("compare two to four distinct positive ids")
    return ids


def compare(
    summary: DataFrame, tables: Mapping[str, DataFrame], ids: Sequence[int], season: int
) -> DataFrame:
    """Identity, stats, value and contract of 2–4 players, in the order asked for."""
    wanted = [int(i) for i in comparison_ids(",".join(map(str, ids)))]
    place = F.array_position(F.array(*[F.lit(i) for i in wanted]), F.col("player_id"))
    rows = summary.filter(F.col("id").isin(wanted) & (F.col("season") == season))
    stats = player_stats(rows, tables).drop("season")
    value = value_records(rows).select("player_id", F.struct("*").alias("value"))
    deals = C.player_contracts(tables, season, wanted)
    who = player_identities(tables, wanted).select(F.col("id").alias("player_id"), F.struct("*").alias("player"))
    return (
        who.join(stats, "player_id", "left")
        .join(value, "player_id", "left")
        .join(deals.select("player_id", F.struct("*").alias("contract")), "player_id", "left")
        .withColumn("place", place)
        .orderBy("place")
    )


# --- teams ------------------------------------------------------------------------------


def team_directory(teams: DataFrame) -> DataFrame:
    return teams.filter("active").select(
        "id", "nhl_team_id", "abbreviation", "name", "city", "active"
    ).orderBy("name", "id")


def roster_counts(players: DataFrame, stints: DataFrame) -> DataFrame:
    """Players per team and roster status; every status has a column, 0 when none."""
    latest = latest_team(stints, by_join_date=False)
    status = players.select(F.col("id").alias("player_id"), "roster_status")
    counted = latest.join(status, "player_id").groupBy("team_id")
    return counted.agg(*[F.count_if(F.col("roster_status") == s).alias(s) for s in ROSTER_STATUSES])


def team_details(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Teams with their roster counts (zeros for a team without players)."""
    counts = roster_counts(tables["players"], tables["player_team_stints"])
    columns = ["id", "nhl_team_id", "abbreviation", "name", "city", F.col("active").alias("is_active")]
    return (
        tables["teams"]
        .select(*columns)
        .join(counts.withColumnRenamed("team_id", "id"), "id", "left")
        .fillna(0, ROSTER_STATUSES)
    )


def team_roster(summary: DataFrame, season: int, team_id: int, status: str | None = None) -> DataFrame:
    rows = summary.filter((F.col("season") == season) & (F.col("team_id") == team_id))
    if status is not None:
        rows = rows.filter(F.col("roster_status") == status)
    return list_rows(rows.orderBy("full_name", "id").limit(ROSTER_LIMIT))


def all_rosters(summary: DataFrame) -> DataFrame:
    """Every team's roster of every season in one job: at most 100 players by name."""
    ranked = top_per_key(
        summary.filter("team_id is not null"),
        ["season", "team_id"],
        [F.col("full_name"), F.col("id")],
        ROSTER_LIMIT,
        "place",
    )
    return ranked.select("season", "team_id", "place", "id", "full_name", "roster_status")


# --- search and overview -------------------------------------------------------------------


def search_players(tables: Mapping[str, DataFrame], query: str, limit: int) -> DataFrame:
    """Matching players, active first, with their latest team."""
    full = display_name(F.col("first_name"), F.col("last_name"))
    found = tables["players"].filter(name_like(full, query))
    order = [F.col("active").desc(), F.col("last_name"), F.col("first_name"), F.col("id")]
    top = found.orderBy(*order).limit(limit)
    keyed = top.select(F.col("id").alias("player_id"))
    stints = tables["player_team_stints"].join(keyed, "player_id", "left_semi")
    return player_identities({**tables, "players": top, "player_team_stints": stints}).orderBy(*order)


def search_teams(teams: DataFrame, query: str, limit: int) -> DataFrame:
    text = F.concat_ws(" ", "city", "name", "abbreviation")
    return (
        teams.filter(name_like(text, query))
        .select("id", "nhl_team_id", "abbreviation", "name", "city", "active")
        .orderBy(F.col("active").desc(), "name", "id")
        .limit(limit)
    )


def league_totals(summary: DataFrame) -> DataFrame:
    """Per season, over players with games: players, skater goals, games, mean value."""
    skater = F.coalesce("primary_position", F.lit("")) != "G"
    return (
        summary.filter("games_played is not null")
        .groupBy("season")
        .agg(
            F.count(F.lit(1)).alias("players"),
            F.coalesce(F.sum(F.when(skater, F.col("goals"))), F.lit(0)).alias("goals"),
            F.sum("games_played").alias("games_played"),
            F.avg(F.when(skater, F.col("hockey_value"))).alias("average_hockey_value"),
        )
    )


LEADER_METRICS = ["hockey_value", "points", "goals", "game_score_per_60"]


def league_leaders(summary: DataFrame, per_metric: int = LEADERS) -> DataFrame:
    """Top five skaters per season and metric; nulls never rank, ties go to the lower id."""
    skaters = summary.filter(
        F.col("games_played").isNotNull() & (F.coalesce("primary_position", F.lit("")) != "G")
    )
    cells = [
        F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value"))
        for m in LEADER_METRICS
    ]
    tall = skaters.select("season", "id", F.inline(F.array(*cells))).filter("value is not null")
    order = [F.col("value").desc(), F.col("id")]
    return top_per_key(tall, ["season", "metric"], order, per_metric, "place")
