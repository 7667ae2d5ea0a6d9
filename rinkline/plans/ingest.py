"""End-to-end loads: saved feeds to checked rows, resolved players and merge plans.

A load is refused before any write when a check fails, and returns plans;
``apply_merge`` writes them.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkline import schemas
from rinkline.functions import text as X
from rinkline.functions.dates import season_label
from rinkline.functions.numbers import parse_strict_integer
from rinkline.operators import merge as M
from rinkline.operators import quality as Q
from rinkline.operators.keyed import first_per_key
from rinkline.plans import contracts as C
from rinkline.plans import identity as I
from rinkline.plans.roster import final_teams
from rinkline.session import staged
from rinkline.sources import feeds

ADVANCED_REQUIRED = ["playerId", "season", "name", "situation", "games_played", "icetime"]
ADVANCED_GRAIN = ["playerId", "season", "team", "situation"]
ADVANCED_INTEGERS = ["playerId", "season", "games_played"]
DUPLICATE_CEILING = 0.01
ADVANCED_SOURCE_ID, BASIC_SOURCE_ID, ACTIVE_SOURCE_ID = 2, 1, 3


class Load(NamedTuple):
    """Merge plans by table, and the counts row of the load."""

    plans: dict[str, DataFrame]
    counts: DataFrame


# --- rows -------------------------------------------------------------------------------


def advanced_stat_rows(raw: DataFrame, kind: str) -> DataFrame:
    """Text rows of the advanced feed to typed rows with long tail and row hash."""
    fields = [c for c in raw.columns if not c.startswith("_")]
    value = feeds.text_value(raw)
    carried = ["_ord"] if "_ord" in raw.columns else []
    return raw.select(
        *carried,
        parse_strict_integer(F.col("playerId")).cast("string").alias("external_id"),
        parse_strict_integer(F.col("season")).cast("int").alias("season"),
        "name",
        X.normalize_position(value("position"), kind == "goalie").alias("position"),
        X.team_abbreviation(value("team")).alias("team"),
        F.lit(2).alias("game_type"),
        F.left("situation", F.lit(24)).alias("situation"),
        *feeds.metric_columns(schemas.layout(kind, True), value),
        feeds.long_tail(raw, fields).alias("extra_metrics"),
        X.row_hash(raw.schema, *fields).alias("source_row_hash"),
    )


def basic_stat_rows(rows: DataFrame, kind: str) -> DataFrame:
    """Player lines of saved stat pages (``row`` maps) to typed rows."""
    row = F.col("row")
    value = feeds.map_value(row)
    return rows.select(
        *[c for c in rows.columns if c != "row"],
        parse_strict_integer(value("playerId")).cast("string").alias("external_id"),
        feeds.stat_name(row).alias("name"),
        X.normalize_position(value("positionCode"), kind == "goalie").alias("position"),
        value("shootsCatches").alias("shoots_catches"),
        X.team_list(value("teamAbbrevs")).alias("teams"),
        *feeds.metric_columns(schemas.layout(kind, False), value),
        F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(row)))), 256).alias("source_row_hash"),
    )


def with_scope(rows: DataFrame) -> DataFrame:
    """TEAM for exactly one known team, else TOTAL without a team."""
    if "teams" in rows.columns:
        rows = rows.withColumn("team_id", F.when(F.size("teams") == 1, F.col("team_id")))
    return rows.withColumn("stat_scope", F.when(F.col("team_id").isNotNull(), "TEAM").otherwise("TOTAL"))


def missing_season_rows(years: DataFrame, seasons: DataFrame) -> DataFrame:
    """Season rows (without a cap) for years the season table lacks."""
    year = F.col("start_year")
    rows = years.select(year, (year + 1).alias("end_year"), season_label(year).alias("label")).distinct()
    return schemas.conform(M.insert_absent(seasons, rows, ["start_year"]), "seasons")


def _stat_plan(tables: Mapping[str, DataFrame], rows: DataFrame, kind: str, advanced: bool, source_id: int) -> DataFrame:
    grain = M.stat_grain(advanced)
    table = schemas.stat_table(kind, advanced)
    keyed = rows.withColumn("source_id", F.lit(source_id).cast("bigint")).withColumn("updated_at", F.current_timestamp())
    one = M.last_per_grain(keyed, grain)
    stored = M.touched(tables[table], one.select("season_start_year"), "season_start_year")
    return M.merge_stats(stored, one, kind, advanced)


def _teams_named(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.col(column).alias("abbreviation")).filter("abbreviation is not null").distinct()


def _next(df: DataFrame, column: str = "id") -> int:
    return (df.agg(F.max(column)).first()[0] or 0) + 1


def _with_team_ids(rows: DataFrame, teams: DataFrame, column: str) -> DataFrame:
    ids = teams.select(F.col("abbreviation").alias(column), F.col("id").alias("team_id"))
    return rows.join(ids, column, "left")


# --- advanced feed -------------------------------------------------------------------------


def load_advanced_stats(
    tables: Mapping[str, DataFrame],
    feeds_by_kind: Mapping[str, DataFrame],
    expected_seasons: Sequence[int] = (),
    minimum_rows: int = 1,
    duplicate_ceiling: float = DUPLICATE_CEILING,
) -> Load:
    """Historical plus current files of each kind (stacked, with ``_ord``): check, resolve, plan."""
    typed = {}
    for kind, raw in feeds_by_kind.items():
        Q.assert_columns(raw, ADVANCED_REQUIRED)
        Q.assert_not_empty(raw, f"advanced {kind}")
        Q.assert_none(Q.row_violations(raw, ADVANCED_REQUIRED, ADVANCED_INTEGERS, ["icetime"]), f"advanced {kind}")
        Q.assert_none(Q.missing_seasons(raw, expected_seasons), f"advanced {kind} season")
        raw = raw if "team" in raw.columns else raw.withColumn("team", F.lit(None).cast("string"))
        Q.assert_quality(Q.quality_report(raw, ADVANCED_GRAIN, ADVANCED_INTEGERS), minimum_rows, duplicate_ceiling)
        valid = Q.last_by_grain(raw, ADVANCED_GRAIN, ADVANCED_INTEGERS)
        Q.assert_none(Q.typed_violations(valid, "advanced"), f"advanced {kind} value")
        typed[kind] = staged(advanced_stat_rows(valid, kind), f"advanced-{kind}")
    profiles = None
    for place, kind in enumerate(sorted(typed, reverse=True)):  # skaters before goalies
        part = typed[kind].select("external_id", "season", "name", "position", "team", F.struct(F.lit(place).alias("k"), "_ord").alias("_ord"))
        profiles = part if profiles is None else profiles.unionByName(part)
    people = I.latest_profiles(profiles).select("external_id", "name", "position")
    team_plan = I.upsert_teams(tables["teams"], _teams_named(profiles, "team"), _next(tables["teams"]))
    found = I.upsert_players(tables["players"], tables["player_external_ids"], people, ADVANCED_SOURCE_ID, _next(tables["players"]))
    teams, ids = staged(team_plan, "teams"), staged(found.ids, "ids")
    plans = {"teams": teams, "players": found.players, "player_external_ids": found.bridge}
    for kind, rows in typed.items():
        resolved = _with_team_ids(rows.join(ids.select("external_id", "player_id"), "external_id"), teams, "team")
        scoped = with_scope(resolved.withColumnRenamed("season", "season_start_year"))
        plans[schemas.stat_table(kind, True)] = _stat_plan(tables, scoped, kind, True, ADVANCED_SOURCE_ID)
    return Load(plans, _counts([plans[schemas.stat_table(k, True)] for k in typed]))


def _counts(plans: Sequence[DataFrame]) -> DataFrame:
    """Created and updated rows over several plans."""
    stacked = None
    for plan in plans:
        row = M.merge_counts(plan)
        stacked = row if stacked is None else stacked.unionByName(row)
    return stacked.agg(F.sum("records_created").alias("records_created"), F.sum("records_updated").alias("records_updated"))


# --- basic feed ------------------------------------------------------------------------------


def load_basic_stats(tables: Mapping[str, DataFrame], payloads: DataFrame, page_limit: int = 100) -> Load:
    """Saved stat pages (kind, season, game_type, page, body): completeness, invariants, plans."""
    job = ["kind", "season", "game_type"]
    Q.assert_none(Q.page_problems(feeds.stats_pages(payloads), job, page_limit), "stat pages")
    rows = feeds.stats_rows(payloads).withColumn("_ord", F.struct(*job, "page", "row_no"))
    typed = {}
    for kind in ("skater", "goalie"):
        lines = rows.filter(F.col("kind") == kind)
        fields = [c for c in Q.TYPED_CHECKS[kind]]
        flat = lines.select("*", *[F.try_element_at("row", F.lit(c)).alias(c) for c in fields])
        Q.assert_none(Q.typed_violations(flat, kind).select("season", "bad_fields"), f"basic {kind}")
        Q.assert_none(Q.stat_violations(flat, kind).select("season", *fields), f"basic {kind} totals")
        typed[kind] = staged(basic_stat_rows(lines, kind), f"basic-{kind}")
    shared = ["external_id", "season", "game_type", "name", "position", "shoots_catches", "teams", "_ord"]
    everyone = typed["skater"].select(*shared).unionByName(typed["goalie"].select(*shared))
    people = I.first_profiles(everyone).select("external_id", "name", "position", "shoots_catches")
    named = everyone.select(F.explode("teams").alias("abbreviation")).distinct()
    teams = staged(I.upsert_teams(tables["teams"], named, _next(tables["teams"])), "teams")
    found = I.upsert_players(
        tables["players"], tables["player_external_ids"], people, BASIC_SOURCE_ID, _next(tables["players"]), sister=ADVANCED_SOURCE_ID
    )
    ids = staged(found.ids, "ids").select("external_id", "player_id")
    plans = {"teams": teams, "players": found.players, "player_external_ids": found.bridge}
    for kind, lines in typed.items():
        first_team = lines.join(ids, "external_id").withColumn("team", F.get("teams", F.lit(0)))
        scoped = with_scope(_with_team_ids(first_team, teams, "team").withColumnRenamed("season", "season_start_year"))
        plans[schemas.stat_table(kind, False)] = _stat_plan(tables, scoped, kind, False, BASIC_SOURCE_ID)
    last = _with_team_ids(final_teams(everyone.join(ids, "external_id")), teams, "team")
    stints = last.select("player_id", "season_start_year", "team_id", F.lit(None).cast("date").alias("joined_on"))
    plans["player_team_stints"] = M.insert_absent(tables["player_team_stints"], stints, ["player_id", "season_start_year", "team_id", "joined_on"])
    return Load(plans, _counts([plans[schemas.stat_table(k, False)] for k in typed]))


# --- rosters and schedule -----------------------------------------------------------------------


def load_rosters(
    tables: Mapping[str, DataFrame],
    standings: DataFrame,
    rosters: DataFrame,
    season: int,
    minimum_teams: int = Q.FLOORS["teams"],
    minimum_players: int = Q.FLOORS["active_players"],
) -> Load:
    clubs = feeds.standings_teams(standings)
    Q.assert_min_rows(clubs, minimum_teams, "roster teams")
    Q.assert_none(feeds.feed_errors(clubs.withColumnRenamed("abbreviation", "team"), rosters, feeds.roster_failed(rosters), "team", "roster feed"), "roster feed")
    people = staged(feeds.roster_players(rosters), "roster")
    Q.assert_min_rows(people, minimum_players, "roster players")
    teams = staged(I.upsert_teams(tables["teams"], clubs, _next(tables["teams"])), "teams")
    one = first_per_key(people, ["external_id"], [F.col("team").desc(), F.col("row_no").desc()])
    found = I.resolve_roster_players(
        tables["players"], tables["player_external_ids"], one, BASIC_SOURCE_ID, ADVANCED_SOURCE_ID, _next(tables["players"])
    )
    listed = people.join(found.ids.select("external_id", "player_id"), "external_id")
    stints = _with_team_ids(listed, teams, "team").select(
        "player_id", F.lit(season).alias("season_start_year"), "team_id",
        F.lit(None).cast("date").alias("joined_on"), F.lit("ACTIVE").alias("roster_status"),
    )
    key = ["player_id", "season_start_year", "team_id", "joined_on"]
    years = tables["seasons"].sparkSession.createDataFrame([(season,)], "start_year int")
    plans = {
        "seasons": missing_season_rows(years, tables["seasons"]),
        "teams": teams,
        "players": found.players,
        "player_external_ids": found.bridge,
        "player_team_stints": M.insert_absent(tables["player_team_stints"], stints, key),
    }
    counts = clubs.agg(F.count(F.lit(1)).alias("teams")).select("teams", people.agg(F.count(F.lit(1))).scalar().alias("active_players"))
    return Load(plans, counts)


def load_schedule(
    tables: Mapping[str, DataFrame], payloads: DataFrame, season: int, minimum_games: int = Q.FLOORS["games"]
) -> Load:
    games = staged(feeds.schedule_games(payloads), "schedule")
    Q.assert_min_rows(games, minimum_games, "schedule games")
    named = games.select(F.explode(F.array("away_team", "home_team")).alias("abbreviation")).filter("abbreviation is not null").distinct()
    teams = staged(I.upsert_teams(tables["teams"], named, _next(tables["teams"])), "teams")
    ids = teams.select("abbreviation", "id")
    rows = games.join(ids.toDF("away_team", "away_team_id"), "away_team").join(ids.toDF("home_team", "home_team_id"), "home_team")
    rows = rows.withColumns({"season_start_year": F.lit(season), "game_type": F.lit(2), "last_synced_at": F.current_timestamp()})
    plan = M.merge_schedule(tables["games"], rows)
    return Load({"teams": teams, "games": plan}, M.merge_counts(plan))


# --- contracts --------------------------------------------------------------------------------------


def refresh_active(
    tables: Mapping[str, DataFrame], people: DataFrame, parsed: DataFrame, violations: DataFrame, source_id: int = ACTIVE_SOURCE_ID
) -> tuple[tuple[DataFrame, DataFrame] | None, dict[str, int]]:
    """The active snapshot's plans and counts; a refused feed gives no plans and the counts of the last good snapshot.

    Without a last good one a refused feed is an error.
    """
    if not violations.isEmpty():
        return None, C.cached_summary(tables, source_id)
    _, contract_plan, season_plan = load_active(tables, people, parsed, source_id)
    counted = M.merge_counts(contract_plan).first()
    return (contract_plan, season_plan), {"contracts": counted["records_created"] + counted["records_updated"]}


def history_seasons(
    tables: Mapping[str, DataFrame],
    parsed: DataFrame,
    candidates: DataFrame,
    source_code: str,
    source_id: int,
    first: int = C.FIRST_SEASON,
    last: int = C.LAST_SEASON,
) -> DataFrame:
    """Parsed page seasons (with player_id, nhl_id) with ids, in scope of the candidates, teams resolved; stored."""
    rows = C.synthetic_ids(parsed, source_code)
    scoped = C.scoped_seasons(rows, tables["seasons"], candidates, first, last)
    lookup = I.team_lookup(tables["teams"])
    signed = I.resolve_teams(scoped, lookup, "signing_team", "signing_team_id")
    owned = I.resolve_teams(signed, lookup, "owning_team", "owning_team_id", tables["player_team_stints"])
    return staged(owned.withColumn("source_id", F.lit(source_id).cast("bigint")), "history")


def load_active(
    tables: Mapping[str, DataFrame], people: DataFrame, parsed: DataFrame, source_id: int = ACTIVE_SOURCE_ID
) -> tuple[I.Resolved, DataFrame, DataFrame]:
    """Active index players and their parsed page seasons (by slug) to resolved players and plans."""
    Q.assert_none(Q.sequence_violations(parsed, ["slug", "contract_no"], "season_start_year"), "contract seasons")
    profiles = people.select(
        "slug", "name", X.normalize_position(F.col("position")).alias("position"),
        X.normalize_nationality(F.col("nationality")).alias("nationality"), "birth_date", "_ord",
    )
    found = I.resolve_by_name(tables["players"], tables["player_external_ids"], profiles, source_id, _next(tables["players"]))
    ids = staged(found.ids, "ids").select(F.col("external_id").alias("slug"), "player_id")
    lookup = tables["teams"].select(F.col("abbreviation"), F.col("id"))
    caps = tables["seasons"].select(F.col("start_year").alias("season_start_year"), "salary_cap_cents")
    rows = (
        parsed.join(ids, "slug")
        .join(people.select("slug", F.col("team").alias("_team")), "slug")
        .join(lookup.toDF("_team", "owning_team_id"), "_team", "left")
        .withColumn("_signing", F.upper(F.coalesce("signing_team", "_team")))
        .join(lookup.toDF("_signing", "signing_team_id"), "_signing", "left")
        .join(caps, "season_start_year", "left")
        .withColumn("source_id", F.lit(source_id).cast("bigint"))
    )
    ready = staged(rows, "active")
    contract_plan, season_plan = C.plan_active(ready, tables["contracts"], tables["contract_seasons"], _next(tables["contracts"]))
    return found, contract_plan, season_plan
