"""Roster status from feeds, minor-league identity matching and team stints."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinkline.functions import text as X
from rinkline.operators.keyed import active_on, coverage_gap, first_per_key, only_if_single
from rinkline.operators.merge import insert_absent
from rinkline.operators.quality import assert_none, check_ordered
from rinkline.plans.stats import PLAYER_SEASON, season_range
from rinkline.schemas import ROSTER_STATUSES

MAJOR, MINOR = "nhl", "ahl"
BASIC_SOURCE, ADVANCED_SOURCE = "nhl", "moneypuck"


def stored_roster(players: DataFrame, bridge: DataFrame, sources: DataFrame) -> DataFrame:
    """Players with their major and minor league ids (the highest one of each)."""
    code = sources.filter(F.col("code").isin(MAJOR, MINOR)).select(F.col("id").alias("source_id"), "code")
    ids = (
        bridge.join(F.broadcast(code), "source_id")  # two rows
        .groupBy(F.col("player_id").alias("id"))
        .agg(
            F.max(F.when(F.col("code") == MAJOR, F.col("external_id"))).alias("nhl_external_id"),
            F.max(F.when(F.col("code") == MINOR, F.col("external_id"))).alias("ahl_external_id"),
        )
    )
    return players.join(ids, "id", "left").select(
        "id",
        F.trim(F.concat_ws(" ", "first_name", "last_name")).alias("full_name"),
        "birth_date",
        "roster_status",
        "nhl_external_id",
        "ahl_external_id",
    )


def consistent_profiles(feed: DataFrame) -> DataFrame:
    """Feed players whose external id always stands for one (name, birth date).

    Conflicting ids are dropped whole; of the others the last sighting stays.
    """
    named = feed.withColumn("name_key", X.identity_name(F.col("full_name")))
    identity = F.struct("name_key", "birth_date")
    spread = named.groupBy("external_id").agg(
        F.min(identity).alias("_low"), F.max(identity).alias("_high")
    )
    agreed = spread.filter(F.col("_low").eqNullSafe(F.col("_high"))).select("external_id")
    last = first_per_key(named, ["external_id"], [F.col("_ord").desc()])
    return last.join(agreed, "external_id", "left_semi")


def conflicting_ids(feed: DataFrame) -> DataFrame:
    return feed.select("external_id").distinct().join(
        consistent_profiles(feed).select("external_id"), "external_id", "left_anti"
    )


def match_minor_players(roster: DataFrame, feed: DataFrame) -> DataFrame:
    """(id, external_id, full_name) of stored players found in the minor-league feed.

    First by an external id that exactly one stored player holds; the rest by
    a (name, birth date) that is unique on both sides and whose external id
    is not taken yet. Ambiguity matches nobody.
    """
    known = consistent_profiles(feed)
    held = only_if_single(roster.filter("ahl_external_id is not null"), ["ahl_external_id"], ["id"])
    by_id = held.withColumnRenamed("ahl_external_id", "external_id").join(
        known.select("external_id", "full_name"), "external_id"
    ).select("id", "external_id", "full_name")
    key = ["name_key", "birth_date"]
    open_rows = roster.filter("birth_date is not null").join(by_id.select("id"), "id", "left_anti")
    ours = only_if_single(open_rows.withColumn("name_key", X.identity_name(F.col("full_name"))), key, ["id"])
    theirs = only_if_single(known.filter("birth_date is not null"), key, ["external_id", "full_name"])
    by_name = ours.join(theirs, key).join(by_id.select("external_id"), "external_id", "left_anti")
    return by_id.unionByName(by_name.select("id", "external_id", "full_name"))


def on_ltir(overrides: DataFrame, as_of: date | Column) -> DataFrame:
    """Distinct players with an override that holds the date."""
    day = F.lit(as_of) if isinstance(as_of, date) else as_of
    return active_on(overrides, day, "start_date", "end_date").select("player_id").distinct()


def status_of(ltir: Column, major: Column, minor: Column, has_id: Column, major_complete: bool, minor_complete: bool) -> Column:
    """Status by precedence; null keeps the stored one."""
    return (
        F.when(ltir, "LTIR")
        .when(major, "ACTIVE")
        .when(minor & F.lit(major_complete), "MINORS")
        .when(has_id & F.lit(major_complete and minor_complete), "UNKNOWN")
    )


def classify(
    roster: DataFrame,
    ltir: DataFrame,
    major_feed: DataFrame,
    minor_matches: DataFrame,
    major_complete: bool = True,
    minor_complete: bool = True,
) -> DataFrame:
    """(id, roster_status, new_status) for every stored player."""
    flags = (
        roster.join(ltir.select(F.col("player_id").alias("id"), F.lit(True).alias("_ltir")).distinct(), "id", "left")
        .join(
            major_feed.select(F.col("external_id").alias("nhl_external_id"), F.lit(True).alias("_major")).distinct(),
            "nhl_external_id",
            "left",
        )
        .join(minor_matches.select("id", F.lit(True).alias("_minor")).distinct(), "id", "left")
    )
    set_flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    status = status_of(
        set_flag("_ltir"), set_flag("_major"), set_flag("_minor"),
        F.col("nhl_external_id").isNotNull(), major_complete, minor_complete,
    )
    return flags.select("id", "roster_status", status.alias("new_status"))


def sync_summary(decisions: DataFrame) -> DataFrame:
    """One row: players per new status, updated and preserved."""
    return decisions.agg(
        F.count("new_status").alias("updated"),
        *[F.count_if(F.col("new_status") == s).alias(s.lower()) for s in ROSTER_STATUSES],
        F.count_if(F.col("new_status").isNull()).alias("preserved"),
    )


def apply_statuses(players: DataFrame, decisions: DataFrame, at: Column | None = None) -> DataFrame:
    """Players with their new statuses; a null decision keeps status and time."""
    new = decisions.select("id", "new_status")
    changed = F.col("new_status").isNotNull()
    when = F.current_timestamp() if at is None else at
    return (
        players.join(new, "id", "left")
        .withColumn("roster_status", F.coalesce("new_status", "roster_status"))
        .withColumn("roster_status_updated_at", F.when(changed, when).otherwise(F.col("roster_status_updated_at")))
        .select(*players.columns)
    )


def sync_statuses(
    tables: Mapping[str, DataFrame],
    major_feed: DataFrame,
    minor_feed: DataFrame,
    as_of: date,
    errors: DataFrame,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(players, new bridge rows, summary); refuses to write when a feed is incomplete."""
    assert_none(errors, "roster feed incomplete")
    sources = tables["data_sources"]
    roster = stored_roster(tables["players"], tables["player_external_ids"], sources)
    matches = match_minor_players(roster, minor_feed)
    decisions = classify(roster, on_ltir(tables["ltir_overrides"], as_of), major_feed, matches)
    minor_id = sources.filter(F.col("code") == MINOR).agg(F.max("id")).scalar()
    links = matches.select(
        F.col("id").alias("player_id"), minor_id.alias("source_id"), "external_id",
        F.col("full_name").alias("source_name"),
    )
    fresh = insert_absent(tables["player_external_ids"], links, ["source_id", "external_id"])
    return apply_statuses(tables["players"], decisions), fresh, sync_summary(decisions)


# --- team stints --------------------------------------------------------------------------


def stint_candidates(
    tables: Mapping[str, DataFrame], first: int | None = None, last: int | None = None
) -> DataFrame:
    """Team rows of the four stat tables; the basic feed goes before the advanced one."""
    check_ordered(first, last)
    codes = tables["data_sources"].select(F.col("id").alias("source_id"), "code")
    feeds = [
        ("skater_season_stats", BASIC_SOURCE, 0, "game_type = 2"),
        ("goalie_season_stats", BASIC_SOURCE, 0, "game_type = 2"),
        ("skater_advanced_season_stats", ADVANCED_SOURCE, 1, "situation = 'all'"),
        ("goalie_advanced_season_stats", ADVANCED_SOURCE, 1, "situation = 'all'"),
    ]
    stacked = None
    for table, code, priority, rule in feeds:
        source = F.broadcast(codes.filter(F.col("code") == code))  # one row
        rows = (
            season_range(tables[table], first, last)
            .filter(f"{rule} and stat_scope = 'TEAM' and team_id is not null")
            .join(source, "source_id", "left_semi")
            .select(*PLAYER_SEASON, "team_id", "games_played", F.lit(priority).alias("source_priority"))
        )
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return stacked


def canonical_teams(candidates: DataFrame) -> DataFrame:
    """One team per player-season: best feed, then most games, then lowest team id."""
    order = [F.col("source_priority"), F.col("games_played").desc_nulls_last(), F.col("team_id")]
    return first_per_key(candidates, PLAYER_SEASON, order).select(*PLAYER_SEASON, "team_id")


def missing_stints(canonical: DataFrame, stints: DataFrame) -> DataFrame:
    gap = coverage_gap(canonical, stints, PLAYER_SEASON)
    return canonical.join(gap, PLAYER_SEASON, "left_semi")


def stint_counts(canonical: DataFrame, missing: DataFrame) -> DataFrame:
    return canonical.agg(F.count(F.lit(1)).alias("canonical_assignments")).select(
        "canonical_assignments", missing.agg(F.count(F.lit(1))).scalar().alias("missing_assignments")
    )


def final_teams(rows: DataFrame) -> DataFrame:
    """Last listed team per player-season of the regular season.

    ``rows`` has player_id, season, game_type, teams (ordered list) and ``_ord``.
    """
    listed = rows.filter("game_type = 2 and size(teams) > 0")
    last = first_per_key(listed, ["player_id", "season"], [F.col("_ord").desc()])
    return last.select(
        "player_id", F.col("season").alias("season_start_year"), F.element_at("teams", -1).alias("team")
    )
