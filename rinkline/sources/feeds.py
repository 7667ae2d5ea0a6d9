"""Saved feed payloads (text) to typed rows.

Payload frames have a ``body`` column plus the columns that say what was
asked for. Bodies that do not parse keep their row with a null payload, so
``failed`` can list them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkline.functions import text as X
from rinkline.functions.dates import parse_iso_date, parse_short_birth_date
from rinkline.functions.numbers import parse_number, parse_strict_integer
from rinkline.operators.keyed import first_per_key

_CALLBACK = r"(?s)^[A-Za-z_$][\w$]*(?:\.[A-Za-z_$][\w$]*)*\s*\((.*)\)\s*;?$"


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """One row per saved file: (path, body)."""
    files = spark.read.option("wholetext", True).text(path)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


def envelope(body: Column) -> Column:
    """JSON text of a plain or callback-wrapped object, null when it is neither."""
    text = F.regexp_replace(body, r"(?U)^\s+|\s+$", "")
    inner = F.regexp_extract(text, _CALLBACK, 1)
    return F.when(text.startswith("{"), text).when(text.rlike(_CALLBACK), inner)


def localized_text(value: Column) -> Column:
    """Plain text, or the chosen entry of a JSON language map."""
    return F.when(
        value.startswith("{"), X.localized(F.from_json(value, "map<string,string>"))
    ).otherwise(value)


def parsed(payloads: DataFrame, schema: str) -> DataFrame:
    return payloads.withColumn("_p", F.from_json(envelope(F.col("body")), schema)).drop("body")


# --- season statistics ----------------------------------------------------------

_STATS_PAGE = "data array<map<string,string>>, total string"


def stats_pages(payloads: DataFrame) -> DataFrame:
    """Page facts for the completeness check: total, size and rows without an id."""
    pages = parsed(payloads, _STATS_PAGE)
    rows = F.coalesce(F.col("_p.data"), F.array().cast("array<map<string,string>>"))
    no_id = F.size(
        F.filter(rows, lambda r: F.coalesce(F.try_element_at(r, F.lit("playerId")), F.lit("")) == "")
    )
    return pages.select(
        *[c for c in pages.columns if c != "_p"],
        parse_strict_integer(F.col("_p.total")).alias("total"),
        F.size(rows).alias("size"),
        no_id.alias("no_id"),
    )


def stats_rows(payloads: DataFrame) -> DataFrame:
    """One row per player line: the payload columns, ``row`` (text map) and its place."""
    pages = parsed(payloads, _STATS_PAGE)
    keep = [c for c in pages.columns if c != "_p"]
    return pages.select(*keep, F.posexplode("_p.data").alias("row_no", "row"))


def stat_name(row: Column) -> Column:
    """Skater, goalie or last name, whichever is filled first."""
    get = lambda k: F.try_element_at(row, F.lit(k))
    return F.coalesce(
        X.first_filled(get("skaterFullName"), get("goalieFullName"), get("lastName")),
        F.lit("Unknown"),
    )


# --- rosters ---------------------------------------------------------------------


def standings_teams(payloads: DataFrame) -> DataFrame:
    """Team rows of standings payloads; the last row of an abbreviation wins."""
    rows = parsed(
        payloads, "standings array<struct<teamAbbrev string, teamName string, placeName string>>"
    ).select(F.posexplode("_p.standings").alias("_at", "t"))
    teams = rows.select(
        X.team_abbreviation(localized_text(F.col("t.teamAbbrev"))).alias("abbreviation"),
        localized_text(F.col("t.teamName")).alias("name"),
        localized_text(F.col("t.placeName")).alias("city"),
        "_at",
    ).filter(F.col("abbreviation").isNotNull())
    return first_per_key(teams, ["abbreviation"], [F.col("_at").desc()]).drop("_at")


_PERSON = (
    "array<struct<id string, firstName string, lastName string, birthDate string, "
    "positionCode string, shootsCatches string, birthCountry string>>"
)
_ROSTER = f"forwards {_PERSON}, defensemen {_PERSON}, goalies {_PERSON}"


def roster_failed(payloads: DataFrame) -> DataFrame:
    """Roster payloads that lack one of the three position lists."""
    rosters = parsed(payloads, _ROSTER)
    complete = (
        F.col("_p.forwards").isNotNull()
        & F.col("_p.defensemen").isNotNull()
        & F.col("_p.goalies").isNotNull()
    )
    return rosters.filter(~F.coalesce(complete, F.lit(False))).drop("_p")


def roster_players(payloads: DataFrame) -> DataFrame:
    """Player rows of team roster payloads (which have a ``team`` column)."""
    rosters = parsed(payloads, _ROSTER)
    tag = lambda c, goalie: F.transform(
        F.col(f"_p.{c}"), lambda p: F.struct(F.lit(goalie).alias("goalie"), p.alias("p"))
    )
    people = F.concat(tag("forwards", False), tag("defensemen", False), tag("goalies", True))
    keep = [c for c in rosters.columns if c != "_p"]
    rows = rosters.select(*keep, F.posexplode(people).alias("row_no", "r"))
    p = F.col("r.p")
    first = F.coalesce(localized_text(p["firstName"]), F.lit(""))
    last = F.coalesce(localized_text(p["lastName"]), F.lit(""))
    return rows.select(
        *keep,
        "row_no",
        parse_strict_integer(p["id"]).cast("string").alias("external_id"),
        F.trim(F.concat(first, F.lit(" "), last)).alias("name"),
        parse_iso_date(p["birthDate"]).alias("birth_date"),
        X.normalize_position(p["positionCode"], F.col("r.goalie")).alias("position"),
        p["shootsCatches"].alias("shoots_catches"),
        X.normalize_nationality(p["birthCountry"]).alias("nationality"),
        p["birthCountry"].alias("birth_country"),
    )


_MINOR_ROSTER = (
    "roster array<struct<sections array<struct<data array<struct<"
    "row struct<player_id string, name string, birthdate string>>>>>>>"
)


def minor_roster_failed(payloads: DataFrame) -> DataFrame:
    rosters = parsed(payloads, _MINOR_ROSTER)
    return rosters.filter(F.col("_p.roster").isNull()).drop("_p")


def minor_roster_players(payloads: DataFrame) -> DataFrame:
    """Player rows of minor-league roster payloads, three levels deep."""
    rosters = parsed(payloads, _MINOR_ROSTER)
    keep = [c for c in rosters.columns if c != "_p"]
    entries = F.flatten(
        F.transform(
            F.flatten(F.transform(F.col("_p.roster"), lambda g: g["sections"])),
            lambda s: s["data"],
        )
    )
    rows = rosters.select(*keep, F.posexplode(entries).alias("row_no", "e"))
    return rows.select(
        *keep,
        "row_no",
        F.col("e.row.player_id").alias("external_id"),
        F.col("e.row.name").alias("full_name"),
        parse_iso_date(F.col("e.row.birthdate")).alias("birth_date"),
    )


def feed_errors(
    expected: DataFrame, payloads: DataFrame, failed: DataFrame, key: str, source: str
) -> DataFrame:
    """(error) rows of a roster feed: no teams at all, teams without payload, bad payloads.

    The feed is complete exactly when this frame is empty.
    """
    spark = expected.sparkSession
    none = expected.agg(F.count(F.lit(1)).alias("n")).filter("n = 0")
    absent = expected.select(key).distinct().join(payloads.select(key), key, "left_anti")
    return (
        none.select(F.lit(f"{source} returned no teams").alias("error"))
        .unionByName(absent.select(F.concat(F.lit(f"{source} roster missing for "), key).alias("error")))
        .unionByName(failed.select(F.concat(F.lit(f"{source} roster unreadable for "), key).alias("error")))
    )


# --- schedule ----------------------------------------------------------------------

_GAME = (
    "struct<id string, gameType string, awayTeam struct<abbrev string, score string>, "
    "homeTeam struct<abbrev string, score string>, startTimeUTC string, venue string, "
    "gameState string>"
)


def schedule_games(payloads: DataFrame, order: Sequence[str] = ("page",)) -> DataFrame:
    """Regular-season games; a game seen on several pages keeps its last sighting."""
    weeks = parsed(payloads, f"gameWeek array<struct<date string, games array<{_GAME}>>>")
    days = weeks.select(*order, F.posexplode("_p.gameWeek").alias("_day", "d"))
    games = days.select(
        *order, "_day", F.col("d.date").alias("date"), F.posexplode("d.games").alias("_no", "g")
    ).filter(F.col("g.gameType") == "2")
    rows = games.select(
        parse_strict_integer(F.col("g.id")).alias("nhl_game_id"),
        parse_iso_date(F.col("date")).alias("game_date"),
        X.team_abbreviation(localized_text(F.col("g.awayTeam.abbrev"))).alias("away_team"),
        X.team_abbreviation(localized_text(F.col("g.homeTeam.abbrev"))).alias("home_team"),
        F.col("g.startTimeUTC").try_cast("timestamp").alias("start_time_utc"),
        localized_text(F.col("g.venue")).alias("venue"),
        F.col("g.gameState").alias("game_state"),
        parse_strict_integer(F.col("g.awayTeam.score")).alias("away_score"),
        parse_strict_integer(F.col("g.homeTeam.score")).alias("home_score"),
        F.struct(*order, "_day", "_no").alias("_ord"),
    )
    return first_per_key(rows, ["nhl_game_id"], [F.col("_ord").desc()]).drop("_ord")


# --- active-player index --------------------------------------------------------------


def index_players(rows: DataFrame, cells: str = "cells") -> DataFrame:
    """Players of index rows (arrays of text); rows too short or without a name are dropped."""
    at = lambda i: F.get(F.col(cells), F.lit(i))
    name = X.clean_text(at(0))
    kept = rows.filter((F.size(cells) >= 4) & (name != ""))
    slugged = kept.withColumn("slug", F.coalesce(X.optional_text(at(1)), X.slug_of(name)))
    return slugged.filter(F.col("slug") != "").select(
        name.alias("name"),
        "slug",
        X.clean_text(at(2)).alias("team"),
        X.clean_text(at(3)).alias("position"),
        X.optional_text(at(7)).alias("nationality"),
        parse_short_birth_date(at(30)).alias("birth_date"),
    )


# --- layout projection -----------------------------------------------------------------


def metric_columns(layout: Sequence, value) -> list[Column]:
    """Typed metric columns of a layout; ``value(field)`` gives the text column."""
    return [
        parse_number(value(m.field), m.integer).try_cast("int" if m.integer else "double").alias(m.column)
        for m in layout
    ]


def text_value(df: DataFrame):
    """Field lookup over text columns; an absent field is null."""
    have = set(df.columns)
    return lambda field: F.col(field) if field in have else F.lit(None).cast("string")


def map_value(row: Column):
    return lambda field: F.try_element_at(row, F.lit(field))


def long_tail(df: DataFrame, fields: Sequence[str]) -> Column:
    """All source fields as JSON: numbers parsed, blanks and plain text null."""
    values = [parse_number(F.col(c)).alias(c) for c in fields]
    return F.to_json(F.struct(*values), {"ignoreNullFields": "false"})
