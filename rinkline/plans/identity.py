"""Identity across sources: players are found by external id, never guessed by name.

Each function plans: it returns the merged players, the merged bridge rows
and the (source_id, external_id) to player_id map of the incoming rows.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkline.functions import text as X
from rinkline.operators.keyed import first_per_key, only_if_single
from rinkline.operators.merge import merge_plan
from rinkline.plans.contracts import number_rows

KEY = ["source_id", "external_id"]


class Resolved(NamedTuple):
    players: DataFrame
    bridge: DataFrame
    ids: DataFrame


def latest_profiles(rows: DataFrame, key: str = "external_id", season: str = "season") -> DataFrame:
    """Profile of each id from its latest season; within a season the later row."""
    return first_per_key(rows, [key], [F.col(season).desc(), F.col("_ord").desc()])


def first_profiles(rows: DataFrame, key: str = "external_id") -> DataFrame:
    return first_per_key(rows, [key], [F.col("_ord").asc()])


def _named(incoming: DataFrame) -> DataFrame:
    """Blank name parts become null so that they never replace a stored name."""
    parts = X.split_name(F.col("name"))
    return incoming.withColumn("first_name", F.nullif(parts["first"], F.lit(""))).withColumn(
        "last_name", F.nullif(parts["last"], F.lit(""))
    )


_PROFILE = ["first_name", "last_name", "birth_date", "primary_position", "shoots_catches", "nationality"]


def _profile_rows(rows: DataFrame) -> DataFrame:
    have = set(rows.columns)
    value = {"primary_position": "position"}
    return rows.select(
        F.col("player_id").alias("id"),
        *[
            (F.col(value.get(c, c)) if value.get(c, c) in have else F.lit(None)).alias(c)
            for c in _PROFILE
        ],
        F.lit(True).alias("active"),
        F.lit("UNKNOWN").alias("roster_status"),
    )


def bridged(bridge: DataFrame, own: int, sister: int | None = None) -> DataFrame:
    """external_id to player_id in one source, falling back to a sister source."""
    kept = bridge.filter(F.col("source_id").isin([own] if sister is None else [own, sister]))
    order = [(F.col("source_id") == own).desc(), F.col("player_id")]
    return first_per_key(kept, ["external_id"], order).select("external_id", "player_id")


def link_rows(bridge: DataFrame, links: DataFrame) -> DataFrame:
    """Bridge upsert: the name is refreshed, the slug only filled, the owner kept."""
    return merge_plan(bridge, links, KEY, {"source_slug": "new_or_old", "source_name": "new"})


def upsert_players(
    players: DataFrame,
    bridge: DataFrame,
    incoming: DataFrame,
    source_id: int,
    next_id: int,
    sister: int | None = None,
) -> Resolved:
    """Find by (source, external id), else create.

    Stored values are filled from the incoming profile (new over old where
    new is known); new players without a usable name part get 'Unknown'.
    With a ``sister`` source its ids count as found too: every incoming id is
    then linked to this source, and found players keep their profile.
    """
    rows = _named(incoming.withColumn("source_id", F.lit(source_id).cast("bigint")))
    found = rows.join(bridged(bridge, source_id, sister), "external_id", "left")
    known = found.filter("player_id is not null")
    fresh = number_rows(found.filter("player_id is null").drop("player_id"), "player_id", next_id, ["external_id"])
    created = fresh.fillna("Unknown", ["first_name", "last_name"])
    keep = "new_or_old" if sister is None else "old"
    one = first_per_key(known, ["player_id"], [F.col("external_id")])
    profiles = _profile_rows(one).unionByName(_profile_rows(created))
    plan = merge_plan(players, profiles, ["id"], {c: keep for c in _PROFILE})
    every = known.unionByName(created)
    slug = F.col("source_slug") if "source_slug" in every.columns else F.lit(None).cast("string")
    links = every.select("player_id", *KEY, slug.alias("source_slug"), F.col("name").alias("source_name"))
    if sister is None:  # a plain upsert only adds bridge rows for the players it creates
        links = links.join(created.select(*KEY), KEY, "left_semi")
    return Resolved(plan, link_rows(bridge, links), every.select(*KEY, "player_id"))


def resolve_roster_players(
    players: DataFrame, bridge: DataFrame, incoming: DataFrame, own: int, sister: int, next_id: int
) -> Resolved:
    """Roster identity: a sister-source match overwrites the profile and marks it active.

    Overwriting takes the raw birth country as nationality; players without
    a sister match follow the plain upsert with the normalised one.
    """
    rows = _named(incoming.withColumn("source_id", F.lit(own).cast("bigint")))
    matched = rows.join(bridged(bridge, sister), "external_id")
    plain = incoming.join(matched.select("external_id"), "external_id", "left_anti")
    base = upsert_players(players, bridge, plain, own, next_id)
    one = first_per_key(matched.withColumn("nationality", F.col("birth_country")), ["player_id"], [F.col("external_id")])
    overwrite = {c: "new" for c in [*_PROFILE, "active"]}
    plan = merge_plan(base.players.drop("_action"), _profile_rows(one).drop("roster_status"), ["id"], overwrite)
    links = matched.select("player_id", *KEY, F.lit(None).cast("string").alias("source_slug"), F.col("name").alias("source_name"))
    linked = link_rows(base.bridge.drop("_action"), links)
    ids = base.ids.unionByName(matched.select(*KEY, "player_id"))
    return Resolved(plan, linked, ids)


def resolve_by_name(
    players: DataFrame, bridge: DataFrame, incoming: DataFrame, source_id: int, next_id: int
) -> Resolved:
    """Unique lower-cased (first, last) match, else find or create by slug.

    ``incoming`` has slug, name, profile columns and ``_ord``. A name held by
    one stored player goes to it. A name nobody holds is created once, by its
    first row, and later rows of that name join it. A name several players
    hold is never matched: each row stands for itself.
    """
    key = ["first_key", "last_key"]
    parts = X.split_name(F.col("name"))
    rows = incoming.select(
        "*",
        F.lower(parts["first"]).alias("first_key"),
        F.lower(parts["last"]).alias("last_key"),
        F.col("slug").alias("external_id"),
        F.col("slug").alias("source_slug"),
    )
    stored = players.groupBy(F.lower("first_name").alias("first_key"), F.lower("last_name").alias("last_key")).agg(
        F.count(F.lit(1)).alias("_holders"), F.first("id").alias("_holder")
    )
    told = rows.join(stored, key, "left").withColumn("_holders", F.coalesce("_holders", F.lit(0)))
    unique = told.filter("_holders = 1").withColumn("player_id", F.col("_holder"))
    several = told.filter("_holders > 1")
    unheld = told.filter("_holders = 0")
    leaders = first_per_key(unheld, key, [F.col("_ord")])
    own = several.unionByName(leaders).drop("_holders", "_holder", *key)
    base = upsert_players(players, bridge, own, source_id, next_id)
    lead_ids = leaders.select(*key, F.col("external_id").alias("_lead")).join(
        base.ids.select(F.col("external_id").alias("_lead"), "player_id"), "_lead"
    )
    followers = unheld.join(leaders.select("external_id"), "external_id", "left_anti").join(
        lead_ids.drop("_lead"), key
    )
    linked = unique.select("player_id", "external_id", "source_slug", "name").unionByName(
        followers.select("player_id", "external_id", "source_slug", "name")
    )
    links = linked.select(
        "player_id", F.lit(source_id).cast("bigint").alias("source_id"), "external_id", "source_slug",
        F.col("name").alias("source_name"),
    )
    ids = base.ids.unionByName(links.select(*KEY, "player_id"))
    return Resolved(base.players, link_rows(base.bridge.drop("_action"), links), ids)


# --- teams -----------------------------------------------------------------------------


def upsert_teams(teams: DataFrame, incoming: DataFrame, next_id: int) -> DataFrame:
    """Team plan: a real name replaces a placeholder (name = abbreviation), the rest is filled.

    ``incoming`` has abbreviation and optionally name, city and ids, one row
    per abbreviation.
    """
    known = teams.select("abbreviation", F.col("id"))
    named = incoming.withColumn(
        "name",
        F.nullif(F.nullif("name", F.lit("")), F.col("abbreviation")) if "name" in incoming.columns else F.lit(None).cast("string"),
    )
    keyed = named.join(known, "abbreviation", "left")
    fresh = number_rows(keyed.filter("id is null").drop("id"), "id", next_id, ["abbreviation"])
    rows = keyed.filter("id is not null").unionByName(fresh).withColumn("active", F.lit(True))
    filled = [c for c in ("name", "city", "nhl_team_id", "nhl_franchise_id") if c in rows.columns]
    plan = merge_plan(teams, rows, ["abbreviation"], {c: "new_or_old" for c in filled})
    return plan.withColumn("name", F.coalesce("name", "abbreviation"))


def team_lookup(teams: DataFrame) -> DataFrame:
    """(team_key, team_id): abbreviation or full name, case and spacing ignored."""
    keys = [F.lower(X.clean_text(F.col(c))) for c in ("abbreviation", "name")]
    both = teams.select("id", F.explode(F.array(*keys)).alias("team_key"))
    return both.filter("team_key <> ''").groupBy("team_key").agg(F.max("id").alias("team_id"))


def resolve_teams(
    rows: DataFrame, lookup: DataFrame, text: str, name: str, stints: DataFrame | None = None
) -> DataFrame:
    """Team id from its text; failing that, from the player's only team of the season."""
    named = rows.withColumn("_key", F.lower(X.clean_text(F.col(text)))).join(
        lookup.withColumnRenamed("team_key", "_key").withColumnRenamed("team_id", name), "_key", "left"
    ).drop("_key")
    if stints is None:
        return named
    keys = ["player_id", "season_start_year"]
    only = only_if_single(stints.select(*keys, "team_id").distinct(), keys, ["team_id"])
    return (
        named.join(only.withColumnRenamed("team_id", "_only"), keys, "left")
        .withColumn(name, F.coalesce(name, "_only"))
        .drop("_only")
    )


