"""Contracts: read views, gap candidates, reconciliation and coverage reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rinkline.functions import text as X
from rinkline.functions.numbers import (
    average_cents,
    buried_relief_cents,
    cap_share,
    cash_cents,
)
from rinkline.operators.keyed import absent_from, first_per_key
from rinkline.operators.merge import insert_absent, merge_plan
from rinkline.operators.quality import (
    QualityError,
    assert_none,
    cap_share_violations,
    check_ordered,
)
from rinkline.plans.stats import PLAYER_SEASON, covered_seasons, stat_seasons, uncovered_seasons
from rinkline.session import staged

FIRST_SEASON, LAST_SEASON = 2008, 2025
LOOK_BACK = 10

# --- read views -------------------------------------------------------------------------


def relevant_contracts(contracts: DataFrame, season: Column | int) -> DataFrame:
    """One contract per player: one covering the season first, then the latest.

    ``season`` may be a number or a column, so a ledger over all seasons can
    ask per row.
    """
    at = F.lit(season) if isinstance(season, int) else season
    order = [
        at.between(F.col("start_season"), F.col("end_season")).desc(),
        F.col("end_season").desc(),
        F.col("signed_on").desc_nulls_last(),
        F.col("id").desc(),
    ]
    return first_per_key(contracts, ["player_id"], order)


def relevant_by_season(contracts: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` rows (player_id, season_start_year, ...) with ``relevant_id``, the player's relevant contract in that season.

    As in ``relevant_contracts`` for each row's season, by one ordered sweep over a
    player's contract starts and asked seasons: of the contracts that have begun
    the one that ends last (then signed last, of highest id) is the answer while it
    runs; once it has ended no contract runs, and the player's last one of all is
    shown. One shuffle by player, no pairs of seasons and contracts. A contract
    without both seasons is only shown where a player has no other.
    """
    spanned = F.col("start_season").isNotNull() & F.col("end_season").isNotNull()
    deal = F.struct(spanned.alias("spanned"), F.col("end_season").alias("ends"), F.col("signed_on").alias("signed_on"), F.col("id").alias("id"))
    starts = contracts.select("player_id", F.when(spanned, F.col("start_season")).alias("_at"), F.lit(0).alias("_asked"), deal.alias("_deal"))
    rows = asked.select("player_id", F.col("season_start_year").alias("_at"), F.lit(1).alias("_asked"), F.struct(*asked.columns).alias("_row"))
    events = starts.unionByName(rows, allowMissingColumns=True)
    player = Window.partitionBy("player_id")
    begun = F.max(F.when(F.col("_deal.spanned"), F.col("_deal"))).over(player.orderBy("_at", "_asked"))
    swept = events.select("_asked", "_row", "_at", begun.alias("_begun"), F.max("_deal").over(player).alias("_last"))
    shown = F.when(F.col("_begun.ends") >= F.col("_at"), F.col("_begun.id")).otherwise(F.col("_last.id"))
    return swept.filter("_asked = 1").select("_row.*", shown.alias("relevant_id"))


def season_structs(contract_seasons: DataFrame, teams: DataFrame) -> DataFrame:
    """(contract_id, seasons): the season rows of a contract as an array in season order."""
    club = teams.select(
        F.col("id").alias("owning_team_id"),
        F.struct(F.col("id"), "nhl_team_id", "abbreviation", "name", "city", "active").alias("owning_team"),
    )
    row = F.struct(
        F.col("season_start_year").alias("season"),
        "owning_team",
        "base_salary_cents",
        "signing_bonus_cents",
        "performance_bonus_cents",
        "total_cash_cents",
        "cap_hit_cents",
        F.col("cap_percentage").cast("double").alias("cap_percentage"),
        "is_slide",
    )
    # bounded: a contract has at most one row per season
    return (
        contract_seasons.join(club, "owning_team_id", "left")
        .groupBy("contract_id")
        .agg(F.array_sort(F.collect_list(row)).alias("seasons"))
    )


def player_contracts(
    tables: Mapping[str, DataFrame], current: int, ids: Sequence[int] | None = None
) -> DataFrame:
    """The relevant contract of every player (or the given ones) with its seasons."""
    contracts = tables["contracts"]
    if ids is not None:
        contracts = contracts.filter(F.col("player_id").isin(list(ids)))
    chosen = relevant_contracts(contracts, current)
    # only the chosen contracts' seasons are gathered
    years = tables["contract_seasons"].join(chosen.select(F.col("id").alias("contract_id")), "contract_id", "left_semi")
    club = tables["teams"].select(
        F.col("id").alias("signing_team_id"),
        F.struct(F.col("id"), "nhl_team_id", "abbreviation", "name", "city", "active").alias("signing_team"),
    )
    return (
        chosen.join(club, "signing_team_id", "left")
        .join(season_structs(years, tables["teams"]).withColumnRenamed("contract_id", "id"), "id", "left")
        .select(
            "id",
            "player_id",
            "signing_team",
            "signed_on",
            "start_season",
            "end_season",
            "term_years",
            "contract_type",
            "expiry_status",
            "total_value_cents",
            "average_value_cents",
            "is_entry_level",
            "seasons",
        )
    )


def team_ledger(
    contracts: DataFrame, contract_seasons: DataFrame, season: int, team_id: int | None = None
) -> DataFrame:
    """Contract rows owned by each team (or one) in a season.

    Only a player's relevant contract is shown. A player listed by several
    contract seasons of the team repeats, once per listing.
    """
    owned = contract_seasons.filter(F.col("season_start_year") == season)
    if team_id is not None:
        owned = owned.filter(F.col("owning_team_id") == team_id)
    owner = contracts.select(F.col("id").alias("contract_id"), "player_id")
    listed = owned.join(owner, "contract_id").select("player_id", F.col("owning_team_id").alias("team_id"))
    chosen = relevant_contracts(contracts, season).select(F.col("id").alias("contract_id"), "player_id")
    shown = owned.withColumnRenamed("owning_team_id", "team_id").join(chosen, "contract_id")
    return listed.join(shown, ["player_id", "team_id"]).select(
        "team_id", "player_id", "contract_id", "season_start_year", "cap_hit_cents", "cap_percentage", "is_slide"
    )


def ledger_all_seasons(contracts: DataFrame, contract_seasons: DataFrame) -> DataFrame:
    """``team_ledger`` of every season at once.

    After contract seasons have met their player, everything happens within a
    player: the relevant contract by a sweep, and how often a team lists the player.
    """
    owner = contracts.select(F.col("id").alias("contract_id"), "player_id")
    rows = contract_seasons.filter("owning_team_id is not null").join(owner, "contract_id").select(
        "player_id", "season_start_year", F.col("owning_team_id").alias("team_id"), "contract_id", "cap_hit_cents", "cap_percentage", "is_slide"
    )
    placed = relevant_by_season(contracts, rows)
    listing = Window.partitionBy("player_id", "season_start_year", "team_id")
    listed = placed.withColumn("_listed", F.count(F.lit(1)).over(listing)).filter(F.col("contract_id") == F.col("relevant_id"))
    return listed.select(
        "team_id", "player_id", "contract_id", "season_start_year", "cap_hit_cents", "cap_percentage", "is_slide",
        F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_listed"))).alias("_n"),
    ).drop("_n")


def team_caps(tables: Mapping[str, DataFrame], season: int | None = None, team_id: int | None = None) -> DataFrame:
    """Cap sheet of every team-season (or one): active, LTIR, buried minors, total, space.

    Every known season is shown for every team, zero where it owns nothing.
    Commitments are summed before they meet the season and team rows.
    """
    seasons, teams, owned = tables["seasons"], tables["teams"], tables["contract_seasons"]
    if season is not None:
        seasons = seasons.filter(F.col("start_year") == season)
        owned = owned.filter(F.col("season_start_year") == season)
    if team_id is not None:
        teams = teams.filter(F.col("id") == team_id)
        owned = owned.filter(F.col("owning_team_id") == team_id)
    status = (
        tables["contracts"]
        .select(F.col("id").alias("contract_id"), "player_id")
        .join(tables["players"].select(F.col("id").alias("player_id"), "roster_status"), "player_id")
    )
    hit = F.col("cap_hit_cents")
    buried = F.greatest(hit - buried_relief_cents(F.col("season_start_year")), F.lit(0))
    minors = F.col("roster_status") == "MINORS"
    sums = (
        owned.join(status, "contract_id", "left")
        .groupBy("season_start_year", F.col("owning_team_id").alias("team_id"))
        .agg(
            F.sum(F.when(F.col("roster_status") == "ACTIVE", hit)).alias("active_cap"),
            F.sum(F.when(F.col("roster_status") == "LTIR", hit)).alias("ltir_cap"),
            F.sum(F.when(minors, buried)).alias("minors_cap"),
            F.sum(F.when(minors, buried).otherwise(hit)).alias("total_cap"),
        )
    )
    grid = team_seasons(teams, seasons)
    amounts = ["active_cap", "ltir_cap", "minors_cap", "total_cap"]
    return (
        grid.join(sums, ["season_start_year", "team_id"], "left")
        .fillna(0, amounts)
        .select(
            "team_id",
            F.col("season_start_year").alias("season"),
            "salary_cap_cents",
            F.col("active_cap").alias("active_roster_cap_cents"),
            F.col("ltir_cap").alias("ltir_cap_cents"),
            F.col("minors_cap").alias("minors_cap_cents"),
            F.col("total_cap").alias("total_commitments_cents"),
            (F.col("salary_cap_cents") - F.col("active_cap")).alias("cap_space_cents"),
            F.lit("ESTIMATE").alias("calculation_status"),
        )
    )


def team_seasons(teams: DataFrame, seasons: DataFrame) -> DataFrame:
    """One row per team and known season, by giving each team the season list."""
    caps = F.array_sort(F.collect_list(F.struct("start_year", "salary_cap_cents")))
    years = seasons.agg(caps).scalar()  # one short list: a row per season
    return teams.select(F.col("id").alias("team_id"), F.inline(years)).withColumnRenamed(
        "start_year", "season_start_year"
    )


# --- coverage reports --------------------------------------------------------------------


def played_seasons(tables: Mapping[str, DataFrame], first: int | None, last: int | None) -> DataFrame:
    return stat_seasons(
        tables["skater_season_stats"], tables["goalie_season_stats"], True, first, last
    )


def _gaps(tables: Mapping[str, DataFrame], first: int | None, last: int | None) -> DataFrame:
    return uncovered_seasons(
        played_seasons(tables, first, last), tables["contracts"], tables["contract_seasons"]
    )


def coverage(tables: Mapping[str, DataFrame], first: int | None = FIRST_SEASON, last: int | None = LAST_SEASON) -> DataFrame:
    """One row: total, covered and missing player-seasons and the covered percentage."""
    check_ordered(first, last)
    held = covered_seasons(tables["contracts"], tables["contract_seasons"]).withColumn("_held", F.lit(1))
    counted = (
        played_seasons(tables, first, last)
        .join(held, PLAYER_SEASON, "left")
        .agg(F.count(F.lit(1)).alias("total"), F.count("_held").alias("covered"))
    )
    share = F.col("covered") * 100 / F.nullif(F.col("total"), F.lit(0))
    return counted.select(
        F.col("total").alias("total_player_seasons"),
        F.col("covered").alias("covered_player_seasons"),
        (F.col("total") - F.col("covered")).alias("missing_player_seasons"),
        F.round(share, 2).alias("coverage_pct"),
    )


def missing_by_season(tables: Mapping[str, DataFrame], first: int | None = FIRST_SEASON, last: int | None = LAST_SEASON) -> DataFrame:
    return _gaps(tables, first, last).groupBy("season_start_year").agg(F.count(F.lit(1)).alias("missing"))


def missing_by_player(tables: Mapping[str, DataFrame], first: int | None = FIRST_SEASON, last: int | None = LAST_SEASON) -> DataFrame:
    names = tables["players"].select(
        F.col("id").alias("player_id"),
        F.concat("first_name", F.lit(" "), "last_name").alias("player"),
    )
    counted = _gaps(tables, first, last).groupBy("player_id").agg(F.count(F.lit(1)).alias("missing"))
    return counted.join(names, "player_id").orderBy(F.desc("missing"), "player_id")


def source_outcomes(source_records: DataFrame, sources: DataFrame) -> DataFrame:
    """Profile records per source and payload status."""
    code = sources.select(F.col("id").alias("source_id"), "code")
    status = F.get_json_object("payload", "$.status")
    return (
        source_records.join(F.broadcast(code), "source_id")  # one row per feed
        .filter(F.col("entity_type") == F.concat("code", F.lit("_player_profile")))
        .groupBy("code", status.alias("status"))
        .agg(F.count(F.lit(1)).alias("records"))
    )


def source_summary(external_ids: DataFrame, contracts: DataFrame, contract_seasons: DataFrame) -> DataFrame:
    """Per source: distinct players, contracts and contract seasons."""
    people = external_ids.select("source_id", "player_id").distinct().groupBy("source_id").agg(F.count(F.lit(1)).alias("players"))
    per_contract = contract_seasons.groupBy("contract_id").agg(F.count(F.lit(1)).alias("_n"))
    deals = (
        contracts.select(F.col("id").alias("contract_id"), "source_id")
        .join(per_contract, "contract_id", "left")
        .groupBy("source_id")
        .agg(F.count(F.lit(1)).alias("contracts"), F.coalesce(F.sum("_n"), F.lit(0)).alias("contract_seasons"))
    )
    return people.join(deals, "source_id", "full").fillna(0)


def cached_summary(tables: Mapping[str, DataFrame], source_id: int) -> dict[str, int]:
    """Counts of a source's last good snapshot, flagged as cached; an error without contracts."""
    found = source_summary(
        tables["player_external_ids"], tables["contracts"], tables["contract_seasons"]
    ).filter(F.col("source_id") == source_id).first()
    if found is None or found["contracts"] == 0:
        raise QualityError("the source has no stored contract snapshot")
    return {k: found[k] for k in ("players", "contracts", "contract_seasons")} | {"cached": 1}


# --- gap candidates and profiles ------------------------------------------------------------


def gap_candidates(
    tables: Mapping[str, DataFrame],
    first: int | None = FIRST_SEASON,
    last: int | None = LAST_SEASON,
    player_id: int | None = None,
    nhl_id: str | None = None,
    force: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Players with played seasons that have no contract, and those seasons in order.

    ``force`` lists every played season, covered or not.
    """
    check_ordered(first, last)
    rows = played_seasons(tables, first, last) if force else _gaps(tables, first, last)
    if player_id is not None:
        rows = rows.filter(F.col("player_id") == player_id)
    code = tables["data_sources"].filter("code = 'nhl'").select(F.col("id").alias("source_id"))
    ids = tables["player_external_ids"].join(F.broadcast(code), "source_id", "left_semi")
    ids = ids.select("player_id", F.col("external_id").alias("nhl_id"))
    # bounded list: a player's seasons
    lists = rows.groupBy("player_id").agg(
        F.array_sort(F.collect_list("season_start_year")).alias("missing_seasons")
    )
    names = tables["players"].select(F.col("id").alias("player_id"), "first_name", "last_name")
    out = lists.join(names, "player_id").join(ids, "player_id", "left")
    if nhl_id is not None:
        out = out.filter(F.col("nhl_id") == nhl_id)
    out = out.withColumn("nhl_id", F.nullif("nhl_id", F.lit("")))
    return out.orderBy("player_id").limit(limit) if limit is not None else out


def profile_status(outcome: Column, covers_target: Column, fallback_source: Column) -> Column:
    """Public status of a profile.

    ``outcome``: 'found', 'no_contracts', 'no_nhl_id', 'not_found', 'failed'
    or 'parse_failed'. On the fallback source, no contract for the wanted
    seasons is told as 'no_matching_contracts'.
    """
    return (
        F.when(fallback_source & (outcome == "no_contracts"), "no_matching_contracts")
        .when(outcome != "found", outcome)
        .when(fallback_source & ~covers_target, "no_matching_contracts")
        .otherwise("succeeded")
    )


def choose_profiles(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Primary profile unless only the fallback covers a wanted season.

    Both have player_id, nhl_id, missing_seasons, seasons (parsed start years)
    and outcome; the fallback is tried only for players with an id whose
    primary covers nothing.
    """

    def read(df: DataFrame, prefix: str, is_fallback: bool) -> DataFrame:
        hits = F.size(F.array_intersect(F.coalesce("missing_seasons", F.array().cast("array<int>")), F.coalesce("seasons", F.array().cast("array<int>"))))
        covers = (F.col("outcome") == "found") & (hits > 0)
        status = profile_status(F.col("outcome"), covers, F.lit(is_fallback))
        return df.select(
            "player_id",
            *([] if is_fallback else ["nhl_id"]),
            covers.alias(f"{prefix}_covers"),
            status.alias(f"{prefix}_status"),
            F.size(F.coalesce("seasons", F.array().cast("array<int>"))).alias(f"{prefix}_seasons"),
        )

    both = read(primary, "primary", False).join(read(fallback, "fallback", True), "player_id", "left")
    tried = ~F.col("primary_covers") & (F.coalesce("nhl_id", F.lit("")) != "") & F.col("fallback_status").isNotNull()
    use = tried & F.col("fallback_covers")
    return both.select(
        "player_id",
        F.when(use, "fallback").otherwise("primary").alias("source"),
        F.when(use, F.col("fallback_status")).otherwise(F.col("primary_status")).alias("status"),
        F.when(use, F.col("fallback_covers")).otherwise(F.col("primary_covers")).alias("covers_target"),
        F.when(use, F.col("fallback_seasons")).otherwise(F.col("primary_seasons")).alias("parsed_seasons"),
        tried.alias("fallback_attempted"),
        F.when(tried, F.col("primary_status")).alias("primary_status"),
        F.when(tried, F.col("fallback_status")).alias("fallback_status"),
    )


def profile_metrics(profiles: DataFrame, contracts: str = "parsed_contracts") -> DataFrame:
    """The twelve counters over chosen profiles (``choose_profiles`` plus a contract count)."""
    status, fallback = F.col("status"), F.col("fallback_status")
    failed = ["failed", "parse_failed"]
    ok = status == "succeeded"
    counts = {
        "profiles_succeeded": ok,
        "profiles_with_target_coverage": F.col("covers_target"),
        "profiles_not_found": status == "not_found",
        "profiles_failed": status.isin(failed),
        "profiles_no_contracts": status == "no_contracts",
        "profiles_no_matching_contracts": status == "no_matching_contracts",
        "primary_profiles_succeeded": ok & (F.col("source") == "primary"),
        "fallback_profiles_succeeded": ok & (F.col("source") == "fallback"),
        "fallbacks_attempted": F.col("fallback_attempted"),
        "fallbacks_failed": fallback.isin(failed),
        "fallbacks_not_found": fallback == "not_found",
    }
    return profiles.agg(
        *[F.count_if(flag).alias(name) for name, flag in counts.items()],
        F.coalesce(F.sum(contracts), F.lit(0)).alias("contracts_parsed"),
    )


# --- reconciliation ----------------------------------------------------------------------


def synthetic_ids(seasons: DataFrame, source_code: str, player_key: str = "nhl_id") -> DataFrame:
    """Contract season rows with ``external_id`` filled: source:player:first:last:place."""
    contract = Window.partitionBy("player_id", "contract_no")  # a contract's few seasons
    made = F.concat_ws(
        ":",
        F.lit(source_code),
        player_key,
        F.min("season_start_year").over(contract),
        F.max("season_start_year").over(contract),
        "contract_no",
    )
    return seasons.withColumn("external_id", X.first_filled(F.col("external_id"), made))


def active_ids(seasons: DataFrame) -> DataFrame:
    """Active-feed ids: slug:first:last:place."""
    contract = Window.partitionBy("slug", "contract_no")
    made = F.concat_ws(
        ":",
        "slug",
        F.min("season_start_year").over(contract),
        F.max("season_start_year").over(contract),
        "contract_no",
    )
    return seasons.withColumn("external_id", made)


def scoped_seasons(
    seasons: DataFrame, known: DataFrame, targets: DataFrame, first: int, last: int
) -> DataFrame:
    """Parsed season rows inside the season table and [first - 10, last].

    ``is_target`` marks the rows that may be written; contracts without one
    are left out.
    """
    # the season table is a row per season; rows meet it and their player's seasons without being dealt by season
    years = F.broadcast(known.select(F.col("start_year").alias("season_start_year"), "salary_cap_cents"))
    # bounded list: a player's seasons
    wanted = targets.select("player_id", F.explode("missing_seasons").alias("_y")).groupBy("player_id").agg(F.collect_set("_y").alias("_wanted"))
    kept = (
        seasons.filter(F.col("season_start_year").between(first - LOOK_BACK, last))
        .join(years, "season_start_year")
        .join(wanted, "player_id", "left")
        .withColumn("is_target", F.coalesce(F.array_contains("_wanted", F.col("season_start_year")), F.lit(False)))
        .drop("_wanted")
    )
    contract = Window.partitionBy("player_id", "contract_no")
    return kept.withColumn("_any", F.max("is_target").over(contract)).filter("_any").drop("_any")


def incoming_contracts(seasons: DataFrame) -> DataFrame:
    """One row per parsed contract from its (scoped, identified) season rows."""
    same = ["source_id", "external_id", "signing_team_id", "signed_on", "term_years", "contract_type",
            "expiry_status", "total_value_cents", "is_entry_level", "source_payload"]
    offered = [c for c in same if c in seasons.columns]
    return seasons.groupBy("player_id", "contract_no").agg(
        *[F.first(c).alias(c) for c in offered],
        F.min("season_start_year").alias("start_season"),
        F.max("season_start_year").alias("end_season"),
    ).withColumn("average_value_cents", average_cents(F.col("total_value_cents"), F.col("term_years")))


def compatible(old_team: Column, new_team: Column, old_total: Column, new_total: Column) -> Column:
    """Signing team and total agree wherever both are known."""
    return F.coalesce(old_team == new_team, F.lit(True)) & F.coalesce(old_total == new_total, F.lit(True))


def match_contracts(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming contracts with ``contract_id`` (null = new) and ``conflict`` (null = none).

    Source id first; only without such a match, player, span and term. More
    than one match, another player's contract or disagreeing facts are
    conflicts. Each side is looked up with one join on an aggregated key, so
    many equal contracts never multiply.
    """
    facts = ["id", "player_id", "signing_team_id", "total_value_cents"]
    by_source = existing.filter("source_id is not null and external_id is not null").select(
        "source_id", "external_id", *[F.col(c).alias(f"s_{c}") for c in facts]
    )
    span = ["player_id", "start_season", "end_season", "term_years"]
    by_span = existing.groupBy(*span).agg(
        F.count(F.lit(1)).alias("_same"),
        F.first(F.struct(*facts)).alias("_one"),
    )
    joined = incoming.join(by_source, ["source_id", "external_id"], "left").join(by_span, span, "left")
    found = F.col("s_id").isNotNull()
    pick = lambda c: F.when(found, F.col(f"s_{c}")).when(F.col("_same") == 1, F.col(f"_one.{c}"))
    agree = compatible(pick("signing_team_id"), F.col("signing_team_id"), pick("total_value_cents"), F.col("total_value_cents"))
    conflict = (
        F.when(~found & (F.col("_same") > 1), "ambiguous")
        .when(found & (F.col("s_player_id") != F.col("player_id")), "foreign player")
        .when(pick("id").isNotNull() & ~agree, "incompatible")
    )
    return joined.select(*incoming.columns, pick("id").alias("contract_id"), conflict.alias("conflict"))


def season_conflicts(seasons: DataFrame, matched: DataFrame, existing: DataFrame) -> DataFrame:
    """(player_id, contract_no) whose stored cap hit differs in any season to write."""
    ids = matched.filter("contract_id is not null and conflict is null").select("player_id", "contract_no", "contract_id")
    stored = existing.select("contract_id", "season_start_year", F.col("cap_hit_cents").alias("_old"))
    return (
        seasons.filter("is_target")
        .join(ids, ["player_id", "contract_no"])
        .join(stored, ["contract_id", "season_start_year"])
        .groupBy("player_id", "contract_no")
        .agg(F.max(F.col("_old") != F.col("cap_hit_cents")).alias("_differs"))
        .filter("_differs")
        .select("player_id", "contract_no")
    )


CONTRACT_FILL = {
    c: "old_or_new"
    for c in ("signed_on", "signing_team_id", "contract_type", "expiry_status", "total_value_cents", "average_value_cents")
} | {"source_payload": "old_unless_empty_json"}
SEASON_FILL = {
    c: "old_or_new"
    for c in ("owning_team_id", "base_salary_cents", "signing_bonus_cents", "performance_bonus_cents", "total_cash_cents", "cap_percentage")
} | {"clauses": "old_unless_empty_json", "is_slide": "either"}


def decide_history(seasons: DataFrame, contracts: DataFrame, contract_seasons: DataFrame) -> DataFrame:
    """Parsed contracts with the stored one they match (null = new) and why they conflict (null = they don't)."""
    # stored, so that neither is made again by the conflicts and each one's shuffles go before the next one's come
    incoming = staged(incoming_contracts(seasons), "incoming")
    matched = staged(match_contracts(incoming, contracts), "matched")
    clash = season_conflicts(seasons, matched, contract_seasons).withColumn("_clash", F.lit(True))
    return matched.join(clash, ["player_id", "contract_no"], "left").withColumn(
        "conflict", F.coalesce("conflict", F.when(F.col("_clash"), "cap hit"))
    ).drop("_clash")


def history_rows(
    seasons: DataFrame, contracts: DataFrame, contract_seasons: DataFrame, next_id: Column | int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What a fill-only reconciliation writes: (contracts by id, contract seasons, decisions).

    ``seasons`` are scoped rows with resolved team ids; a contract in conflict is
    skipped whole. New contracts get ids from ``next_id`` on, in source-id order.
    """
    decided = staged(decide_history(seasons, contracts, contract_seasons), "decided")
    accepted = decided.filter("conflict is null")
    fresh = number_rows(accepted.filter("contract_id is null").drop("contract_id"), "contract_id", next_id, ["source_id", "external_id"])
    known = accepted.filter("contract_id is not null").unionByName(fresh)
    # two parsed contracts may match one stored contract: the first fills it
    first = first_per_key(known, ["contract_id"], [F.col("contract_no")])
    rows = (
        seasons.filter("is_target")
        .join(known.select("player_id", "contract_no", "contract_id"), ["player_id", "contract_no"])
        .withColumn("total_cash_cents", cash_cents(F.col("base_salary_cents"), F.col("signing_bonus_cents")))
        .withColumn("cap_percentage", cap_share(F.col("cap_hit_cents"), F.col("salary_cap_cents")))
    )
    one = first_per_key(rows, ["contract_id", "season_start_year"], [F.col("contract_no")])
    return first.withColumnRenamed("contract_id", "id"), one, decided


def fill_contracts(contracts: DataFrame, rows: DataFrame) -> DataFrame:
    """Plan of a fill-only merge: stored values win over new ones."""
    return merge_plan(contracts, rows, ["id"], CONTRACT_FILL)


def fill_seasons(contract_seasons: DataFrame, rows: DataFrame) -> DataFrame:
    return merge_plan(contract_seasons, rows, ["contract_id", "season_start_year"], SEASON_FILL)


def plan_history(
    seasons: DataFrame, contracts: DataFrame, contract_seasons: DataFrame, next_id: Column | int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fill-only reconciliation of parsed seasons: (contract plan, season plan, decisions); see ``history_rows``."""
    deals, years, decided = history_rows(seasons, contracts, contract_seasons, next_id)
    return fill_contracts(contracts, deals), fill_seasons(contract_seasons, years), decided


def number_rows(df: DataFrame, column: str, start: Column | int, order: Sequence[str]) -> DataFrame:
    """Consecutive ids from ``start`` on, by ``order``, without one task seeing all rows.

    Rows are range-partitioned and sorted once and written out; each
    partition then adds the number of rows before it, taken from per-part
    counts.
    """
    part = F.spark_partition_id()
    laid = df.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = staged(laid.select("*", part.alias("_part"), F.monotonically_increasing_id().alias("_at")), "numbered")
    sizes = laid.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_from"))
    before = F.coalesce(
        F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    offsets = sizes.select("_part", "_from", before.alias("_before"))  # one row per partition
    first = F.lit(start) if isinstance(start, int) else start
    numbered = laid.join(F.broadcast(offsets), "_part")
    return numbered.withColumn(column, (first + F.col("_before") + F.col("_at") - F.col("_from")).cast("bigint")).drop("_part", "_at", "_from", "_before")


def plan_active(
    seasons: DataFrame, contracts: DataFrame, contract_seasons: DataFrame, next_id: int
) -> tuple[DataFrame, DataFrame]:
    """Active-feed snapshot: its contracts and seasons overwrite the stored ones.

    ``seasons`` has slug, player_id, contract_no, season_no, source_id,
    signing_team_id, owning_team_id and salary_cap_cents. The contract's
    average is its first season's cap hit, its term the number of seasons.
    """
    rows = active_ids(seasons)
    deals = rows.groupBy("source_id", "external_id").agg(
        *[F.first(c).alias(c) for c in ("player_id", "signing_team_id", "contract_type", "expiry_status", "total_value_cents", "is_entry_level", "source_payload") if c in rows.columns],
        F.min("season_start_year").alias("start_season"),
        F.max("season_start_year").alias("end_season"),
        F.count(F.lit(1)).cast("int").alias("term_years"),
        F.min_by("cap_hit_cents", "season_no").alias("average_value_cents"),
    )
    stored = contracts.filter("external_id is not null").select("source_id", "external_id", "id")
    found = deals.join(stored, ["source_id", "external_id"], "left")
    fresh = number_rows(found.filter("id is null").drop("id"), "id", next_id, ["source_id", "external_id"])
    keyed = found.filter("id is not null").unionByName(fresh)
    overwrite = {c: "new" for c in keyed.columns if c not in ("id", "source_id", "external_id")}
    contract_plan = merge_plan(contracts, keyed, ["id"], overwrite)
    years = rows.join(keyed.select("source_id", "external_id", F.col("id").alias("contract_id")), ["source_id", "external_id"])
    years = years.withColumn("cap_percentage", F.col("cap_hit_cents") / F.nullif("salary_cap_cents", F.lit(0)))
    assert_none(cap_share_violations(years), "cap hit above the salary cap")
    years = years.withColumn("cap_percentage", F.col("cap_percentage").cast("decimal(9,8)")).select(
        "contract_id", "season_start_year", "owning_team_id", "cap_hit_cents", "cap_percentage", "is_slide"
    )
    rules = {c: "new" for c in ("owning_team_id", "cap_hit_cents", "cap_percentage", "is_slide")}
    return contract_plan, merge_plan(contract_seasons, years, ["contract_id", "season_start_year"], rules)


def new_source_records(existing: DataFrame, records: DataFrame) -> DataFrame:
    """Profile snapshots whose (source, entity, key, payload hash) is not stored yet.

    ``records``: source_id, source_code, player_id, nhl_id, payload (JSON
    text). A player without an id is keyed by the player id.
    """
    built = records.select(
        "source_id",
        F.concat("source_code", F.lit("_player_profile")).alias("entity_type"),
        F.coalesce(F.nullif("nhl_id", F.lit("")), F.col("player_id").cast("string")).alias("external_key"),
        F.sha2("payload", 256).alias("payload_hash"),
        "payload",
    )
    return insert_absent(existing, built, ["source_id", "entity_type", "external_key", "payload_hash"])
