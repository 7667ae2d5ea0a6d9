"""Coverage, reconciliation, pages, identity, rosters and stints."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkline.operators import keyed
from rinkline.plans import contracts as C
from rinkline.plans import identity as I
from rinkline.plans import roster as R
from rinkline.session import staged
from rinkline.sources import documents as D
from rinkline.workload.registry import query

COVERAGE = ["skater_season_stats", "goalie_season_stats", "contracts", "contract_seasons", "players"]


_GAP = {
    "covered": "SELECT DISTINCT c.player_id, cs.season_start_year FROM contracts c JOIN contract_seasons cs ON cs.contract_id = c.id WHERE c.is_entry_level",
    "gap": "SELECT * FROM played p WHERE season_start_year BETWEEN 1996 AND 2001 AND (player_id, season_start_year) NOT IN (SELECT (player_id, season_start_year) FROM covered)",
}


@query("""SELECT count(*) AS total_player_seasons, count(c.player_id) AS covered_player_seasons, count(*) - count(c.player_id) AS missing_player_seasons,
    round(count(c.player_id) * 100.0 / count(*), 2)::DOUBLE AS coverage_pct FROM played p LEFT JOIN covered c ON c.player_id = p.player_id AND c.season_start_year = p.season_start_year WHERE p.season_start_year BETWEEN 1996 AND 2001""", **_GAP)
def contract_coverage(lg):
    return C.coverage(_owned_by_few(lg), 1996, 2001)


@query("""SELECT count(*) AS total_player_seasons, count(c.player_id) AS covered_player_seasons, count(*) - count(c.player_id) AS missing_player_seasons,
    round(count(c.player_id) * 100.0 / count(*), 2)::DOUBLE AS coverage_pct FROM played p LEFT JOIN covered c ON c.player_id = p.player_id AND c.season_start_year = p.season_start_year""", **_GAP)
def contract_coverage_all_seasons(lg):
    return C.coverage(_owned_by_few(lg), None, None)


@query("""SELECT p.player_id, string_agg(p.season_start_year::VARCHAR, ',' ORDER BY p.season_start_year) AS seasons FROM played p
    WHERE (player_id, season_start_year) NOT IN (SELECT (player_id, season_start_year) FROM covered) AND player_id IN (SELECT id FROM players) GROUP BY 1""", **_GAP)
def contract_gaps_all_seasons(lg):
    rows = C.gap_candidates({**_owned_by_few(lg), **lg.tables("data_sources", "player_external_ids")}, None, None)
    return rows.select("player_id", F.array_join(F.transform("missing_seasons", lambda y: y.cast("string")), ",").alias("seasons"))


def _owned_by_few(lg) -> dict[str, DataFrame]:
    """Coverage tables where only entry-level contracts count, so that gaps exist."""
    t = lg.tables(*COVERAGE)
    return {**t, "contracts": t["contracts"].filter("is_entry_level")}


@query("SELECT season_start_year, count(*) AS missing FROM gap GROUP BY 1", **_GAP)
def missing_contracts_by_season(lg):
    return C.missing_by_season(_owned_by_few(lg), 1996, 2001)


@query("SELECT p.id AS player_id, p.first_name || ' ' || p.last_name AS player, count(*) AS missing FROM gap g JOIN players p ON p.id = g.player_id GROUP BY 1, 2", **_GAP)
def missing_contracts_by_player(lg):
    return C.missing_by_player(_owned_by_few(lg), 1996, 2001)


@query("""SELECT g.player_id, any_value(p.last_name) AS last_name, any_value(x.external_id) AS nhl_id, string_agg(season_start_year::VARCHAR, ',' ORDER BY season_start_year) AS seasons
    FROM gap g JOIN players p ON p.id = g.player_id LEFT JOIN player_external_ids x ON x.player_id = g.player_id AND x.source_id = 1 GROUP BY 1""", **_GAP)
def contract_gap_candidates(lg):
    t = {**_owned_by_few(lg), **lg.tables("data_sources", "player_external_ids")}
    rows = C.gap_candidates(t, 1996, 2001)
    return rows.select("player_id", "last_name", "nhl_id", F.array_join(F.transform("missing_seasons", lambda y: y.cast("string")), ",").alias("seasons"))


@query("""SELECT source_id, max(players)::BIGINT AS players, max(contracts)::BIGINT AS contracts, max(contract_seasons)::BIGINT AS contract_seasons FROM (
    SELECT source_id, count(DISTINCT player_id) AS players, 0 AS contracts, 0 AS contract_seasons FROM player_external_ids GROUP BY 1
    UNION ALL SELECT c.source_id, 0, count(DISTINCT c.id), count(*) FROM contracts c JOIN contract_seasons s ON s.contract_id = c.id GROUP BY 1) GROUP BY 1""")
def source_snapshot_counts(lg):
    t = lg.tables("player_external_ids", "contracts", "contract_seasons")
    return C.source_summary(t["player_external_ids"], t["contracts"], t["contract_seasons"])


_RECORDS = """(SELECT DISTINCT ON (user_id, event_type) event_type, user_id, CASE WHEN event_type = 'click' THEN 4 ELSE 3 END AS source_id FROM events WHERE event_type IN ('click', 'view', 'error'))"""


@query(f"""SELECT CASE source_id WHEN 4 THEN 'capspace' ELSE 'capwages' END AS code, event_type AS status, count(*) AS records FROM {_RECORDS} GROUP BY 1, 2""")
def source_outcome_counts(lg):
    return C.source_outcomes(_new_records(lg), lg.tables("data_sources")["data_sources"])


def _new_records(lg) -> DataFrame:
    kind = F.col("event_type")
    rows = lg.raw("events").filter(kind.isin("click", "view", "error")).select(
        F.when(kind == "click", 4).otherwise(3).cast("bigint").alias("source_id"),
        F.when(kind == "click", "capspace").otherwise("capwages").alias("source_code"),
        F.col("user_id").alias("player_id"),
        F.when(kind != "error", F.col("user_id").cast("string")).otherwise("").alias("nhl_id"),
        F.to_json(F.struct(kind.alias("status"))).alias("payload"),
    )
    return C.new_source_records(lg.spark.createDataFrame([], "source_id bigint, entity_type string, external_key string, payload_hash string"), rows)


@query(f"""SELECT source_id, CASE source_id WHEN 4 THEN 'capspace_player_profile' ELSE 'capwages_player_profile' END AS entity_type, user_id::VARCHAR AS external_key, sha256('{{"status":"' || event_type || '"}}') AS payload_hash FROM {_RECORDS}""")
def new_source_records(lg):
    return _new_records(lg).drop("payload")


# --- profile choice ------------------------------------------------------------------------


def _profiles(lg) -> tuple[DataFrame, DataFrame]:
    """Per customer: entry-level contracts are what the primary source knows, others the fallback."""
    t = lg.tables("contracts")["contracts"]
    lists = t.groupBy("player_id").agg(
        F.collect_set(F.when(F.col("is_entry_level"), F.col("start_season"))).alias("own"),
        F.collect_set(F.when(~F.col("is_entry_level"), F.col("start_season"))).alias("other"),
    )
    who = lg.raw("customer").select(F.col("c_custkey").alias("player_id"), F.when(F.col("c_acctbal") > 0, "1").alias("nhl_id"), "c_mktsegment")
    rows = who.join(lists, "player_id").withColumn("missing_seasons", F.array(F.lit(1996), F.lit(1999)).cast("array<int>"))
    outcome = lambda c: F.when(F.col("c_mktsegment") == "BUILDING", "failed").when(F.size(c) == 0, "no_contracts").otherwise("found")
    first = rows.select("player_id", "nhl_id", "missing_seasons", F.col("own").alias("seasons"), outcome("own").alias("outcome"))
    second = rows.select("player_id", "missing_seasons", F.col("other").alias("seasons"), F.when(F.size("other") == 0, "not_found").otherwise("found").alias("outcome"))
    return first, second


_PROFILE = {
    "lists": """SELECT c.player_id, bool_or(c.is_entry_level AND c.start_season IN (1996, 1999)) AS own_hit, bool_or(NOT c.is_entry_level AND c.start_season IN (1996, 1999)) AS other_hit,
        bool_or(c.is_entry_level) AS own_any, bool_or(NOT c.is_entry_level) AS other_any, any_value(k.c_acctbal) > 0 AS has_id, any_value(k.c_mktsegment) = 'BUILDING' AS broken,
        count(DISTINCT CASE WHEN c.is_entry_level THEN c.start_season END) AS own_n, count(DISTINCT CASE WHEN NOT c.is_entry_level THEN c.start_season END) AS other_n
        FROM contracts c JOIN customer k ON k.c_custkey = c.player_id GROUP BY 1""",
    "tried_rows": """SELECT *, own_hit AND NOT broken AS own_covers, NOT (own_hit AND NOT broken) AND has_id AS tried, CASE WHEN broken THEN 'failed' WHEN NOT own_any THEN 'no_contracts' ELSE 'succeeded' END AS own_status,
        CASE WHEN NOT other_any THEN 'not_found' WHEN NOT other_hit THEN 'no_matching_contracts' ELSE 'succeeded' END AS other_status FROM lists""",
    "chosen": """SELECT player_id, CASE WHEN tried AND other_hit THEN 'fallback' ELSE 'primary' END AS source, CASE WHEN tried AND other_hit THEN other_status ELSE own_status END AS status,
        CASE WHEN tried AND other_hit THEN TRUE ELSE own_covers END AS covers_target, CASE WHEN tried AND other_hit THEN other_n ELSE own_n END AS parsed_seasons,
        tried AS fallback_attempted, CASE WHEN tried THEN other_status END AS fallback_status FROM tried_rows""",
}


@query("SELECT player_id, source, status, covers_target, parsed_seasons, fallback_attempted, fallback_status FROM chosen", **_PROFILE)
def chosen_profiles(lg):
    return C.choose_profiles(*_profiles(lg)).drop("primary_status")


@query("""SELECT count(*) FILTER (WHERE status = 'succeeded') AS profiles_succeeded, count(*) FILTER (WHERE covers_target) AS profiles_with_target_coverage, count(*) FILTER (WHERE status = 'not_found') AS profiles_not_found,
    count(*) FILTER (WHERE status IN ('failed', 'parse_failed')) AS profiles_failed, count(*) FILTER (WHERE status = 'no_contracts') AS profiles_no_contracts, count(*) FILTER (WHERE status = 'no_matching_contracts') AS profiles_no_matching_contracts,
    count(*) FILTER (WHERE status = 'succeeded' AND source = 'primary') AS primary_profiles_succeeded, count(*) FILTER (WHERE status = 'succeeded' AND source = 'fallback') AS fallback_profiles_succeeded,
    count(*) FILTER (WHERE fallback_attempted) AS fallbacks_attempted, count(*) FILTER (WHERE fallback_status IN ('failed', 'parse_failed')) AS fallbacks_failed, count(*) FILTER (WHERE fallback_status = 'not_found') AS fallbacks_not_found,
    sum(parsed_seasons)::BIGINT AS contracts_parsed FROM chosen""", **_PROFILE)
def profile_counters(lg):
    return C.profile_metrics(C.choose_profiles(*_profiles(lg)), "parsed_seasons")


# --- contract pages ------------------------------------------------------------------------------


def contract_pages(lg) -> DataFrame:
    """One page per order: JSON, a rendered table, an empty notice or junk, by order status and balance."""
    # spread over tasks while rows are small; the pages are built after that
    t = lg.tables("contracts")["contracts"].repartition("id")
    money = lambda c: F.concat(F.lit("$"), F.format_number((F.col(c) / 100).cast("decimal(20,2)"), 2))
    years = F.sequence("start_season", "end_season")
    label = lambda y: F.concat(y, F.lit("-"), F.lpad(((y + 1) % 100).cast("string"), 2, "0"))
    detail = F.transform(years, lambda y: F.struct(label(y).alias("season"), money("average_value_cents").alias("capHit"), F.lit("$1,000").alias("nhlSalary")))
    deal = F.struct(
        F.col("external_id").alias("id"), F.col("contract_type").alias("type"), F.col("term_years").alias("term"), money("total_value_cents").alias("value"),
        F.date_format("signed_on", "M/d/y").alias("signingDate"), F.col("expiry_status").alias("expiryStatus"), detail.alias("details"),
    )
    player = F.struct(F.col("player_id").alias("nhlId"), F.array(deal).alias("contracts"))
    page = F.to_json(F.struct(F.struct(F.struct(player.alias("player")).alias("pageProps")).alias("props")))
    script = F.concat(F.lit("<html><script id=\"__NEXT_DATA__\" type=\"application/json\">\n"), page, F.lit("</script><p>No recorded contracts</p></html>"))
    cells = F.array_join(F.transform(years, lambda y: F.concat(F.lit("<tr><td>"), label(y), F.lit("</td><td>"), money("average_value_cents"), F.lit("</td><td>$1,000</td></tr>"))), "")
    table = F.concat(
        F.lit("<article><h3>"), F.col("contract_type"), F.lit(" Contract</h3><div>Total Value: "), money("total_value_cents"), F.lit(" | Seasons: "), F.col("term_years"),
        F.lit(" | Signing Date: "), F.date_format("signed_on", "MMM d, y"), F.lit("</div><table><tr><th>Season</th><th>Cap Hit</th><th>NHL Salary</th></tr>"),
        cells, F.lit("<tr><td>Buyout Years</td></tr><tr><td>1990-91</td><td>$1</td></tr></table></article>"),
    )
    kind = F.col("contract_type")
    html = F.when(kind == "STANDARD", script).when(kind == "ONE_WAY", table).when(F.col("term_years") > 2, "<html><h1>Contract History</h1></html>").otherwise("<html>maintenance</html>")
    return t.select(F.col("id").alias("key"), "player_id", html.alias("html"))


@query("""SELECT id AS key, season_start_year, cap_hit_cents, 100000 AS base_salary_cents, total_value_cents, term_years, signed_on::VARCHAR AS signed_on,
    CASE WHEN contract_type = 'STANDARD' THEN 'STANDARD' ELSE 'ONE_WAY Contract' END AS contract_type, CASE WHEN contract_type = 'STANDARD' THEN expiry_status END AS expiry_status
    FROM (SELECT c.*, s.season_start_year, s.cap_hit_cents FROM contracts c JOIN contract_seasons s ON s.contract_id = c.id) WHERE contract_type <> 'ENTRY LEVEL'""")
def contract_page_seasons(lg):
    seasons, _ = D.page_contracts(contract_pages(lg))
    return seasons.select("key", "season_start_year", "cap_hit_cents", "base_salary_cents", "total_value_cents", "term_years", "signed_on", "contract_type", "expiry_status")


@query("""SELECT id AS key, CASE WHEN contract_type <> 'ENTRY LEVEL' THEN 'ok' WHEN term_years > 2 THEN 'absent' ELSE 'failed' END AS status FROM contracts""")
def contract_page_outcomes(lg):
    return D.page_contracts(contract_pages(lg))[1]


@query("""SELECT page_id AS key, CASE WHEN regexp_matches(html, 'Contract History|No recorded contracts', 'i') AND NOT regexp_matches(html, '<table', 'i') THEN 'absent' ELSE 'failed' END AS status FROM pages""")
def raw_page_outcomes(lg):
    """The web pages hold no contracts: every page is read whole and told apart."""
    return D.page_contracts(lg.raw("pages").select(F.col("page_id").alias("key"), "html"))[1]


@query("""SELECT o.id AS key, o.player_id, o.contract_type = 'STANDARD' AND k.c_acctbal >= 0 AS matches FROM contracts o JOIN customer k ON k.c_custkey = o.player_id""")
def page_identity_matches(lg):
    """Each page against the order's customer; those in debt are offered under another id."""
    t = lg.tables("contracts")["contracts"]
    who = lg.raw("customer").select(F.col("c_custkey").alias("player_id"), F.when(F.col("c_acctbal") >= 0, F.col("c_custkey")).otherwise(-1).cast("string").alias("nhl_id"))
    wanted = t.select(F.col("id").alias("key"), "player_id").join(who, "player_id").withColumns(
        {"first_name": F.lit("No"), "last_name": F.lit("One"), "missing_seasons": F.array(F.lit(1999)).cast("array<int>")}
    )
    pages = contract_pages(lg).withColumn("url", F.concat(F.lit("https://pages/players/p-"), F.col("key")))
    return D.matches_candidate(pages, wanted)


# --- reconciliation ---------------------------------------------------------------------------------


def _parsed_history(lg) -> DataFrame:
    """Parsed seasons of every order: entry-level ones are unknown to the store, ONE_WAY ones raise the total, UFA ones agree."""
    t = lg.tables("contracts", "contract_seasons", "seasons")
    deals = t["contracts"].select(
        F.col("id").alias("contract_no"), "player_id", "source_id", "external_id", "signing_team_id", "signed_on", "term_years", "contract_type", "expiry_status", "is_entry_level",
        (F.col("total_value_cents") + F.when(F.col("contract_type") == "ONE_WAY", 1).otherwise(0)).alias("total_value_cents"), F.lit("{}").alias("source_payload"),
    )
    years = t["contract_seasons"].select(
        F.col("contract_id").alias("contract_no"), "season_start_year", "owning_team_id", "base_salary_cents", F.lit(7).cast("bigint").alias("signing_bonus_cents"),
        "performance_bonus_cents", (F.col("cap_hit_cents") + F.when(F.col("base_salary_cents") % 11 == 0, 1).otherwise(0)).alias("cap_hit_cents"), "is_slide", F.lit('{"a":1}').alias("clauses"),
    )
    return years.join(deals, "contract_no")


def _history_input(lg):
    t = lg.tables("contracts", "contract_seasons", "seasons")
    wanted = lg.raw("customer").select(F.col("c_custkey").alias("player_id"), F.array(*[F.lit(y) for y in range(1995, 2001)]).cast("array<int>").alias("missing_seasons"))
    scoped = C.scoped_seasons(_parsed_history(lg), t["seasons"], wanted, 2000, 2002)
    known = t["contracts"].filter("not is_entry_level")
    stored = t["contract_seasons"].join(known.select(F.col("id").alias("contract_id")), "contract_id", "left_semi")
    return staged(scoped, "history"), known, stored


def _history(lg):
    return C.plan_history(*_history_input(lg), 1_000_000_000)


_HISTORY = {
    "parsed": """SELECT c.id AS contract_no, c.contract_type, c.player_id, y.season_start_year, y.base_salary_cents, y.cap_hit_cents AS stored_hit, y.signing_bonus_cents AS stored_bonus,
        y.cap_hit_cents + CASE WHEN y.base_salary_cents % 11 = 0 THEN 1 ELSE 0 END AS cap_hit FROM contracts c JOIN contract_seasons y ON y.contract_id = c.id WHERE y.season_start_year BETWEEN 1990 AND 2002""",
    "wanted": "SELECT * FROM parsed WHERE season_start_year BETWEEN 1995 AND 2000",
    "spans": """SELECT i.id AS contract_no, count(c.id) AS same FROM contracts i LEFT JOIN contracts c ON NOT c.is_entry_level AND c.player_id = i.player_id AND c.start_season = i.start_season
        AND c.end_season = least(i.end_season, 2002) AND c.term_years = i.term_years WHERE i.is_entry_level GROUP BY 1""",
    "decision": """SELECT w.contract_no, any_value(contract_type) AS contract_type, coalesce(any_value(s.same), 1) AS same, CASE WHEN any_value(contract_type) = 'ENTRY LEVEL' THEN CASE WHEN any_value(s.same) > 1 THEN 'ambiguous' WHEN any_value(s.same) = 1 THEN 'incompatible' END
        WHEN any_value(contract_type) = 'ONE_WAY' THEN 'incompatible' WHEN bool_or(cap_hit <> stored_hit) THEN 'cap hit' END AS conflict FROM wanted w LEFT JOIN spans s ON s.contract_no = w.contract_no GROUP BY 1""",
}


@query("""SELECT contract_no, conflict, same = 1 AS known FROM decision""", **_HISTORY)
def reconciliation_decisions(lg):
    return C.decide_history(*_history_input(lg)).select("contract_no", "conflict", F.col("contract_id").isNotNull().alias("known"))


@query("""SELECT CASE WHEN d.contract_type = 'ENTRY LEVEL' THEN 'created' ELSE 'updated' END AS action, count(*) AS contracts FROM decision d WHERE conflict IS NULL GROUP BY 1
    UNION ALL SELECT 'kept', (SELECT count(*) FROM contracts WHERE NOT is_entry_level) - (SELECT count(*) FROM decision WHERE conflict IS NULL AND contract_type <> 'ENTRY LEVEL')""", **_HISTORY)
def reconciled_contracts(lg):
    plan = _history(lg)[0]
    return plan.groupBy(F.col("_action").alias("action")).agg(F.count(F.lit(1)).alias("contracts"))


@query("""SELECT season_start_year, count(*) AS rows, sum(bonus)::BIGINT AS bonus FROM (
      SELECT w.season_start_year, CASE WHEN d.contract_type = 'ENTRY LEVEL' THEN 7 ELSE coalesce(w.stored_bonus, 7) END AS bonus FROM wanted w JOIN decision d ON d.contract_no = w.contract_no WHERE d.conflict IS NULL
      UNION ALL SELECT s.season_start_year, s.signing_bonus_cents FROM contract_seasons s JOIN contracts c ON c.id = s.contract_id WHERE NOT c.is_entry_level
        AND NOT EXISTS (SELECT 1 FROM wanted w JOIN decision d ON d.contract_no = w.contract_no WHERE d.conflict IS NULL AND w.contract_no = s.contract_id AND w.season_start_year = s.season_start_year)) GROUP BY 1""", **_HISTORY)
def reconciled_seasons(lg):
    plan = _history(lg)[1]
    return plan.groupBy("season_start_year").agg(F.count(F.lit(1)).alias("rows"), F.sum("signing_bonus_cents").alias("bonus"))


def _active_plans(lg) -> tuple[DataFrame, DataFrame]:
    """An active snapshot of all contracts over a store of contracts that knows all of it but the entry-level ones."""
    t = lg.tables("contracts", "contract_seasons", "seasons")
    deals = t["contracts"].select(
        F.concat(F.lit("order-"), F.col("id")).alias("slug"), F.lit(0).alias("contract_no"), F.col("id").alias("contract_id"), "player_id", "source_id", "signing_team_id",
        "contract_type", "expiry_status", "total_value_cents", "is_entry_level",
    )
    years = t["contract_seasons"].select("contract_id", "season_start_year", (F.col("season_start_year") - 1990).alias("season_no"), "owning_team_id", "cap_hit_cents", "is_slide")
    caps = t["seasons"].select(F.col("start_year").alias("season_start_year"), "salary_cap_cents")
    rows = staged(years.join(deals, "contract_id").join(caps, "season_start_year").drop("contract_id"), "active")
    stored = C.active_ids(rows).filter("not is_entry_level").select("source_id", "external_id").distinct()
    known = t["contracts"].unionByName(C.number_rows(stored, "id", 2_000_000_000, ["external_id"]), allowMissingColumns=True)
    return C.plan_active(rows, staged(known, "known"), t["contract_seasons"], 3_000_000_000)


_ACTIVE = """SELECT c.player_id, min(s.season_start_year) AS start_season, max(s.season_start_year) AS end_season, count(*) AS term_years, any_value(c.average_value_cents) AS average_value_cents,
    c.is_entry_level, CASE WHEN c.is_entry_level THEN 'created' ELSE 'updated' END AS action FROM contract_seasons s JOIN contracts c ON c.id = s.contract_id GROUP BY c.id, c.player_id, c.is_entry_level"""


@query(f"{_ACTIVE} UNION ALL SELECT player_id, start_season, end_season, term_years, average_value_cents, is_entry_level, 'kept' FROM contracts")
def active_snapshot_contracts(lg):
    """The contract plan of an active snapshot, row by row."""
    plan, _ = _active_plans(lg)
    return plan.select("player_id", "start_season", "end_season", "term_years", "average_value_cents", "is_entry_level", F.col("_action").alias("action"))


@query("""SELECT season_start_year, owning_team_id, cap_hit_cents, is_slide, action FROM contract_seasons, (VALUES ('created'), ('kept')) v(action)""")
def active_snapshot_seasons(lg):
    """The season plan of the same snapshot: its seasons are new, the stored ones stay."""
    _, plan = _active_plans(lg)
    return plan.select("season_start_year", "owning_team_id", "cap_hit_cents", "is_slide", F.col("_action").alias("action"))


# --- identity --------------------------------------------------------------------------------------


def _people(lg) -> DataFrame:
    return lg.raw("customer").select(
        F.col("c_custkey").cast("string").alias("external_id"), F.concat(F.lit("New, "), F.col("c_name")).alias("name"), F.lit("C").alias("position"),
        F.when(F.col("c_acctbal") > 3000, "L").alias("shoots_catches"), F.col("c_custkey").alias("_ord"),
    )


@query("""SELECT CASE WHEN c_acctbal >= 0 THEN 'updated' ELSE 'created' END AS action, count(*) AS players, count(DISTINCT c_custkey) AS names, count(CASE WHEN c_acctbal > 3000 THEN 1 WHEN c_acctbal >= 0 AND c_mktsegment <> 'HOUSEHOLD' THEN 1 END) AS handed
    FROM customer GROUP BY 1""")
def upserted_players(lg):
    """Every customer offered to a store that knows those not in debt."""
    t = lg.tables("players", "player_external_ids")
    found = I.upsert_players(t["players"].filter("active"), t["player_external_ids"], _people(lg), 1, 1_000_000_000)
    return found.players.groupBy(F.col("_action").alias("action")).agg(
        F.count(F.lit(1)).alias("players"), F.count_distinct("first_name").alias("names"), F.count("shoots_catches").alias("handed")
    )


@query("""SELECT c_custkey::VARCHAR AS external_id, CASE WHEN c_acctbal >= 2000 THEN c_custkey END AS player_id, c_acctbal < 2000 AS is_new FROM customer""")
def sister_source_ids(lg):
    """Ids of an unseen source resolved through its sister source."""
    t = lg.tables("players", "player_external_ids")
    found = I.upsert_players(t["players"], t["player_external_ids"], _people(lg), 9, 1_000_000_000, sister=2)
    fresh = F.col("player_id") >= 1_000_000_000
    return found.ids.select("external_id", F.when(~fresh, F.col("player_id")).alias("player_id"), fresh.alias("is_new"))


@query("""SELECT CASE WHEN c_acctbal >= 0 THEN 'updated' ELSE 'created' END AS action, count(*) AS players, count(CASE WHEN c_acctbal >= 2000 THEN 1 END) AS raw_country FROM customer GROUP BY 1""")
def roster_identities(lg):
    t = lg.tables("players", "player_external_ids")
    rows = _people(lg).withColumns({"birth_date": F.lit("1990-01-01").cast("date"), "nationality": F.lit("CAN"), "birth_country": F.lit("can?")})
    found = I.resolve_roster_players(t["players"].filter("active"), t["player_external_ids"], rows, 1, 2, 1_000_000_000)
    created = F.when(F.col("id") >= 1_000_000_000, "created").otherwise("updated")
    return found.players.groupBy(created.alias("action")).agg(F.count(F.lit(1)).alias("players"), F.count_if(F.col("nationality") == "can?").alias("raw_country"))


@query("""SELECT p_partkey::VARCHAR AS slug, CASE WHEN names = 1 THEN 'stored' WHEN names = 0 THEN 'shared' ELSE 'own' END AS kind FROM part JOIN (
    SELECT p_name AS n, count(*) FILTER (WHERE p_retailprice > 990) AS names FROM part GROUP BY 1) ON n = p_name""")
def name_matches(lg):
    """Parts offered by name: names held once match, unheld ones are created once, ambiguous ones stand alone."""
    p = lg.raw("part")
    from rinkline.functions.text import split_name

    parts = split_name(F.col("p_name"))
    stored = p.filter("p_retailprice > 990").select(F.col("p_partkey").alias("id"), F.upper(parts["first"]).alias("first_name"), parts["last"].alias("last_name"))
    from rinkline import schemas

    offered = p.select(F.col("p_partkey").cast("string").alias("slug"), F.col("p_name").alias("name"), F.col("p_partkey").alias("_ord"))
    found = I.resolve_by_name(schemas.conform(stored, "players"), schemas.empty(lg.spark, "player_external_ids"), offered, 3, 1_000_000_000)
    ids = staged(found.ids, "ids")
    shared = ids.groupBy("player_id").agg(F.count(F.lit(1)).alias("n"))
    names = p.select(F.col("p_partkey").cast("string").alias("external_id"), "p_name")
    held = p.filter("p_retailprice > 990").groupBy("p_name").agg(F.count(F.lit(1)).alias("held"))
    kind = F.when(F.col("player_id") < 1_000_000_000, "stored").when(F.coalesce("held", F.lit(0)) == 0, "shared").otherwise("own")
    return ids.join(shared, "player_id").join(names, "external_id").join(held, "p_name", "left").select(F.col("external_id").alias("slug"), kind.alias("kind"))


@query("""SELECT abbreviation, CASE WHEN active THEN 'Club ' || name ELSE name END AS name, CASE WHEN active THEN city ELSE 'Town' END AS city FROM teams""")
def upserted_teams(lg):
    """Placeholders get real names; a placeholder never replaces a real one."""
    t = lg.tables("teams")["teams"]
    stored = t.withColumn("name", F.when(F.col("active"), F.col("abbreviation")).otherwise(F.col("name"))).withColumn("city", F.when(F.col("active"), F.col("city")))
    offered = t.select("abbreviation", F.when(F.col("active"), F.concat(F.lit("Club "), "name")).otherwise(F.col("abbreviation")).alias("name"), F.when(~F.col("active"), "Town").alias("city"))
    return I.upsert_teams(stored, offered, 1_000_000).select("abbreviation", "name", "city")


@query("""SELECT s.id, CASE WHEN s.departed_on IS NULL THEN s.team_id ELSE o.team_id END AS team FROM player_team_stints s LEFT JOIN (
    SELECT player_id, season_start_year, min(team_id) AS team_id FROM player_team_stints GROUP BY 1, 2 HAVING count(DISTINCT team_id) = 1) o ON o.player_id = s.player_id AND o.season_start_year = s.season_start_year""")
def resolved_teams(lg):
    """Team text where the stint is open, else the only team of the season."""
    t = lg.tables("teams", "player_team_stints")
    names = t["teams"].select(F.col("id").alias("team_id"), "name")
    rows = t["player_team_stints"].join(names, "team_id").select(
        "id", "player_id", "season_start_year", F.when(F.col("departed_on").isNull(), F.concat(F.lit("  "), F.upper("name"))).alias("text")
    )
    return I.resolve_teams(rows, I.team_lookup(t["teams"]), "text", "team", t["player_team_stints"]).select("id", "team")


@query("""SELECT user_id, max_by(event_type, (day(ts), event_id)) AS latest, min_by(event_type, event_id) AS earliest FROM events GROUP BY 1""")
def latest_and_first_profiles(lg):
    rows = lg.raw("events").select("user_id", "event_type", F.dayofmonth("ts").alias("season"), F.col("event_id").alias("_ord"))
    latest = I.latest_profiles(rows, "user_id").select("user_id", F.col("event_type").alias("latest"))
    return latest.join(I.first_profiles(rows, "user_id").select("user_id", F.col("event_type").alias("earliest")), "user_id")


@query("""SELECT DISTINCT ON (o_custkey, year(o_orderdate)) o_custkey AS player_id, year(o_orderdate) AS season_start_year, CASE WHEN o_orderstatus = 'F' THEN 'BBB' ELSE 'AAA' END AS team
    FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderstatus <> 'P' ORDER BY o_custkey, year(o_orderdate), o_orderkey DESC""")
def final_season_teams(lg):
    o = F.col("o_orderstatus")
    rows = lg.raw("orders").select(
        F.col("o_custkey").alias("player_id"), F.year("o_orderdate").alias("season"), F.when(F.col("o_orderpriority") == "1-URGENT", 3).otherwise(2).alias("game_type"),
        F.when(o == "F", F.array(F.lit("AAA"), F.lit("BBB"))).when(o == "O", F.array(F.lit("AAA"))).otherwise(F.array().cast("array<string>")).alias("teams"),
        F.col("o_orderkey").alias("_ord"),
    )
    return R.final_teams(rows)


# --- roster status and stints ------------------------------------------------------------------------


def _minor_feed(lg) -> DataFrame:
    """Feed of the customers under 6000; those under 1000 are reported again under another name."""
    p = lg.tables("players")["players"].join(lg.raw("customer").select(F.col("c_custkey").alias("id"), "c_acctbal"), "id")
    seen = p.filter("c_acctbal < 6000").select(
        F.concat(F.lit("m"), "id").alias("external_id"), F.upper(F.concat_ws("  ", "first_name", "last_name")).alias("full_name"), "birth_date", F.col("id").alias("_ord"), "c_acctbal"
    )
    again = seen.filter("c_acctbal < 1000").withColumn("full_name", F.lit("Somebody Else"))
    return seen.unionByName(again).drop("c_acctbal")


def _roster(lg) -> DataFrame:
    t = lg.tables("players", "player_external_ids", "data_sources")
    roster = R.stored_roster(t["players"], t["player_external_ids"], t["data_sources"])
    known = lg.raw("customer").filter("c_acctbal between 3000 and 4000").select(F.col("c_custkey").alias("id"), F.concat(F.lit("m"), "c_custkey").alias("_known"))
    return roster.join(known, "id", "left").withColumn("ahl_external_id", F.col("_known")).drop("_known")


_MATCH = {
    "minor_matches": """SELECT c_custkey AS id FROM customer WHERE c_acctbal >= 1000 AND c_acctbal < 6000"""
}


@query("SELECT id, 'm' || id AS external_id FROM minor_matches", **_MATCH)
def minor_league_matches(lg):
    return R.match_minor_players(_roster(lg), _minor_feed(lg)).select("id", "external_id")


@query("""SELECT 'm' || c_custkey AS external_id FROM customer WHERE c_acctbal < 1000""")
def conflicting_feed_ids(lg):
    return R.conflicting_ids(_minor_feed(lg))


_STATUS = {
    **_MATCH,
    "decisions": """SELECT p.id, CASE WHEN p.id IN (SELECT player_id FROM ltir_overrides WHERE start_date <= DATE '2024-01-15' AND (end_date IS NULL OR end_date >= DATE '2024-01-15')) THEN 'LTIR'
        WHEN x.external_id IS NOT NULL AND k.c_acctbal > 8000 THEN 'ACTIVE' WHEN p.id IN (SELECT id FROM minor_matches) THEN 'MINORS' WHEN x.external_id IS NOT NULL THEN 'UNKNOWN' END AS new_status
        FROM players p JOIN customer k ON k.c_custkey = p.id LEFT JOIN player_external_ids x ON x.player_id = p.id AND x.source_id = 1""",
}


def _decisions(lg) -> DataFrame:
    major = lg.raw("customer").filter("c_acctbal > 8000").select(F.col("c_custkey").cast("string").alias("external_id"))
    roster = _roster(lg)
    ltir = R.on_ltir(lg.tables("ltir_overrides")["ltir_overrides"], date(2024, 1, 15))
    return R.classify(roster, ltir, major, R.match_minor_players(roster, _minor_feed(lg)))


@query("SELECT id, new_status FROM decisions", **_STATUS)
def roster_decisions(lg):
    return _decisions(lg).select("id", "new_status")


@query("""SELECT count(new_status) AS updated, count(*) FILTER (WHERE new_status = 'ACTIVE') AS active, count(*) FILTER (WHERE new_status = 'MINORS') AS minors, count(*) FILTER (WHERE new_status = 'LTIR') AS ltir,
    count(*) FILTER (WHERE new_status = 'UNKNOWN') AS unknown, count(*) FILTER (WHERE new_status IS NULL) AS preserved FROM decisions""", **_STATUS)
def roster_sync_summary(lg):
    return R.sync_summary(_decisions(lg))


@query("""SELECT id, nhl_external_id, full_name FROM (SELECT p.id, max(x.external_id) FILTER (WHERE x.source_id = 1) AS nhl_external_id, any_value(p.first_name || ' ' || p.last_name) AS full_name
    FROM players p LEFT JOIN player_external_ids x ON x.player_id = p.id GROUP BY 1)""")
def stored_roster_ids(lg):
    t = lg.tables("players", "player_external_ids", "data_sources")
    return R.stored_roster(t["players"], t["player_external_ids"], t["data_sources"]).select("id", "nhl_external_id", "full_name")


STINTS = ["skater_season_stats", "goalie_season_stats", "skater_advanced_season_stats", "goalie_advanced_season_stats", "data_sources", "player_team_stints"]
_STINT = {
    "candidates": """SELECT player_id, season_start_year, team_id, games_played, 0 AS pri FROM skater_season_stats WHERE game_type = 2 AND stat_scope = 'TEAM' AND source_id = 1
        UNION ALL SELECT player_id, season_start_year, team_id, games_played, 0 FROM goalie_season_stats WHERE game_type = 2 AND stat_scope = 'TEAM' AND source_id = 1
        UNION ALL SELECT player_id, season_start_year, team_id, games_played, 1 FROM skater_advanced_season_stats WHERE situation = 'all' AND stat_scope = 'TEAM'
        UNION ALL SELECT player_id, season_start_year, team_id, games_played, 1 FROM goalie_advanced_season_stats WHERE situation = 'all' AND stat_scope = 'TEAM'""",
    "canonical": """SELECT DISTINCT ON (player_id, season_start_year) player_id, season_start_year, team_id FROM candidates
        ORDER BY player_id, season_start_year, pri, games_played DESC NULLS LAST, team_id""",
    "missing": "SELECT * FROM canonical WHERE (player_id, season_start_year) NOT IN (SELECT (player_id, season_start_year) FROM player_team_stints WHERE departed_on IS NULL)",
}


@query("SELECT player_id, season_start_year, team_id FROM canonical", **_STINT)
def canonical_season_teams(lg):
    return R.canonical_teams(R.stint_candidates(lg.tables(*STINTS)))


@query("SELECT player_id, season_start_year, team_id FROM missing", **_STINT)
def missing_stints(lg):
    t = lg.tables(*STINTS)
    return R.missing_stints(R.canonical_teams(R.stint_candidates(t)), t["player_team_stints"].filter("departed_on is null"))


@query("SELECT (SELECT count(*) FROM canonical) AS canonical_assignments, (SELECT count(*) FROM missing) AS missing_assignments", **_STINT)
def stint_repair_counts(lg):
    t = lg.tables(*STINTS)
    canonical = staged(R.canonical_teams(R.stint_candidates(t)), "canonical")
    return R.stint_counts(canonical, R.missing_stints(canonical, t["player_team_stints"].filter("departed_on is null")))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25) AS large FROM lineitem""")
def flagged_members(lg):
    big = lg.raw("part").filter("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    rows = lg.raw("lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return keyed.flag_members(rows, big, ["l_partkey"], "large")


