"""Versioned tables, gap filling and guarded feeds: stores that are written, written again and read."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rinkline import schemas
from rinkline.operators import merge as M
from rinkline.operators import versions as V
from rinkline.plans import feed_store, gap_fill, ingest
from rinkline.session import new_path, staged
from rinkline.workload import contract_queries as CQ
from rinkline.workload.registry import query

# --- versioned merges -----------------------------------------------------------------------


@query("""SELECT o_orderkey AS nhl_game_id, year(o_orderdate) AS season_start_year, CASE WHEN o_orderstatus = 'F' AND year(o_orderdate) >= 1996 THEN 'FINAL' ELSE 'OPEN' END AS game_state,
    o_orderpriority AS venue FROM orders WHERE o_orderstatus = 'F' OR (o_orderstatus = 'O' AND year(o_orderdate) >= 1996)""")
def versioned_schedule_merge(lg):
    """Games merged season by season into a versioned table, twice: known games keep their venue, seasons before 1996 aren't touched."""
    o = lg.raw("orders").select(F.col("o_orderkey").alias("nhl_game_id"), F.year("o_orderdate").alias("season_start_year"), F.col("o_orderpriority").alias("venue"), F.col("o_orderstatus").alias("_status"))
    path, state = new_path(lg.spark, "games"), lambda s: F.lit(s).alias("game_state")
    V.create(schemas.conform(o.filter("_status = 'F'").select("*", state("OPEN")), "games"), path, "season_start_year")
    late = o.filter("season_start_year >= 1996")
    again = late.filter("_status = 'F'").select("*", state("FINAL")).withColumn("venue", F.lit("moved"))
    incoming = schemas.conform(again.unionByName(late.filter("_status = 'O'").select("*", state("OPEN"))), "games")
    for _ in range(2):
        V.merge(incoming, path, schemas.TABLES["games"], "season_start_year", M.merge_schedule)
    return V.read(lg.spark, path, schemas.TABLES["games"]).select("nhl_game_id", "season_start_year", "game_state", "venue")


def _merged_stats(lg) -> tuple[str, V.Merged]:
    rows = lg.tables("skater_season_stats")["skater_season_stats"]
    path = new_path(lg.spark, "stats")
    V.create(rows.filter("season_start_year < 2000"), path, "season_start_year")
    incoming = rows.filter("season_start_year >= 1999").withColumn("goals", F.col("goals") + 100)
    merged = V.merge(incoming, path, schemas.TABLES["skater_season_stats"], "season_start_year", lambda e, n: M.merge_stats(e, n, "skater", advanced=False))
    return path, merged


@query("SELECT id, season_start_year, goals + CASE WHEN season_start_year >= 1999 THEN 100 ELSE 0 END AS goals FROM skater_season_stats")
def versioned_stat_merge(lg):
    path, _ = _merged_stats(lg)
    return V.read(lg.spark, path, schemas.TABLES["skater_season_stats"]).select("id", "season_start_year", "goals")


@query("""SELECT 'stats' AS job_name, 'succeeded' AS status, count(*) AS records_read, count(*) FILTER (WHERE season_start_year > 1999) AS records_created,
    count(*) FILTER (WHERE season_start_year = 1999) AS records_updated, 0 AS records_skipped FROM skater_season_stats WHERE season_start_year >= 1999""")
def versioned_merge_ledger(lg):
    """The ledger row of that merge, from counts that were observed while it was written."""
    _, merged = _merged_stats(lg)
    read = merged.counts["records_created"] + merged.counts["records_updated"]
    row = M.run_record(lg.spark, 1, 1, "stats", "succeeded", {**merged.counts, "records_read": read})
    return row.select("job_name", "status", "records_read", "records_created", "records_updated", "records_skipped")


# --- gap filling ---------------------------------------------------------------------------------

_GAPS = {
    "gaps": """SELECT p.player_id, p.season_start_year FROM played p WHERE player_id IN (SELECT id FROM players) AND (player_id, season_start_year) NOT IN (
        SELECT (c.player_id, s.season_start_year) FROM contracts c JOIN contract_seasons s ON s.contract_id = c.id WHERE c.is_entry_level)""",
    "fillable": """SELECT c.player_id, s.contract_id, s.season_start_year, s.cap_hit_cents FROM contract_seasons s JOIN contracts c ON c.id = s.contract_id JOIN customer k ON k.c_custkey = c.player_id
        JOIN gaps g ON g.player_id = c.player_id AND g.season_start_year = s.season_start_year WHERE c.contract_type = 'STANDARD' AND k.c_acctbal >= 0 AND s.season_start_year IN (SELECT start_year FROM seasons)""",
    "first_run": """SELECT g.player_id, CASE WHEN any_value(k.c_acctbal) < 0 THEN 'no_nhl_id' WHEN any_value(d.n) IS NULL THEN 'not_found' WHEN any_value(f.n) IS NULL THEN 'no_matching_contracts' ELSE 'filled' END AS status,
        coalesce(any_value(f.n), 0) AS seasons FROM gaps g JOIN customer k ON k.c_custkey = g.player_id
        LEFT JOIN (SELECT player_id, count(*) AS n FROM contracts WHERE contract_type = 'STANDARD' GROUP BY 1) d ON d.player_id = g.player_id
        LEFT JOIN (SELECT player_id, count(*) AS n FROM fillable GROUP BY 1) f ON f.player_id = g.player_id GROUP BY 1""",
}
_NEEDED = ["players", "player_external_ids", "data_sources", "seasons", "teams", "player_team_stints", "skater_season_stats", "goalie_season_stats", "contracts", "contract_seasons"]


def _gap_store(lg) -> tuple[dict[str, DataFrame], DataFrame, str]:
    """A store that knows the entry-level contracts only, and the players' saved pages."""
    t = lg.with_stored_facts().tables(*_NEEDED)
    path = new_path(lg.spark, "gaps")
    own = t["contracts"].filter("is_entry_level").withColumn("term_years", F.lit(99))
    years = t["contract_seasons"].join(own.select(F.col("id").alias("contract_id")), "contract_id", "left_semi").select(*t["contract_seasons"].columns)
    gap_fill.create_store({"contracts": own, "contract_seasons": years}, path)
    pages = CQ.contract_pages(lg).withColumn("url", F.concat(F.lit("https://pages/players/p-"), F.col("key")))
    return t, staged(pages, "gap-pages"), path


def _runs(lg, n: int) -> tuple[str, list[gap_fill.Filled]]:
    t, pages, path = _gap_store(lg)
    return path, [gap_fill.fill(t, pages, path, "capspace", 4, None, None) for _ in range(n)]


@query("""SELECT player_id, season_start_year, cap_hit_cents FROM fillable UNION ALL
    SELECT c.player_id, s.season_start_year, s.cap_hit_cents FROM contract_seasons s JOIN contracts c ON c.id = s.contract_id WHERE c.is_entry_level""", **_GAPS)
def gap_fill_seasons(lg):
    """Contract seasons after the gaps were filled from pages."""
    path, _ = _runs(lg, 1)
    t = gap_fill.stored(lg.spark, path)
    owner = t["contracts"].select(F.col("id").alias("contract_id"), "player_id")
    return t["contract_seasons"].join(owner, "contract_id").select("player_id", "season_start_year", "cap_hit_cents")


@query("""SELECT 1 AS run, player_id, status, seasons FROM first_run UNION ALL SELECT 2, player_id, status, seasons FROM first_run WHERE status = 'not_found'""", **_GAPS)
def gap_fill_outcomes(lg):
    """What became of every candidate in two runs: the second one only tries those again whose page wasn't found."""
    path, _ = _runs(lg, 2)
    return gap_fill.stored(lg.spark, path)["gap_outcomes"].select("run", "player_id", "status", "seasons")


@query("""SELECT 1 AS run, count(DISTINCT contract_id) AS contracts_created, count(*) AS seasons_created FROM fillable UNION ALL SELECT 2, 0, 0""", **_GAPS)
def gap_fill_counts(lg):
    """Created contracts and seasons of two runs, as counted while they were written; the second creates nothing."""
    _, runs = _runs(lg, 2)
    rows = [(r.run, r.contracts["records_created"], r.seasons["records_created"]) for r in runs]
    return lg.spark.createDataFrame(rows, "run int, contracts_created long, seasons_created long")


@query("""SELECT player_id, status, seasons FROM first_run""", **_GAPS)
def gap_fill_dry_run(lg):
    """The outcomes that a first run would have; nothing is written to the store."""
    t, pages, path = _gap_store(lg)
    return gap_fill.plan(t, pages, path, 1, "capspace", 4, None, None).outcomes.select("player_id", "status", "seasons")


# --- guarded feeds ---------------------------------------------------------------------------------

_ROSTERS = ["players", "player_external_ids", "data_sources", "ltir_overrides"]
_DAY, _NEXT = date(2024, 1, 15), date(2024, 1, 16)


def _offered(lg, refused: bool) -> str:
    """Both roster feeds of one day; if asked for, the next day's minor feed, which holds conflicting ids, is refused."""
    path = new_path(lg.spark, "feeds")
    major = lg.raw("customer").filter("c_acctbal > 8000").select(F.col("c_custkey").cast("string").alias("external_id"))
    minor = CQ._minor_feed(lg).select("external_id", "full_name", "birth_date", F.col("_ord").cast("int").alias("_ord"))
    none = minor.limit(0)
    feed_store.offer(major, none, path, "major", _DAY, 1)
    feed_store.offer(minor, none, path, "minor", _DAY, 1)
    if refused:
        feed_store.offer(major, none, path, "major", _NEXT, 1)
        feed_store.offer(minor, CQ.R.conflicting_ids(minor), path, "minor", _NEXT, 1)
    return path


@query("SELECT p.id, coalesce(d.new_status, p.roster_status) AS roster_status FROM players p JOIN decisions d ON d.id = p.id", **CQ._STATUS)
def synced_statuses(lg):
    """Players after a status sync from two good feeds of one day."""
    players, _, _ = feed_store.sync_statuses(lg.tables(*_ROSTERS), _offered(lg, refused=False), _DAY)
    return players.select("id", "roster_status")


@query("""SELECT 'major' AS feed, 'accepted' AS state, DATE '2024-01-16'::VARCHAR AS good, (SELECT count(*) FROM customer WHERE c_acctbal > 8000) AS records, CAST(NULL AS VARCHAR) AS problem
    UNION ALL SELECT 'minor', 'refused', '2024-01-15', (SELECT count(*) FROM customer WHERE c_acctbal < 6000) + (SELECT count(*) FROM customer WHERE c_acctbal < 1000), 'violations'""")
def refused_feed_states(lg):
    """The state of each feed after a refused one, whose last good snapshot stays; a sync of the two would be refused."""
    path = _offered(lg, refused=True)
    problems = feed_store.feed_errors(lg.spark, path, ["major", "minor"], _NEXT)
    return feed_store.states(lg.spark, path).join(problems, "feed", "left").select("feed", "state", "good", "records", "problem")


@query("""SELECT 1 AS cached, (SELECT count(DISTINCT player_id) FROM player_external_ids WHERE source_id = 3) AS players, count(DISTINCT c.id) AS contracts, count(*) AS contract_seasons
    FROM contracts c JOIN contract_seasons s ON s.contract_id = c.id WHERE c.source_id = 3""")
def retained_snapshot(lg):
    """A refused contract feed: the counts of the last good snapshot, nothing is planned."""
    t = lg.tables("player_external_ids", "contracts", "contract_seasons")
    short = t["contracts"].filter("end_season < start_season or term_years < 6")
    plans, counts = ingest.refresh_active(t, short, short, short, 3)
    assert plans is None
    return lg.spark.createDataFrame([counts], "cached long, players long, contracts long, contract_seasons long")
