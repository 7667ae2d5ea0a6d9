"""Branches that the order tables don't reach, and gap filling and feeds on small leagues."""

import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from rinkline import schemas
from rinkline.operators import merge as M
from rinkline.operators import quality as Q
from rinkline.operators import versions as V
from rinkline.plans import contracts as C
from rinkline.plans import feed_store as FS
from rinkline.plans import gap_fill as G
from rinkline.plans import model as MO
from rinkline.plans import roster as R


def test_every_page_problem(spark):
    jobs = {
        "changed": [(1, 5, 5, 0), (2, 6, 1, 0)], "too long": [(1, 200, 101, 0)], "no id": [(1, 3, 3, 1)], "empty early": [(1, 9, 3, 0), (2, 9, 0, 0)], "too many": [(1, 3, 4, 0)],
        "too few": [(1, 3, 2, 0)], "full without total": [(1, None, 100, 0)], "nothing": [(1, None, 0, 0)], "good": [(1, 150, 100, 0), (2, 150, 50, 0)], "good without total": [(1, None, 100, 0), (2, None, 7, 0)],
    }
    pages = spark.createDataFrame([(j, *p) for j, ps in jobs.items() for p in ps], "job string, page int, total int, size int, no_id int")
    assert {r.job: r.problem for r in Q.page_problems(pages, ["job"], 100).collect()} == {
        "changed": "total changed between pages", "too long": "page exceeds requested limit", "no id": "row is missing its id", "empty early": "empty page before total was reached",
        "too many": "received more rows than total", "too few": "fewer rows than total", "full without total": "last page is full and no total is known", "nothing": "no rows",
    }


def test_quality_verdicts(spark):
    report = spark.createDataFrame([(10, 8, 0.2), (10, 10, 0.0), (100, 70, 0.3)], "records_read int, records_valid int, duplicate_ratio double")
    assert [r.violation for r in Q.quality_verdict(report, 9, 0.25).collect()] == ["row count", None, "duplicate ratio"]
    with pytest.raises(Q.QualityError):
        Q.assert_quality(report.limit(1), 9, 0.25)
    with pytest.raises(Q.QualityError):
        Q.assert_min_rows(report, 4, "rows")
    with pytest.raises(Q.QualityError):
        Q.assert_success(report, F.col("records_read") > 50)


def test_profile_statuses(spark):
    outcomes = ["found", "no_contracts", "no_nhl_id", "not_found", "failed", "parse_failed"]
    df = spark.createDataFrame([(o, c, f) for o in outcomes for c in (True, False) for f in (True, False)], "outcome string, covers boolean, fallback boolean")
    got = {tuple(r[:3]): r[3] for r in df.select("*", C.profile_status(F.col("outcome"), F.col("covers"), F.col("fallback"))).collect()}
    for (outcome, covers, fallback), status in got.items():
        want = "succeeded" if outcome == "found" else outcome
        if fallback and (outcome == "no_contracts" or (outcome == "found" and not covers)):
            want = "no_matching_contracts"
        assert status == want


def test_incomplete_feeds_keep_statuses(spark):
    roster = spark.createDataFrame([(1, "ACTIVE", "a"), (2, "ACTIVE", "b"), (3, "ACTIVE", "c")], "id int, roster_status string, nhl_external_id string")
    ltir, major, minor = (spark.createDataFrame(rows, kind) for rows, kind in (([], "player_id int"), ([("a",)], "external_id string"), ([(2,)], "id int")))
    got = lambda *complete: {r.id: r.new_status for r in R.classify(roster, ltir, major, minor, *complete).collect()}
    assert got(True, True) == {1: "ACTIVE", 2: "MINORS", 3: "UNKNOWN"}
    assert got(True, False) == {1: "ACTIVE", 2: "MINORS", 3: None} and got(False, True) == {1: "ACTIVE", 2: None, 3: None}


def test_metric_gate_branches(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "split string, metric string, value double")
    was = rows(("test", "mae", 1.0), ("test", "rmse", 1.0), ("test", "r2", 0.5), ("train", "mae", 1.0))
    now = rows(("test", "mae", 1.3), ("test", "rmse", 1.2), ("test", "r2", 0.4))
    assert {(r.split, r.metric) for r in MO.metric_regressions(now, was).collect()} == {("test", "mae"), ("test", "r2"), ("train", "mae")}
    broken = rows(("test", "mae", float("nan")), ("test", "rmse", float("inf")), ("test", "r2", 0.9), ("train", "mae", 0.1))
    assert {r.metric for r in MO.metric_regressions(broken, was).collect()} == {"mae", "rmse"}
    with pytest.raises(Q.QualityError):
        MO.metric_regressions(now, was, {"mae": -1.0, "rmse": 0.0, "r2": 0.0})


# --- gap filling -------------------------------------------------------------------------------------


def page(nhl_id, contracts):
    return f'<script id="__NEXT_DATA__">{json.dumps({"props": {"pageProps": {"player": {"nhlId": nhl_id, "contracts": contracts}}}})}</script>'


def deal(name, *years, hit="$1,000"):
    return {"id": name, "type": "Standard", "term": len(years), "details": [{"season": f"{y}-{(y + 1) % 100:02d}", "capHit": hit} for y in years]}


@pytest.fixture
def league(spark, tmp_path):
    """Six players who all played 2020 and 2021; player 6 has a contract for both, player 5 has no id."""
    make = lambda name, rows, columns: schemas.conform(spark.createDataFrame(rows, columns), name)
    t = {
        "players": make("players", [(i, "Some", f"Body{i}") for i in range(1, 7)], "id long, first_name string, last_name string"),
        "data_sources": make("data_sources", [(1, "nhl"), (4, "capspace")], "id long, code string"),
        "player_external_ids": make("player_external_ids", [(i, i, 1, f"n{i}") for i in (1, 2, 3, 4, 6)], "id long, player_id long, source_id long, external_id string"),
        "seasons": make("seasons", [(y, y + 1, 10_000_000) for y in range(2015, 2025)], "start_year int, end_year int, salary_cap_cents long"),
        "teams": make("teams", [(1, "AAA", "City", "Team")], "id long, abbreviation string, city string, name string"),
        "player_team_stints": make("player_team_stints", [(1, 1, 2020, 1)], "id long, player_id long, season_start_year int, team_id long"),
        "skater_season_stats": make("skater_season_stats", [(i * 10 + y, i, y, 2, 50, "TOTAL") for i in range(1, 7) for y in (2020, 2021)], "id long, player_id long, season_start_year int, game_type int, games_played int, stat_scope string"),
        "goalie_season_stats": make("goalie_season_stats", [], "id long"),
        "contracts": make("contracts", [(1, 6, 4, "taken", 2020, 2021, 2)], "id long, player_id long, source_id long, external_id string, start_season int, end_season int, term_years int"),
        "contract_seasons": make("contract_seasons", [(1, 1, 2020, 5), (2, 1, 2021, 5)], "id long, contract_id long, season_start_year int, cap_hit_cents long"),
    }
    path = str(tmp_path / "store")
    G.create_store(t, path)
    pages = [
        ("p1", 1, page("n1", [deal("one", 2020), deal("old", 2017, 2018)])), ("p2", 2, page("n2", [])), ("p3", 3, page("n3", [deal("taken", 2020, 2021)])),
        ("p4", 4, page("n4", [{"details": [{"season": "2020-21", "capHit": "-1"}]}])), ("p5", 5, page("n5", [deal("five", 2020)])), ("p1b", 1, page("other", [deal("wrong", 2021)])),
    ]
    return t, spark.createDataFrame([(k, i, f"https://x/p-{i}", h) for k, i, h in pages], "key string, player_id long, url string, html string"), path


def outcomes(spark, path, run):
    return {r.player_id: (r.status, r.stage, r.seasons, r.missing) for r in G.stored(spark, path)["gap_outcomes"].where(F.col("run") == run).collect()}


def test_gaps_are_filled_once_and_every_candidate_has_an_outcome(spark, league):
    t, pages, path = league
    planned = G.plan(t, pages, path, 1, "capspace", 4, 2020, 2021)
    dry = {r.player_id: r.status for r in planned.outcomes.collect()}
    assert V.newest(spark, f"{path}/gap_outcomes") == 0 and V.newest(spark, f"{path}/contracts") == 1
    first = G.fill(t, pages, path, "capspace", 4, 2020, 2021)
    assert first.contracts["records_created"] == 1 and first.seasons["records_created"] == 1
    found = outcomes(spark, path, 1)
    assert found == {
        1: ("filled", "written", 1, "2021"), 2: ("no_contracts", "read", 0, "2020,2021"), 3: ("conflict", "reconciled", 0, "2020,2021"),
        4: ("failed", "read", 0, "2020,2021"), 5: ("no_nhl_id", "candidate", 0, "2020,2021"),
    }
    assert dry == {i: v[0] for i, v in found.items()}
    second = G.fill(t, pages, path, "capspace", 4, 2020, 2021)
    assert second.run == 2 and set(outcomes(spark, path, 2)) == {4}
    assert second.contracts["records_created"] == second.seasons["records_created"] == 0
    seasons = G.stored(spark, path)["contract_seasons"]
    assert sorted((r.contract_id, r.season_start_year, r.cap_hit_cents, r.owning_team_id) for r in seasons.collect()) == [(1, 2020, 5, None), (1, 2021, 5, None), (2, 2020, 100000, 1)]


def test_a_run_that_stopped_halfway_is_taken_up(spark, league):
    t, pages, path = league
    planned = G.plan(t, pages, path, 1, "capspace", 4, 2020, 2021)
    whole = lambda old, new: G._one_part(C.fill_contracts(old, new.drop("_one")))
    V.merge(G._one_part(planned.contracts), f"{path}/contracts", schemas.TABLES["contracts"], "_one", whole)
    done = G.fill(t, pages, path, "capspace", 4, 2020, 2021)
    assert done.contracts["records_created"] == 0 and done.contracts["records_updated"] == 1 and done.seasons["records_created"] == 1
    assert outcomes(spark, path, 1)[1][0] == "filled"


# --- guarded feeds --------------------------------------------------------------------------------------


def test_a_refused_snapshot_leaves_the_last_good_one(spark, tmp_path):
    path, schema = str(tmp_path / "feeds"), "external_id string"
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], schema)
    none, bad = rows(), rows("bad")
    with pytest.raises(Q.QualityError):
        FS.last_good(spark, path, "major", schema)
    assert FS.offer(rows(), bad, path, "minor", date(2024, 1, 1)) == ("refused", "violations", 0)
    with pytest.raises(Q.QualityError):
        FS.last_good(spark, path, "minor", schema)
    assert FS.offer(rows("a", "b"), none, path, "major", date(2024, 1, 1), 2) == ("accepted", None, 2)
    assert FS.offer(rows("c"), none, path, "major", date(2024, 1, 2), 2) == ("refused", "1 of at least 2 rows", 2)
    assert sorted(r[0] for r in FS.last_good(spark, path, "major", schema).collect()) == ["a", "b"]
    problems = lambda day: {r.feed: r.problem for r in FS.feed_errors(spark, path, ["major", "minor", "third"], day).collect()}
    assert problems(date(2024, 1, 2)) == {"major": "1 of at least 2 rows", "minor": "violations", "third": "never offered"}
    FS.offer(rows("d", "e"), none, path, "major", date(2024, 1, 3), 2)
    FS.offer(rows("f"), none, path, "minor", date(2024, 1, 2))
    assert problems(date(2024, 1, 3)) == {"minor": "another day's", "third": "never offered"}
    with pytest.raises(Q.QualityError, match="minor"):
        FS.sync_statuses({"players": rows()}, path, date(2024, 1, 3))


def test_ledger_row_of_a_merge(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "id long, season int, v int"
    V.create(spark.createDataFrame([(1, 2020, 1), (2, 2021, 1)], schema), path, "season")
    merged = V.merge(spark.createDataFrame([(2, 2021, 5), (3, 2021, 5)], schema), path, schema, "season", lambda e, n: M.merge_plan(e, n, ["id"], {"v": "new"}))
    row = M.run_record(spark, 7, 1, "job", "succeeded", merged.counts).first()
    assert (row.records_created, row.records_updated) == (1, 1)
