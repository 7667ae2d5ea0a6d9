"""Read views on the league with answers worked out by hand."""

from datetime import date, datetime

import pytest
from golden import (
    ADVANCED,
    ASH,
    BASIC,
    ELM,
    FIR,
    GON,
    MODEL_COLUMNS,
    MODELS,
    NIL,
    NOR,
    OAK,
    PLAYERS,
    PREDICTION_COLUMNS,
    PREDICTIONS,
    QUILL,
    REED,
    STINTS,
    SUD,
    YEAR,
    YEW,
    advanced,
    basic,
    players,
    stints,
    table,
    tables,
)
from pyspark.sql import functions as F

from rinkline.operators import quality as Q
from rinkline.plans import contracts as C
from rinkline.plans import stats, views
from rinkline.plans.value import player_season_summary
from rinkline.session import staged


@pytest.fixture(scope="module")
def league(spark):
    return tables(spark)


@pytest.fixture(scope="module")
def summary(league):
    return staged(player_season_summary(league, YEAR), "golden")


def one(df, player):
    return df.filter(F.col("id") == player).first()


def test_lines_of_traded_players(summary):
    quill, reed = one(summary, QUILL), one(summary, REED)
    assert (quill.games_played, quill.goals, quill.points, quill.shots) == (50, 15, 37, 120)
    assert quill.on_ice_expected_goals_pct == pytest.approx(0.53)
    assert (reed.games_played, reed.goals, reed.points, reed.shots) == (25, 3, 4, 23)
    assert reed.on_ice_expected_goals_pct == pytest.approx(0.43)  # (2400 + 4050) / 15000


def test_value_over_replacement(summary):
    quill = one(summary, QUILL)
    assert quill.gs60_above_replacement == pytest.approx(2.04)
    assert quill.hockey_value == pytest.approx(34.0)
    assert one(summary, ELM).hockey_value == pytest.approx(61.6)  # 2.64 * 23.333...
    assert one(summary, REED).hockey_value == one(summary, FIR).hockey_value == pytest.approx(0.0, abs=1e-9)
    assert (quill.projected_hockey_value, quill.model_version) == (33.25, "heron-1")
    yew = one(summary, YEW)
    assert yew.hockey_value is None and yew.model_version is None and yew.games_played == 14


def test_team_choice_and_missing_data(summary):
    assert one(summary, QUILL).team_id == one(summary, REED).team_id == SUD
    nil = one(summary, NIL)
    assert nil.team_id is None and nil.games_played is None and nil.age is None


def test_nineteen_games_do_not_set_the_level(spark, league):
    extra = 29
    t = dict(league)
    t["players"] = players(spark, [*PLAYERS, (extra, "Kit", "Yarrow", None, "C", None, None, True, "ACTIVE")])
    t["player_team_stints"] = stints(spark, [*STINTS, (10, extra, YEAR, NOR, date(2024, 3, 1), None)])
    t["skater_season_stats"] = basic(spark, [*BASIC, (extra, None, "TOTAL", 19, 0, 0, 0, 0, 0, 0, 0, 0, 3)])
    t["skater_advanced_season_stats"] = advanced(spark, [*ADVANCED, (extra, None, "TOTAL", 19, 1900.0, 60, -9.0, 0.1, 0.3, 0, 0, 0, 0, 0)])
    rows = player_season_summary(t, YEAR)
    assert one(rows, QUILL).hockey_value == pytest.approx(34.0)
    assert one(rows, extra).hockey_value == pytest.approx((-9.0 * 3600 / 1900 - 0.36) * 1900 / 3600)


def test_measured_zero_is_not_missing(spark):
    line = stats.skater_lines(basic(spark, [(OAK, None, "TOTAL", 20, 0, 0, 0, 0, 0, 0, 0, 0, 0)])).first()
    assert line.goals == 0 and line.points == 0 and line.shooting_percentage is None


def test_ties_and_nulls_across_pages(spark, league):
    level = [(*r[:6], 30, *r[7:]) if r[0] in (ASH, FIR) else r for r in BASIC]
    rows = staged(player_season_summary({**league, "skater_season_stats": basic(spark, level)}, YEAR), "tied")

    def order(direction):
        ids = []
        for page in (1, 2, 3):
            found, total = views.list_players(rows, views.PlayerQuery(season=YEAR, sort="points", order=direction, page=page, page_size=3))
            assert (total.first().total_items, total.first().total_pages) == (7, 3)
            ids += [r.id for r in found.collect()]
        return ids

    assert order("desc") == [ELM, QUILL, ASH, FIR, OAK, REED, YEW]
    assert order("asc") == [REED, OAK, ASH, FIR, QUILL, ELM, YEW]


def test_player_filters(summary):
    ids = lambda **q: {r.id for r in views.filtered(summary, views.PlayerQuery(season=YEAR, **q)).collect()}
    assert ids(team="sud") == {QUILL, REED, ASH, ELM}
    assert ids(position="RW") == {ASH, OAK}
    assert ids(roster_status="MINORS") == {YEW}
    assert ids(search=" REED ") == {REED}
    assert ids(search="%' OR '1'='1") == set()


def test_goalie_bundle(summary, league):
    bundle = views.player_stats(summary, league).filter(F.col("player_id") == YEW).first()
    assert bundle.traditional is None and bundle.advanced is None
    assert bundle.goalie.goals_saved_above_expected == 4.5
    assert bundle.goalie.save_percentage == pytest.approx(384 / 420)
    assert bundle.goalie.goals_against_average == pytest.approx(36 / 14)
    quill = views.player_stats(summary, league).filter(F.col("player_id") == QUILL).first()
    assert quill.goalie is None and quill.advanced.ice_time_seconds == 60000


def test_value_record_hours(summary):
    record = views.value_records(summary).filter(F.col("player_id") == QUILL).first()
    assert record.toi_hours == pytest.approx(16.6667, abs=1e-4)


def test_team_views(summary, league):
    counts = views.team_details(league).filter(F.col("id") == SUD).first()
    assert (counts.ACTIVE, counts.LTIR, counts.MINORS, counts.UNKNOWN) == (3, 1, 0, 0)
    assert [r.id for r in views.team_roster(summary, YEAR, SUD, "ACTIVE").collect()] == [QUILL, REED, ELM]  # by full name
    assert [r.id for r in views.team_directory(league["teams"]).collect()] == [SUD, NOR]  # Herons, Lanterns


def test_cap_sheets(league):
    sheets = {r.team_id: r for r in C.team_caps(league, YEAR).collect()}
    sud, nor = sheets[SUD], sheets[NOR]
    assert (sud.active_roster_cap_cents, sud.ltir_cap_cents, sud.minors_cap_cents, sud.total_commitments_cents) == (620_000_000, 310_000_000, 0, 930_000_000)
    assert (nor.minors_cap_cents, nor.total_commitments_cents) == (0, 0)  # 900,000 lies below the relief of 2023
    assert nor.cap_space_cents == nor.salary_cap_cents == 8_350_000_000


def test_overview_and_leaders(summary):
    totals = views.league_totals(summary).first()
    assert (totals.players, totals.goals) == (7, 65)
    first = views.league_leaders(summary).filter("metric = 'hockey_value' and place = 1").first()
    assert first.id == ELM
    leaders = [r.id for r in views.value_leaders(summary, YEAR, 10, team="sud").collect()]
    assert leaders[:2] == [ELM, QUILL] and not {FIR, OAK} & set(leaders)


def test_inactive_models_and_payloads_without_value(spark, league):
    t = dict(league)
    t["model_versions"] = table(spark, "model_versions", MODEL_COLUMNS, [*MODELS, (6, "skater_value", "heron-2", False, datetime(2024, 2, 1))])
    more = [(2, 6, QUILL, 2024, "forward", '{"predicted_hockey_value": 77}', datetime(2024, 2, 2)), (3, 5, REED, 2024, "forward", "{}", datetime(2024, 2, 2))]
    t["predictions"] = table(spark, "predictions", PREDICTION_COLUMNS, [*PREDICTIONS, *more])
    rows = player_season_summary(t, YEAR)
    assert one(rows, QUILL).projected_hockey_value == 33.25
    assert one(rows, REED).projected_hockey_value is None


def test_contract_views(league):
    deal = C.player_contracts(league, YEAR, [QUILL]).first()
    assert deal.id == 31 and [s.season for s in deal.seasons] == [2023, 2024] and deal.signing_team.abbreviation == "NOR"
    ledger = C.team_ledger(league["contracts"], league["contract_seasons"], YEAR, SUD)
    assert {(r.player_id, r.contract_id) for r in ledger.collect()} == {(QUILL, 31), (ASH, 32)}


def test_comparison(summary, league):
    rows = views.compare(summary, league, [ELM, QUILL], YEAR).collect()
    assert [r.player_id for r in rows] == [ELM, QUILL]
    assert rows[0].contract is None and rows[1].contract.id == 31 and rows[1].player.team.id == SUD
    for bad in ("24", "24,24", "x,y", "5,4,3,2,1", "0,24"):
        with pytest.raises(views.RequestError):
            views.comparison_ids(bad)


def test_search_and_career(summary, league):
    assert {r.id for r in views.search_players(league, "o", 9).collect()} == {REED, OAK}
    assert views.search_players(league, "o", 1).count() == 1
    assert [r.id for r in views.search_teams(league["teams"], "gon", 5).collect()] == [GON]
    history = views.career(summary, league).filter(F.col("player_id") == QUILL).collect()
    assert [(r.season, r.points) for r in history] == [(YEAR, 37)]


def test_seasons(league):
    seasons = league["seasons"]
    assert views.current_season(seasons, date(2024, 6, 30)) == 2023
    assert views.current_season(seasons, date(2024, 7, 1)) == 2024
    with pytest.raises(views.RequestError):
        views.require_season(seasons, 2024, date(2024, 6, 30))


def test_constraints_hold(league):
    report = Q.constraint_report({k: v for k, v in league.items() if k not in ("skater_season_stats", "goalie_season_stats")})
    assert report.filter("violations > 0").count() == 0


def test_coverage(league):
    row = C.coverage(league).first()
    assert (row.total_player_seasons, row.covered_player_seasons) == (7, 3) and row.coverage_pct == pytest.approx(42.86, abs=0.01)
    assert [(r.player_id, r.missing_seasons) for r in C.gap_candidates(league).orderBy("player_id").collect()] == [(p, [YEAR]) for p in (REED, ELM, FIR, OAK)]
    assert C.cached_summary(league, 3) == {"players": 0, "contracts": 3, "contract_seasons": 4, "cached": 1}
