"""What keeps large runs within disk and time: shuffle files that go, rows that aren't dealt again, pages that aren't read."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rinkline import session
from rinkline.plans import contracts as C
from rinkline.plans import gap_fill as G
from rinkline.plans import value
from rinkline.workload import contract_queries, model_queries
from rinkline.workload.league import RAW, League


def league(spark, tmp_path):
    """40 customers with 12 orders of 4 lines each over six years."""
    day = lambda i: dt.datetime(1996 + i % 6, 1 + i % 12, 3)
    rows = {
        "region": [(r, f"REGION_{r}") for r in range(5)],
        "nation": [(n, f"NATION_{n}", n % 5) for n in range(10)],
        "customer": [(c, f"Customer#{c}", c % 10, 260.0 * c - 500, ["BUILDING", "MACHINERY", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD"][c % 5]) for c in range(40)],
        "supplier": [(s, f"Supplier#{s}", s % 10, 100.0 * s) for s in range(6)],
        "orders": [(o, o % 40, "FOP"[o // 40 % 3], 1000.0 + o, day(o // 40 + o % 40), f"{1 + o % 5}-X") for o in range(480)],
        "lineitem": [(i // 4, i % 7, i // 4 % 6, 1 + i % 4, 20.0 + i % 3, 900.0 + i, 0.01 * (i % 9), 0.02, "ARN"[i % 3], "OF"[i % 2], day(i % 30)) for i in range(1920)],
        "events": [(e, dt.datetime(2024, 1, 1 + e % 28), e % 40, ["click", "error", "purchase", "signup", "view"][e % 5], 1.0, '{"k": %d}' % (e % 90)) for e in range(200)],
    }
    for name, found in rows.items():
        spark.createDataFrame(found, RAW[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    return League(spark, str(tmp_path))


def shuffled(df):
    """Keys of the exchanges in a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]


@pytest.fixture
def large(spark):
    """No table counts as small."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_shuffle_files_of_staged_frames_are_removed(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.getName() for f in (disk.getAllFiles().apply(i) for i in range(disk.getAllFiles().length())) if f.getName().startswith("shuffle_")}
    before = files()
    df = session.staged(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert not files() - before and df.agg(F.sum("count")).first()[0] == 1000


def test_facts_are_dealt_by_player_once(spark, tmp_path, large):
    lg = league(spark, tmp_path)
    lg.with_stored_facts()
    # by the stored facts themselves nothing is dealt anew: stints need no exchange, season teams neither
    t = lg.tables("player_team_stints", "teams", "skater_season_stats")
    assert shuffled(t["player_team_stints"]) == []
    assert not [k for k in shuffled(value.season_team(t["player_team_stints"], t["teams"])) if "player_id" in k or "team_id" in k]
    # the customers come to the facts
    assert all(k.startswith("c_custkey") or k.startswith("player_id") and "season" not in k for k in shuffled(t["skater_season_stats"]))
    scan = t["skater_season_stats"]._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in scan


def test_facts_are_those_of_the_lines(spark, tmp_path):
    lg = league(spark, tmp_path)
    got = {(r.player_id, r.season_start_year, r.team_id, r.game_type): r for r in lg.with_stored_facts().team_facts().collect()}
    orders = {o.o_orderkey: o for o in lg.raw("orders").collect()}
    want = {}
    for line in lg.raw("lineitem").collect():
        o = orders[line.l_orderkey]
        want.setdefault((o.o_custkey, o.o_orderdate.year, line.l_suppkey, 3 if o.o_orderpriority == "1-URGENT" else 2), []).append(line)
    assert got.keys() == want.keys()
    for key, lines in want.items():
        r, count = got[key], lambda f: sum(map(f, lines))  # noqa: B023
        assert (r.n, r.lines, r.qty, r.disc) == (len(lines), count(lambda x: x.l_linenumber), count(lambda x: int(x.l_quantity)), count(lambda x: round(x.l_discount * 100)))
        assert (r.a, r.r, r.nn, r.open) == (*(count(lambda x, f=f: x.l_returnflag == f) for f in "ARN"), count(lambda x: x.l_linestatus == "O"))
        assert (r.first_ship, r.last_ship) == (min(x.l_shipdate for x in lines), max(x.l_shipdate for x in lines))


def test_scoped_seasons_are_not_dealt_by_season(spark, large):
    seasons = spark.createDataFrame([(1, "a", y, 5) for y in range(1995, 2001)] + [(2, "b", 1999, 6), (None, "c", 1999, 7)], "player_id long, contract_no string, season_start_year int, cap_hit_cents long")
    known = spark.createDataFrame([(y, 100) for y in range(1990, 2000)], "start_year int, salary_cap_cents long")
    targets = spark.createDataFrame([(1, [1996, 1998]), (1, [1996]), (3, [1999]), (None, [1999])], "player_id long, missing_seasons array<int>")
    scoped = C.scoped_seasons(seasons, known, targets, 2000, 2002)
    assert not [k for k in shuffled(scoped) if "season" in k]
    assert sorted((r.season_start_year, r.is_target) for r in scoped.collect()) == [(1995, False), (1996, True), (1997, False), (1998, True), (1999, False)]


def test_decisions_are_made_once(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(C, "match_contracts", lambda *a, f=C.match_contracts: made.append(1) or f(*a))
    names = []
    monkeypatch.setattr(C, "staged", lambda df, name, f=C.staged: names.append(name) or f(df, name))
    contract_queries.reconciled_contracts(league(spark, tmp_path)).collect()
    assert made == [1] and {"incoming", "matched", "decided"} <= set(names)


def test_contracts_are_read_of_own_pages_only(spark, tmp_path, monkeypatch):
    from rinkline.workload import store_queries

    lg, read = league(spark, tmp_path), []
    monkeypatch.setattr(G.D, "read_pages", lambda pages, *a, f=G.D.read_pages: read.append(pages.select("key").collect()) or f(pages, *a))
    seen = {r.player_id: r.status for r in store_queries.gap_fill_dry_run(lg).collect()}
    # standard contracts of customers who aren't in debt carry the customer's id
    own = {r.o_orderkey for r in lg.raw("orders").join(lg.raw("customer"), F.col("o_custkey") == F.col("c_custkey")).where("o_orderstatus = 'F' AND c_acctbal >= 0").collect()}
    assert len(read) == 1 and {r.key for r in read[0]} <= own
    assert "no_nhl_id" in seen.values() and "filled" in seen.values()


def test_targets_are_made_once_for_training_and_scoring(spark, tmp_path, monkeypatch):
    made = []
    monkeypatch.setattr(model_queries.M, "training_data", lambda *a, f=model_queries.M.training_data: made.append(1) or f(*a))
    model_queries.trained_model_metrics(league(spark, tmp_path)).collect()
    assert made == [1]
