"""Filling contract gaps from saved pages: a chain that can be resumed, with an outcome for every candidate.

A store holds ``contracts``, ``contract_seasons`` and ``gap_outcomes`` as
versioned tables (see ``operators.versions``). A run

1. lists players with uncovered seasons and leaves out those whose last outcome
   is settled for the same seasons;
2. finds the pages that belong to them and reads those in one pass;
3. reconciles the parsed seasons with the stored contracts;
4. merges contracts, then contract seasons (only the seasons it fills), then
   writes the outcomes.

``plan`` does the first three steps and is the dry run; ``fill`` writes what it
gives. A run that stops halfway is taken up by the next one: contracts that are
there already match by their source id, seasons that are there are no gaps, and
candidates without an outcome are read again.
"""

from __future__ import annotations

from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkline import schemas
from rinkline.operators import merge as M
from rinkline.operators import versions as V
from rinkline.operators.keyed import first_per_key
from rinkline.plans import contracts as C
from rinkline.plans.ingest import history_seasons
from rinkline.session import staged
from rinkline.sources import documents as D

OUTCOMES = "run int, player_id long, missing string, stage string, status string, seasons long"
#: Outcomes that a later run tries again; others stand while the player misses the seasons that were left after them (``missing``).
RETRIED = ["failed", "not_found"]


class Plan(NamedTuple):
    contracts: DataFrame
    seasons: DataFrame
    outcomes: DataFrame


class Filled(NamedTuple):
    run: int
    contracts: dict[str, int]
    seasons: dict[str, int]


def create_store(tables: Mapping[str, DataFrame], path: str) -> None:
    """A store of the given contracts and contract seasons, without outcomes."""
    V.create(_one_part(tables["contracts"]), f"{path}/contracts", "_one")
    V.create(tables["contract_seasons"], f"{path}/contract_seasons", "season_start_year")


def _one_part(df: DataFrame) -> DataFrame:
    """Contracts are found by several keys, none of which is a season: they are one part."""
    return df.withColumn("_one", F.lit(0))


def stored(spark: SparkSession, path: str, seasons: DataFrame | None = None) -> dict[str, DataFrame]:
    """The store's tables; with ``seasons`` only those contract seasons."""
    return {
        "contracts": V.read(spark, f"{path}/contracts", schemas.TABLES["contracts"]),
        "contract_seasons": V.read(spark, f"{path}/contract_seasons", schemas.TABLES["contract_seasons"], seasons),
        "gap_outcomes": V.read(spark, f"{path}/gap_outcomes", OUTCOMES),
    }


def _text(seasons: Column) -> Column:
    return F.array_join(F.transform(seasons, lambda y: y.cast("string")), ",")


def open_candidates(tables: Mapping[str, DataFrame], first: int | None, last: int | None) -> DataFrame:
    """Gap candidates without an outcome that is settled for the same missing seasons."""
    newest = first_per_key(tables["gap_outcomes"], ["player_id"], [F.col("run").desc()])
    settled = newest.where(~F.col("status").isin(RETRIED)).select("player_id", "missing")
    found = C.gap_candidates(tables, first, last).withColumn("missing", _text(F.col("missing_seasons")))
    return found.join(settled, ["player_id", "missing"], "left_anti")


def plan(
    tables: Mapping[str, DataFrame], pages: DataFrame, path: str, run: int, source_code: str, source_id: int, first: int | None = C.FIRST_SEASON, last: int | None = C.LAST_SEASON
) -> Plan:
    """What a run would write, and what would become of each candidate.

    ``pages``: key, player_id, url, html. Statuses: ``no_nhl_id``, ``not_found``
    (no page is the player's), ``failed`` (none could be read), ``no_contracts``,
    ``no_matching_contracts`` (none for a missing season), ``conflict``, ``filled``.
    """
    spark = pages.sparkSession
    tables = {**tables, **stored(spark, path)}
    people = staged(open_candidates(tables, first, last), "candidates")
    theirs = pages.join(people.where("nhl_id is not null").select("player_id"), "player_id", "left_semi")
    wanted = theirs.select("key", "player_id").join(people, "player_id")
    own = staged(D.matches_candidate(theirs, wanted).where("matches").select("key"), "own-pages")
    # contracts are read of pages only that belong to their candidate; nothing is asked of the others
    theirs = theirs.join(own, "key", "left_semi")
    read = staged(D.read_pages(theirs).join(theirs.select("key", "player_id"), "key"), "read-pages")
    parsed = D.contract_seasons(read).join(read.select("key", "player_id"), "key").withColumn("contract_no", F.concat_ws("/", "key", "contract_no"))
    parsed = parsed.join(people.select("player_id", "nhl_id"), "player_id").withColumn("clauses", F.lit("{}")).withColumn("source_payload", F.lit("{}"))
    low, high = _span(people, first, last)
    seasons = history_seasons(tables, parsed, people, source_code, source_id, low, high)
    known = V.read(spark, f"{path}/contract_seasons", schemas.TABLES["contract_seasons"], seasons.select("season_start_year"))
    next_id = (tables["contracts"].agg(F.max("id")).first()[0] or 0) + 1
    deals, years, decided = C.history_rows(seasons, tables["contracts"], known, next_id)
    years = staged(years, "gap-seasons")
    return Plan(deals, years, _outcomes(people, read, decided, years, run))


def _span(people: DataFrame, first: int | None, last: int | None) -> tuple[int, int]:
    """The season bounds, open ones closed by the candidates' own seasons."""
    row = people.select(F.min(F.array_min("missing_seasons")), F.max(F.array_max("missing_seasons"))).first()
    return (row[0] or 0) if first is None else first, (row[1] or 0) if last is None else last


def _outcomes(people: DataFrame, read: DataFrame, decided: DataFrame, years: DataFrame, run: int) -> DataFrame:
    pages = read.groupBy("player_id").agg(F.max(F.col("status") == "ok").alias("ok"), F.max(F.col("status") == "absent").alias("absent"))
    clashes = decided.groupBy("player_id").agg(F.max(F.col("conflict").isNotNull()).alias("clash"))
    # bounded list: a player's seasons
    written = years.groupBy("player_id").agg(F.count(F.lit(1)).alias("seasons"), F.collect_set("season_start_year").alias("now"))
    all_ = people.join(pages, "player_id", "left").join(clashes, "player_id", "left").join(written, "player_id", "left")
    status = (
        F.when(F.col("nhl_id").isNull(), "no_nhl_id")
        .when(F.col("ok").isNull(), "not_found")
        .when(~F.col("ok"), F.when(F.col("absent"), "no_contracts").otherwise("failed"))
        .when(F.col("seasons") > 0, "filled")
        .when(F.col("clash"), "conflict")
        .otherwise("no_matching_contracts")
    )
    stage = (
        F.when(status == "no_nhl_id", "candidate")
        .when(status.isin("not_found", "failed", "no_contracts"), "read")
        .when(status == "filled", "written")
        .otherwise("reconciled")
    )
    left = F.array_except("missing_seasons", F.coalesce("now", F.array().cast("array<int>")))
    return all_.select(
        F.lit(run).alias("run"), "player_id", _text(left).alias("missing"), stage.alias("stage"), status.alias("status"), F.coalesce("seasons", F.lit(0)).cast("long").alias("seasons")
    )


def fill(
    tables: Mapping[str, DataFrame], pages: DataFrame, path: str, source_code: str, source_id: int, first: int | None = C.FIRST_SEASON, last: int | None = C.LAST_SEASON
) -> Filled:
    """One run: plan, merge into the store, write the outcomes; the counts are those of the merges."""
    spark = pages.sparkSession
    run = (V.read(spark, f"{path}/gap_outcomes", OUTCOMES).agg(F.max("run")).first()[0] or 0) + 1
    planned = plan(tables, pages, path, run, source_code, source_id, first, last)
    outcomes = staged(planned.outcomes, "outcomes")
    whole = lambda old, new: _one_part(C.fill_contracts(old, new.drop("_one")))
    deals = V.merge(_one_part(staged(planned.contracts, "gap-contracts")), f"{path}/contracts", schemas.TABLES["contracts"], "_one", whole)
    years = V.merge(planned.seasons, f"{path}/contract_seasons", schemas.TABLES["contract_seasons"], "season_start_year", C.fill_seasons)
    add = lambda old, new: new.withColumn("_action", F.lit(M.CREATED))
    V.merge(outcomes, f"{path}/gap_outcomes", OUTCOMES, "run", add)
    return Filled(run, deals.counts, years.counts)
