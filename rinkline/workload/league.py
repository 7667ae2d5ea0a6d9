"""A league derived from order tables, so the plans run on data of any size.

Customers are players, suppliers teams, order years seasons. Lines grouped
by player, season and team are the team rows; well-funded customers also get
TOTAL rows, some from two sources. All measures are whole numbers, so sums
do not depend on their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkline import schemas
from rinkline.session import parts, staged_by
from rinkline.functions.dates import season_label
from rinkline.functions.numbers import average_cents, cap_share

TOTAL_BALANCE, TWO_TOTALS_BALANCE = 5000, 8000

RAW = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


class League:
    """Lazily derived tables; ``tables()`` gives them by name.

    Plans are built once per league. ``with_stored_facts`` also writes the
    grouped lines once, for queries that derive several tables from them.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._plans: dict[str, DataFrame] = {}
        self._stored = False

    def raw(self, table: str) -> DataFrame:
        return self._once(
            f"raw {table}",
            lambda: self.spark.read.schema(RAW[table]).parquet(f"{self.folder}/{table}.parquet"),
        )

    def tables(self, *names: str) -> dict[str, DataFrame]:
        return {
            n: self._once(n, lambda n=n: schemas.conform(getattr(self, n)(), n)) for n in names
        }

    def with_stored_facts(self) -> League:
        if not self._stored:
            self._plans["team_facts"] = staged_by(self.team_facts(), "player_id", "facts")
            self._stored = True
        return self

    def _once(self, name: str, build) -> DataFrame:
        if name not in self._plans:
            self._plans[name] = build()
        return self._plans[name]

    # --- dimensions ---------------------------------------------------------

    def data_sources(self) -> DataFrame:
        return schemas.seed_sources(self.spark)

    def teams(self) -> DataFrame:
        nations = self.raw("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
        return self.raw("supplier").join(nations, "s_nationkey").select(
            F.col("s_suppkey").alias("id"),
            F.col("s_suppkey").cast("int").alias("nhl_team_id"),
            letters(F.col("s_suppkey")).alias("abbreviation"),
            F.col("s_name").alias("name"),
            F.col("n_name").alias("city"),
            (F.col("s_acctbal") >= 0).alias("active"),
        )

    def players(self) -> DataFrame:
        balance, segment = F.col("c_acctbal"), F.col("c_mktsegment")
        regions = self.raw("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
        homes = self.raw("nation").join(regions, "n_regionkey").select(
            F.col("n_nationkey").alias("c_nationkey"), "n_name", "r_name"
        )
        born = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.abs(balance)).cast("int"))
        return self.raw("customer").join(homes, "c_nationkey").select(
            F.col("c_custkey").alias("id"),
            F.col("n_name").alias("first_name"),
            F.col("c_name").alias("last_name"),
            F.when(~balance.between(0, 500), born).alias("birth_date"),
            position(segment, balance).alias("primary_position"),
            F.when(segment != "HOUSEHOLD", F.when(balance < 5000, "L").otherwise("R")).alias("shoots_catches"),
            F.upper(F.left("r_name", F.lit(3))).alias("nationality"),
            (balance >= 0).alias("active"),
            F.when(balance < 0, "LTIR").when(balance < 1000, "MINORS").when(balance < 2000, "UNKNOWN").otherwise("ACTIVE").alias("roster_status"),
        )

    def seasons(self) -> DataFrame:
        caps = self.raw("orders").groupBy(F.year("o_orderdate").alias("start_year")).agg(
            F.sum(cents("o_totalprice")).alias("salary_cap_cents")
        )
        years = self.contract_years().select(F.col("season_start_year").alias("start_year")).distinct()
        return years.join(caps, "start_year", "left").select(
            "start_year",
            (F.col("start_year") + 1).alias("end_year"),
            season_label(F.col("start_year")).alias("label"),
            "salary_cap_cents",
        )

    # --- facts --------------------------------------------------------------

    def line_rows(self) -> DataFrame:
        """Lines with the player, season and game type of their order; measures are read before the join, as whole numbers."""
        orders = self.raw("orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            F.col("o_custkey").alias("player_id"),
            F.year("o_orderdate").cast("short").alias("season_start_year"),
            F.when(F.col("o_orderpriority") == "1-URGENT", 3).otherwise(2).cast("byte").alias("game_type"),
        )
        flag = F.col("l_returnflag")
        lines = self.raw("lineitem").select(
            "l_orderkey",
            F.col("l_suppkey").alias("team_id"),
            F.col("l_linenumber").alias("lines"),
            F.col("l_quantity").cast("bigint").alias("qty"),
            F.round(F.col("l_discount") * 100).cast("bigint").alias("disc"),
            F.round(F.col("l_tax") * 100).cast("bigint").alias("tax"),
            F.floor(F.col("l_extendedprice") / 100).cast("bigint").alias("price"),
            F.when(flag == "A", 1).when(flag == "R", 2).when(flag == "N", 3).cast("byte").alias("flag"),
            (F.col("l_linestatus") == "O").alias("open"),
            F.col("l_shipdate").alias("ship"),
        )
        return lines.join(orders, "l_orderkey").drop("l_orderkey")

    def team_facts(self) -> DataFrame:
        """Line counts and sums per player, season, team and game type."""
        return self._once("team_facts", self._team_facts)

    def _team_facts(self) -> DataFrame:
        # Dealt by the player alone: nearly every line is a fact of its own, and what is derived from facts goes by player.
        dealt = self.line_rows().repartition(parts(self.spark), "player_id")
        facts = dealt.groupBy("player_id", "season_start_year", "team_id", "game_type").agg(
            F.count(F.lit(1)).alias("n"),
            *[F.sum(c).alias(c) for c in ("lines", "qty", "disc", "tax", "price")],
            F.count_if(F.col("flag") == 1).alias("a"),
            F.count_if(F.col("flag") == 2).alias("r"),
            F.count_if(F.col("flag") == 3).alias("nn"),
            F.count_if("open").alias("open"),
            F.min("ship").alias("first_ship"),
            F.max("ship").alias("last_ship"),
        )
        whole = {c: F.col(c).cast("int") for c in ("season_start_year", "game_type")}
        return facts.withColumns(whole)

    def scope_facts(self) -> DataFrame:
        """Team facts, plus one TOTAL row for well-funded players."""
        return self._once("scope_facts", self._scope_facts)

    def _scope_facts(self) -> DataFrame:
        sums = ["n", "lines", "qty", "disc", "tax", "price", "a", "r", "nn", "open"]
        who = self.raw("customer").select(
            F.col("c_custkey").alias("player_id"),
            F.col("c_acctbal").alias("balance"),
            position(F.col("c_mktsegment"), F.col("c_acctbal")).alias("position"),
        )
        facts = self.with_stored_facts().team_facts()  # read by both branches below
        totals = (
            facts.join(who.filter(F.col("balance") > TOTAL_BALANCE).select("player_id"), "player_id", "left_semi")
            .groupBy("player_id", "season_start_year", "game_type")
            .agg(*[F.sum(c).alias(c) for c in sums], F.max("last_ship").alias("last_ship"))
            .withColumn("team_id", F.lit(None).cast("bigint"))
            .withColumn("n", F.col("n") + 1)
        )
        # joined on either side of the union, where the rows still lie by player
        sides = ((facts.drop("first_ship"), "TEAM"), (totals, "TOTAL"))
        team, total = (rows.withColumn("stat_scope", F.lit(scope)).join(who, "player_id") for rows, scope in sides)
        return team.unionByName(total)

    def skater_season_stats(self) -> DataFrame:
        facts = self.scope_facts().filter(is_skater())
        later = F.when(F.col("r") > F.col("a"), F.expr("interval 1 day")).otherwise(F.expr("interval -1 day"))
        version = lambda source, goals, at: F.struct(F.lit(source).alias("source_id"), goals.alias("n"), at.alias("updated_at"))
        two = (F.col("stat_scope") == "TOTAL") & (F.col("balance") > TWO_TOTALS_BALANCE)
        versions = F.array_compact(
            F.array(
                version(1, F.col("n"), F.col("last_ship")),
                F.when(two, version(2, F.col("n") + 1, F.col("last_ship") + later)),
            )
        )
        return facts.select(*[c for c in facts.columns if c != "n"], F.inline(versions)).select(
            *grain(),
            F.col("lines").alias("games_played"),
            F.col("n").alias("goals"),
            F.col("lines").alias("assists"),
            (F.col("n") + F.col("lines")).alias("points"),
            (F.col("a") - F.col("r")).alias("plus_minus"),
            F.col("tax").alias("penalty_minutes"),
            F.col("a").alias("power_play_goals"),
            (F.col("a") + F.col("r")).alias("power_play_points"),
            F.nullif("r", F.lit(0)).alias("short_handed_goals"),
            F.col("qty").alias("shots"),
            (F.col("n") / F.col("qty")).alias("shooting_percentage"),
            "updated_at",
        )

    def goalie_season_stats(self) -> DataFrame:
        facts = self.scope_facts().filter("position = 'G'").withColumn("source_id", F.lit(1))
        return facts.select(
            *grain(),
            F.col("lines").alias("games_played"),
            F.col("a").alias("wins"),
            F.col("r").alias("losses"),
            F.col("nn").alias("overtime_losses"),
            F.col("qty").alias("shots_against"),
            (F.col("qty") - F.col("n")).alias("saves"),
            F.col("n").alias("goals_against"),
            F.col("open").alias("shutouts"),
            (F.col("qty") * 60).alias("time_on_ice_seconds"),
            F.col("last_ship").alias("updated_at"),
        )

    def _situations(self, facts: DataFrame) -> DataFrame:
        """Every row for all situations and again for even strength."""
        loud = F.when((F.col("position") == "RW") & (F.col("open") == 0), "ALL").otherwise("all")
        return facts.withColumn("situation", F.explode(F.array(loud, F.lit("5on5")))).withColumn(
            "source_id", F.lit(2)
        )

    def skater_advanced_season_stats(self) -> DataFrame:
        facts = self._situations(self.scope_facts().filter(is_skater()))
        share = (F.expr("(disc * 64) div (10 * n)") / 64.0)
        return facts.select(
            *grain(),
            "situation",
            F.col("lines").alias("games_played"),
            (F.col("qty") * 60).alias("ice_time_seconds"),
            (F.col("lines") * 3).alias("shifts"),
            F.col("price").alias("game_score"),
            (F.col("n") + F.col("lines")).alias("individual_points"),
            F.col("n").alias("individual_goals"),
            F.col("a").alias("individual_primary_assists"),
            F.col("r").alias("individual_secondary_assists"),
            F.col("disc").alias("individual_expected_goals"),
            F.col("qty").alias("individual_shots_on_goal"),
            (F.col("qty") + F.col("n")).alias("individual_unblocked_attempts"),
            F.when(F.col("open") < F.col("n"), share).alias("on_ice_expected_goals_pct"),
            F.col("nn").alias("shots_blocked"),
            F.col("a").alias("takeaways"),
            F.col("r").alias("giveaways"),
            F.col("tax").alias("penalties"),
            F.col("nn").alias("penalties_drawn"),
            F.col("a").alias("offensive_zone_shift_starts"),
            F.col("r").alias("defensive_zone_shift_starts"),
            F.col("nn").alias("neutral_zone_shift_starts"),
            F.col("last_ship").alias("updated_at"),
        )

    def goalie_advanced_season_stats(self) -> DataFrame:
        facts = self._situations(self.scope_facts().filter("position = 'G'"))
        return facts.select(
            *grain(),
            "situation",
            F.col("lines").alias("games_played"),
            (F.col("qty") * 60).alias("ice_time_seconds"),
            F.col("disc").alias("expected_goals_against"),
            F.col("n").alias("goals_against"),
            F.col("last_ship").alias("updated_at"),
        )

    def player_team_stints(self) -> DataFrame:
        spans = self.team_facts().groupBy("player_id", "season_start_year", "team_id").agg(
            F.to_date(F.min("first_ship")).alias("joined_on"),
            F.to_date(F.max("last_ship")).alias("_last"),
            F.sum("open").alias("_open"),
        )
        made = (F.col("player_id") * 100 + F.col("season_start_year") - 1990) * 100000 + F.col("team_id")
        return spans.select(
            made.alias("id"),
            "player_id",
            "season_start_year",
            "team_id",
            "joined_on",
            F.when(F.col("_open") == 0, F.col("_last")).alias("departed_on"),
        )

    # --- contracts ------------------------------------------------------------

    def contracts(self) -> DataFrame:
        signing = self.raw("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
            F.min("l_suppkey").alias("signing_team_id")
        )
        status = F.col("o_orderstatus")
        term = F.left("o_orderpriority", F.lit(1)).cast("int")
        start = F.year("o_orderdate")
        total = cents("o_totalprice")
        return self.raw("orders").join(signing, "o_orderkey", "left").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("player_id"),
            "signing_team_id",
            F.lit(3).alias("source_id"),
            F.concat(F.lit("contract-"), F.col("o_orderkey")).alias("external_id"),
            F.to_date("o_orderdate").alias("signed_on"),
            start.alias("start_season"),
            (start + term - 1).alias("end_season"),
            term.alias("term_years"),
            F.when(status == "F", "STANDARD").when(status == "O", "ENTRY LEVEL").otherwise("ONE_WAY").alias("contract_type"),
            F.when(status == "F", "UFA").when(status == "P", "RFA").alias("expiry_status"),
            total.alias("total_value_cents"),
            average_cents(total, term).alias("average_value_cents"),
            (status == "O").alias("is_entry_level"),
            F.lit("{}").alias("source_payload"),
        )

    def contract_years(self) -> DataFrame:
        term = F.left("o_orderpriority", F.lit(1)).cast("int")
        start = F.year("o_orderdate")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("contract_id"),
            F.explode(F.sequence(start, start + term - 1)).alias("season_start_year"),
        )

    def contract_seasons(self) -> DataFrame:
        deals = self.tables("contracts")["contracts"].select(
            F.col("id").alias("contract_id"), "signing_team_id", "average_value_cents", "expiry_status",
            F.explode(F.sequence("start_season", "end_season")).alias("season_start_year"),
        )
        caps = self.tables("seasons")["seasons"].select(F.col("start_year").alias("season_start_year"), "salary_cap_cents")
        hit = F.col("average_value_cents")
        base = F.expr("average_value_cents * 7 div 10")
        bonus = F.when(F.col("expiry_status") != "RFA", hit - base)
        return deals.join(F.broadcast(caps), "season_start_year").select(  # a row per season
            (F.col("contract_id") * 10000 + F.col("season_start_year")).alias("id"),
            "contract_id",
            "season_start_year",
            F.col("signing_team_id").alias("owning_team_id"),
            base.alias("base_salary_cents"),
            bonus.alias("signing_bonus_cents"),
            F.lit(0).alias("performance_bonus_cents"),
            F.coalesce(base + bonus, base).alias("total_cash_cents"),
            hit.alias("cap_hit_cents"),
            cap_share(hit, F.col("salary_cap_cents")).alias("cap_percentage"),
            F.lit(False).alias("is_slide"),
            F.lit("{}").alias("clauses"),
        )

    # --- predictions and overrides ----------------------------------------------

    def model_versions(self) -> DataFrame:
        day = F.lit("2024-01-01").cast("timestamp") + F.make_interval(days=F.col("r_regionkey"))
        return self.raw("region").select(
            F.col("r_regionkey").cast("bigint").alias("id"),
            F.when(F.col("r_regionkey") == 1, "skater_value").otherwise("skater-value").alias("model_type"),
            F.col("r_name").alias("version"),
            F.col("r_regionkey").isin(1, 3).alias("active"),
            day.alias("created_at"),
        )

    def predictions(self) -> DataFrame:
        kind = F.col("event_type")
        payload = F.when(kind == "error", "{}").when(kind == "signup", '{"k": null}').otherwise(F.col("props"))
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.when(kind == "purchase", 1).otherwise(3).alias("model_version_id"),
            F.col("user_id").alias("player_id"),
            (F.lit(1996) + F.expr("cast(get_json_object(props, '$.k') as int) div 17")).alias("target_season"),
            F.lit("forward").alias("position_group"),
            payload.alias("input_features"),
            F.col("ts").alias("created_at"),
        )

    def ltir_overrides(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("int")
        start = F.to_date("ts")
        return self.raw("events").filter("event_type = 'signup'").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("player_id"),
            start.alias("start_date"),
            F.when(k >= 5, F.date_add(start, F.floor(k / 10).cast("int"))).alias("end_date"),
        )

    def player_external_ids(self) -> DataFrame:
        """Basic ids for all players, advanced and minor-league ids for some of them."""
        balance = F.col("c_acctbal")
        sources = F.array_compact(
            F.array(
                F.when(balance >= 0, 1),
                F.when(balance >= 2000, 2),
                F.when(balance >= 4000, 3),
            )
        )
        return self.raw("customer").select(
            "c_custkey", "c_name", F.explode(sources.cast("array<bigint>")).alias("source_id")
        ).select(
            (F.col("c_custkey") * 10 + F.col("source_id")).alias("id"),
            F.col("c_custkey").alias("player_id"),
            "source_id",
            F.col("c_custkey").cast("string").alias("external_id"),
            F.col("c_name").alias("source_name"),
        )


def position(segment: Column, balance: Column) -> Column:
    return (
        F.when(segment == "BUILDING", "D")
        .when(segment == "MACHINERY", "G")
        .when(segment == "AUTOMOBILE", "C")
        .when(segment == "FURNITURE", "LW")
        .when(balance >= 0, "RW")
    )


def is_skater() -> Column:
    return F.coalesce("position", F.lit("")) != "G"


def cents(column: str) -> Column:
    return F.round(F.col(column) * 100).cast("bigint")


def letters(number: Column) -> Column:
    """A number as capital letters, at least four of them."""
    text = number.cast("string")
    padded = F.when(F.length(text) < 4, F.lpad(text, 4, "0")).otherwise(text)
    return F.translate(padded, "0123456789", "ABCDEFGHIJ")


def grain() -> list[Column]:
    made = (
        ((F.col("player_id") * 100 + F.col("season_start_year") - 1990) * 10 + F.col("game_type")) * 1000000
        + F.coalesce("team_id", F.lit(0)) * 4
        + F.when(F.col("stat_scope") == "TEAM", 0).otherwise(F.col("source_id"))
    )
    return [
        made.alias("id"),
        *[F.col(c) for c in ("player_id", "season_start_year", "team_id", "stat_scope", "game_type", "source_id")],
    ]
