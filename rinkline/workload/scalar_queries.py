"""Scalar rules over whole columns of the order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rinkline.functions import dates as D
from rinkline.functions import numbers as N
from rinkline.functions import text as X
from rinkline.workload.registry import query

_SPELLED = """CASE l_returnflag WHEN 'A' THEN CASE WHEN l_quantity > 25 THEN 'NA' ELSE ' ' || l_extendedprice::VARCHAR || ' ' END
    WHEN 'R' THEN CASE WHEN l_quantity > 25 THEN l_quantity::BIGINT::VARCHAR || '.0' ELSE '-' || l_extendedprice::VARCHAR END
    ELSE CASE WHEN l_quantity > 40 THEN 'x' || l_quantity::BIGINT::VARCHAR WHEN l_quantity > 25 THEN 'inf' ELSE (l_quantity::BIGINT * 3)::VARCHAR || 'e1' END END"""


def _spelled():
    flag, qty, price = F.col("l_returnflag"), F.col("l_quantity"), F.col("l_extendedprice").cast("decimal(18,2)").cast("string")
    whole = qty.cast("bigint").cast("string")
    return (
        F.when(flag == "A", F.when(qty > 25, "NA").otherwise(F.concat(F.lit(" "), price, F.lit(" "))))
        .when(flag == "R", F.when(qty > 25, F.concat(whole, F.lit(".0"))).otherwise(F.concat(F.lit("-"), price)))
        .otherwise(
            F.when(qty > 40, F.concat(F.lit("x"), whole)).when(qty > 25, "inf").otherwise(F.concat((qty.cast("bigint") * 3).cast("string"), F.lit("e1")))
        )
    )


@query("""SELECT l_returnflag, count(*) AS n, count(v) AS parsed, sum(CAST(round(v * 100) AS BIGINT))::BIGINT AS hundredths, sum(trunc(v)::BIGINT)::BIGINT AS whole, count(*) FILTER (WHERE v = floor(v)) AS integral FROM (
    SELECT l_returnflag, CASE l_returnflag WHEN 'A' THEN CASE WHEN l_quantity > 25 THEN NULL ELSE l_extendedprice END
      WHEN 'R' THEN CASE WHEN l_quantity > 25 THEN l_quantity ELSE -l_extendedprice END
      ELSE CASE WHEN l_quantity > 25 THEN NULL ELSE l_quantity * 30 END END AS v FROM lineitem) GROUP BY 1""")
def number_parsing(lg):
    """Numbers spelled with spaces, exponents, junk and missing tokens."""
    rows = lg.raw("lineitem").select("l_returnflag", _spelled().alias("t"))
    v = N.parse_number(F.col("t"))
    return rows.groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"),
        F.count(v).alias("parsed"),
        F.sum(F.round(v * 100).cast("bigint")).alias("hundredths"),
        F.sum(N.parse_number(F.col("t"), integer=True)).alias("whole"),
        F.count(N.parse_strict_integer(F.col("t"))).alias("integral"),
    )


@query("""SELECT year, cents_up, cents_even, rejected FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS year, sum(CAST(round(o_totalprice * 100) AS BIGINT) + 1)::BIGINT AS cents_up,
      sum(CAST(round(o_totalprice * 100) AS BIGINT) + CAST(round(o_totalprice * 100) AS BIGINT) % 2)::BIGINT AS cents_even, count(*) AS rejected FROM orders GROUP BY 1)""")
def money_parsing(lg):
    """Dollar text with a half cent: rounded up, rounded to even, and a malformed twin."""
    dollars = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    text = F.concat(F.lit("$ "), dollars, F.lit("5"))
    rows = lg.raw("orders").select(F.year("o_orderdate").alias("year"), text.alias("t"))
    return rows.groupBy("year").agg(
        F.sum(N.parse_money_cents(F.col("t"))).alias("cents_up"),
        F.sum(N.parse_money_cents(F.col("t"), "half_even")).alias("cents_even"),
        F.count(N.money_error(F.concat(F.lit("about "), F.col("t")))).alias("rejected"),
    )


@query("""SELECT n_name AS name, count(*) AS n, count(*) FILTER (WHERE length(lpad(s_suppkey::VARCHAR, 4, '0')) = 4 AND s_suppkey < 10000) AS valid, sum(CASE WHEN s_suppkey < 10000 THEN 2 ELSE 1 END)::BIGINT AS listed
    FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1""")
def team_codes(lg):
    """Abbreviations with spaces and lower case; lists with invalid members."""
    teams = lg.tables("teams")["teams"]
    text = F.concat(F.lit(" "), F.lower("abbreviation"), F.lit(" "))
    listing = F.concat_ws(",", text, F.lit("tot"), F.lit("X"), F.lit("ny"))
    return teams.groupBy(F.col("city").alias("name")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count(X.team_abbreviation(text)).alias("valid"),
        F.sum(F.size(X.team_list(listing))).alias("listed"),
    )


@query("""SELECT p_name, count(*) AS n, min(split_part(p_name, ' ', 1)) AS first_name, min(CASE WHEN contains(p_name, ' ') THEN substr(p_name, strpos(p_name, ' ') + 1) ELSE 'Unknown' END) AS last_name,
    min(split_part(p_name, ' ', 1)) AS swapped_first, min(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g')) AS slug FROM part GROUP BY 1""")
def name_splitting(lg):
    name = F.col("p_name")
    parts = X.split_name(F.concat(F.lit("  "), F.replace(name, F.lit(" "), F.lit("  ")), F.lit(" ")))
    swapped = X.split_name(F.concat(parts["last"], F.lit(" , "), parts["first"]))
    # names are few, so the vectorised slug runs on the grouped rows
    grouped = lg.raw("part").groupBy("p_name").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(
        "p_name", "n", parts["first"].alias("first_name"), parts["last"].alias("last_name"),
        swapped["first"].alias("swapped_first"), X.slug_of(name).alias("slug"),
    )


@query("""SELECT doc_id, regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(text), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS folded FROM documents""")
def text_slugs(lg):
    """Whole documents folded to ASCII and dashes (the slug rule without the name split)."""
    folded = F.lower(X.ascii_fold(F.col("text")))
    slug = F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return lg.raw("documents").select("doc_id", slug.alias("folded"))


@query("""SELECT doc_id, regexp_replace(replace(lower(strip_accents(text)), 'ß', 'ss'), '[^\\p{L}\\p{N}]+', '', 'g') AS identity_key FROM documents""")
def text_identity_keys(lg):
    return lg.raw("documents").select("doc_id", X.identity_name(F.col("text")).alias("identity_key"))


@query("""SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean FROM documents""")
def clean_texts(lg):
    return lg.raw("documents").select("doc_id", X.clean_text(F.col("text")).alias("clean"))


@query("""SELECT o_orderkey, year(o_orderdate)::BIGINT AS season, CASE WHEN month(o_orderdate) >= 7 THEN year(o_orderdate) ELSE year(o_orderdate) - 1 END::BIGINT AS started,
    year(o_orderdate)::VARCHAR || '-' || lpad(((year(o_orderdate) + 1) % 100)::VARCHAR, 2, '0') AS label, CAST(NULL AS BIGINT) AS wrong,
    CAST(o_orderdate AS DATE)::VARCHAR AS iso, CAST(o_orderdate AS DATE)::VARCHAR AS slashed, CAST(o_orderdate AS DATE)::VARCHAR AS named, CAST(o_orderdate AS DATE)::VARCHAR AS short_birth FROM orders""")
def season_and_date_parsing(lg):
    """Season labels and dates written in every accepted form and read back."""
    day = F.col("o_orderdate").cast("date")
    year = F.year(day)
    label = D.season_label(year)
    return lg.raw("orders").select(
        "o_orderkey",
        D.parse_season_label(F.concat(F.lit(" "), F.replace(label, F.lit("-"), F.lit(" – ")))).alias("season"),
        D.started_season(day).alias("started"),
        label.alias("label"),
        D.parse_season_label(F.concat(year.cast("string"), F.lit("-"), F.right(year.cast("string"), F.lit(2)))).alias("wrong"),
        D.parse_signing_date(F.concat(F.lit("signed "), F.date_format(day, "y-M-d"))).alias("iso"),
        D.parse_signing_date(F.date_format(day, "M/d/y")).alias("slashed"),
        D.parse_signing_date(F.date_format(day, "MMM d, y")).alias("named"),
        D.parse_short_birth_date(F.date_format(day, "yy-M-d")).alias("short_birth"),
    )


@query("""SELECT id, extract(year FROM age(TIMESTAMP '2020-02-29', birth_date::TIMESTAMP)) AS age, CASE WHEN primary_position = 'D' THEN 'defense' WHEN primary_position IN ('C', 'LW', 'RW', 'F') THEN 'forward' END AS model_group,
    CASE WHEN primary_position = 'D' THEN 'defense' ELSE 'forward' END AS read_group, concat(first_name, ' ', shoots_catches) AS joined,
    concat_ws(' ', first_name, shoots_catches) AS spaced, primary_position AS position, nationality AS country FROM players""")
def player_rules(lg):
    p = F.col("primary_position")
    spelled = F.lower(F.concat(F.replace(F.coalesce(p, F.lit("x")), F.lit("W"), F.lit("")), F.lit(", other")))
    return lg.tables("players")["players"].select(
        "id",
        D.whole_years(F.col("birth_date"), F.lit("2020-02-29").cast("date")).alias("age"),
        X.position_group(p).alias("model_group"),
        X.read_position_group(p).alias("read_group"),
        X.plain_concat(F.col("first_name"), F.lit(" "), F.col("shoots_catches")).alias("joined"),
        X.display_name(F.col("first_name"), F.col("shoots_catches")).alias("spaced"),
        X.normalize_position(spelled, p.eqNullSafe("G")).alias("position"),
        X.normalize_nationality(F.concat(F.lit("1 "), F.lower("nationality"))).alias("country"),
    )


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'UFA' WHEN 'P' THEN 'RFA' END AS expiry, left('signed as ' || o_orderpriority || ' of the second kind, long', 32) AS kind, o_orderstatus = 'O' AS entry,
    o_orderpriority AS team, o_orderstatus = 'P' AS slide, CASE WHEN o_orderstatus = 'F' THEN 'b' ELSE 'a' END AS first_filled, CASE WHEN o_orderstatus = 'F' THEN 'english' ELSE 'anglais' END AS localized,
    CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS aliased FROM orders""")
def contract_text_rules(lg):
    status, team = F.col("o_orderstatus"), F.col("o_orderpriority")
    page = F.concat(
        F.lit("Total Value: $1 | Signing Team: "), team,
        F.when(status == "F", " | Expiration Status: UFA").when(status == "P", " Expiration Status: (rfa)").otherwise(" Seasons: 3"),
    )
    words = F.create_map(F.lit("fr"), F.lit("anglais"), F.lit("default"), F.when(status == "F", "english").otherwise(""))
    row = F.create_map(F.lit("Cap Hit"), F.lit("1"), F.lit("Base-Salary"), F.when(status != "P", status))
    return lg.raw("orders").select(
        "o_orderkey",
        X.expiry_status(X.labelled(page, "Expiration Status")).alias("expiry"),
        X.contract_type(F.concat(F.lit(" signed  as "), team, F.lit(" of the second kind, long"))).alias("kind"),
        X.is_entry_level(F.when(status == "O", "3 year elc")).alias("entry"),
        X.labelled(page, "Signing Team").alias("team"),
        X.mentions_slide(F.when(status == "P", "--- Entry Level Slide ---"), F.lit("x")).alias("slide"),
        X.first_filled(F.when(status != "F", "a"), F.lit(""), F.lit("b")).alias("first_filled"),
        X.localized(words).alias("localized"),
        X.first_key(X.letter_keys(row), "nhlsalary", "basesalary").alias("aliased"),
    )


@query("""SELECT c.id, c.average_value_cents AS average, cs.total_cash_cents AS cash, round(c.total_value_cents / 100.0::DOUBLE, 6) AS dollars, CAST(round(cs.cap_percentage * 100000000) AS BIGINT) AS share,
    CASE WHEN s < 2013 THEN 0 WHEN s < 2015 THEN 92500000 WHEN s < 2017 THEN 95000000 WHEN s < 2019 THEN 102500000 WHEN s < 2021 THEN 107500000 WHEN s < 2023 THEN 112500000 WHEN s < 2026 THEN 115000000 ELSE 122500000 END::BIGINT AS relief
    FROM (SELECT *, start_season + o AS s FROM contracts, (VALUES (12), (17), (22), (28)) v(o)) c JOIN contract_seasons cs ON cs.contract_id = c.id AND cs.season_start_year = c.start_season""")
def contract_money_rules(lg):
    t = lg.tables("contracts", "contract_seasons", "seasons")
    first = t["contract_seasons"].select(F.col("contract_id").alias("id"), F.col("season_start_year").alias("start_season"), "base_salary_cents", "signing_bonus_cents", "cap_hit_cents")
    caps = t["seasons"].select(F.col("start_year").alias("start_season"), "salary_cap_cents")
    rows = t["contracts"].join(first, ["id", "start_season"]).join(caps, "start_season")
    later = F.explode(F.array(*[F.col("start_season") + o for o in (12, 17, 22, 28)])).alias("s")
    return rows.select("*", later).select(
        "id",
        N.average_cents(F.col("total_value_cents"), F.col("term_years")).alias("average"),
        N.cash_cents(F.col("base_salary_cents"), F.col("signing_bonus_cents")).alias("cash"),
        N.cents_to_dollars(F.col("total_value_cents")).alias("dollars"),
        (N.cap_share(F.col("cap_hit_cents"), F.col("salary_cap_cents")) * 100_000_000).cast("bigint").alias("share"),
        N.buried_relief_cents(F.col("s")).alias("relief"),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(CASE WHEN l_quantity > 10 THEN l_extendedprice * 3600.0::DOUBLE / (l_quantity - 10) END, 6) AS rate,
    round(CASE WHEN coalesce(a, 0) + r + n > 0 THEN a::DOUBLE / (coalesce(a, 0) + r + n) END, 6) AS share FROM (
    SELECT *, CASE WHEN l_returnflag = 'A' THEN NULL WHEN l_returnflag = 'R' THEN l_linenumber ELSE 0 END AS a, CASE WHEN l_returnflag = 'R' THEN 2 ELSE 0 END AS r, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS n FROM lineitem)""")
def guarded_rates(lg):
    flag = F.col("l_returnflag")
    a = F.when(flag == "R", F.col("l_linenumber")).when(flag == "N", 0)
    r = F.when(flag == "R", 2).otherwise(0)
    n = F.when(F.col("l_linestatus") == "O", 1).otherwise(0)
    return lg.raw("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        N.per_60(F.col("l_extendedprice"), F.col("l_quantity") - 10).alias("rate"),
        N.share_of(a, a, r, n).alias("share"),
    )


@query("""SELECT event_id, sha256('{"event_type":' || coalesce('"' || event_type || '"', 'null') || ',"props":' || coalesce('"' || replace(props, '"', chr(92) || '"') || '"', 'null')
    || ',"ts":' || coalesce('"' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '"', 'null') || ',"user_id":' || coalesce(user_id::VARCHAR, 'null')
    || ',"value":' || coalesce(rtrim(rtrim(printf('%.10f', value), '0'), '.'), 'null') || '}') AS row_hash FROM events""")
def row_hashes(lg):
    """The hash of every event's canonical JSON, which another engine writes alike."""
    events = lg.raw("events")
    return events.select("event_id", X.row_hash(events.schema, "user_id", "event_type", "value", "props", "ts").alias("row_hash"))
