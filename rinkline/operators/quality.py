"""Data-quality checks: each gives a frame of violations, ``assert_*`` raises."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, NumericType

from rinkline import schemas
from rinkline.functions.dates import FIRST_SEASON, LAST_SEASON
from rinkline.functions.numbers import (
    decimal_of,
    is_missing_number,
    parse_number,
    parse_strict_integer,
)
from rinkline.operators.keyed import first_per_key


class QualityError(ValueError):
    """Input refused; the message says which check and shows an example."""


def assert_none(violations: DataFrame, check: str) -> None:
    example = violations.first()
    if example is not None:
        raise QualityError(f"{check}: {example.asDict()}")


# --- row checks ------------------------------------------------------------------


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return sorted(set(required) - set(df.columns))


def assert_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = missing_columns(df, required)
    if missing:
        raise QualityError(f"missing columns: {', '.join(missing)}")


def assert_not_empty(df: DataFrame, source: str) -> None:
    if df.isEmpty():
        raise QualityError(f"{source} returned no rows")


def is_blank(value: Column) -> Column:
    return value.isNull() | (F.trim(value.cast("string")) == "")


def bad_number(value: Column, integer: bool) -> Column:
    """Not a missing token, and not a finite (integral, if asked) number."""
    number = decimal_of(value)
    wrong = number.isNull() & parse_number(value).isNull()
    if integer:
        wrong = number.isNull() | (number != F.floor(number))
    return ~is_missing_number(value) & wrong


def bad_season(value: Column) -> Column:
    season = parse_strict_integer(value)
    return season.isNull() | ~season.between(FIRST_SEASON, LAST_SEASON)


def row_violations(
    df: DataFrame,
    required: Sequence[str],
    integers: Sequence[str] = (),
    numbers: Sequence[str] = (),
    season: str = "season",
) -> DataFrame:
    """First violation of every bad row: (row columns, field, reason).

    Order of the checks: missing required values, numeric fields by name,
    then the season.
    """
    checks = [(c, "missing", is_blank(F.col(c))) for c in required]
    for c in sorted({*integers, *numbers}):
        kind = "integer" if c in integers else "number"
        checks.append((c, f"not a finite {kind}", bad_number(F.col(c), c in integers)))
    checks.append((season, "invalid season", bad_season(F.col(season))))
    first = F.coalesce(
        *[
            F.when(bad, F.struct(F.lit(c).alias("field"), F.lit(reason).alias("reason")))
            for c, reason, bad in checks
        ]
    )
    return df.withColumn("_bad", first).filter(F.col("_bad").isNotNull()).select(
        *df.columns, "_bad.field", "_bad.reason"
    )


def grain_key(fields: Sequence[str], integers: Sequence[str] = ()) -> list[Column]:
    """Comparable key columns: whole numbers normalised, other text trimmed upper, null as ''."""
    out = []
    for c in fields:
        text = F.upper(F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))))
        if c in integers:
            text = F.coalesce(parse_strict_integer(F.col(c)).cast("string"), text)
        out.append(text.alias(f"_k_{c}"))
    return out


def last_by_grain(
    df: DataFrame, fields: Sequence[str], integers: Sequence[str] = (), order: str = "_ord"
) -> DataFrame:
    """De-duplicate on the normalised grain; the last row in ``order`` wins."""
    keyed = df.select("*", *grain_key(fields, integers))
    keys = [f"_k_{c}" for c in fields]
    return first_per_key(keyed, keys, [F.col(order).desc()]).drop(*keys)


def quality_report(
    df: DataFrame, fields: Sequence[str], integers: Sequence[str] = (), season: str = "season"
) -> DataFrame:
    """One row: records_read, records_valid, duplicate_records, duplicate_ratio, seasons."""
    keys = [f"_k_{c}" for c in fields]
    year = parse_strict_integer(F.col(season)).cast("int").alias("_season")
    per_key = df.select(*grain_key(fields, integers)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = per_key.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("records_read"), F.count(F.lit(1)).alias("records_valid"))
    # one set of seasons, which stays small: rows outside 1900..2200 are refused before
    seasons = df.select(year).distinct().agg(F.array_sort(F.collect_list("_season")).alias("seasons"))
    report = counts.crossJoin(seasons)  # a row each
    duplicates = F.col("records_read") - F.col("records_valid")
    return report.select(
        "records_read",
        "records_valid",
        duplicates.alias("duplicate_records"),
        F.when(F.col("records_read") > 0, duplicates / F.col("records_read"))
        .otherwise(0.0)
        .alias("duplicate_ratio"),
        "seasons",
    )


def quality_verdict(report: DataFrame, minimum_rows: int, maximum_duplicate_ratio: float) -> DataFrame:
    """The report plus ``violation``: too few rows is told before too many duplicates."""
    check_quality_options(minimum_rows, maximum_duplicate_ratio)
    return report.withColumn(
        "violation",
        F.when(F.col("records_valid") < minimum_rows, "row count").when(
            F.col("duplicate_ratio") > maximum_duplicate_ratio, "duplicate ratio"
        ),
    )


def assert_quality(report: DataFrame, minimum_rows: int, maximum_duplicate_ratio: float) -> None:
    verdict = quality_verdict(report, minimum_rows, maximum_duplicate_ratio)
    assert_none(verdict.filter(F.col("violation").isNotNull()), "quality threshold")


def missing_seasons(df: DataFrame, expected: Sequence[int], season: str = "season") -> DataFrame:
    spark = df.sparkSession
    wanted = spark.createDataFrame([(int(y),) for y in sorted(set(expected))], "season bigint")
    present = df.select(parse_strict_integer(F.col(season)).alias("season")).distinct()
    return wanted.join(present, "season", "left_anti")


def sum_violations(df: DataFrame, total: str, first: str, second: str) -> DataFrame:
    """Rows where total <> first + second; rows with any of them missing pass."""
    t, a, b = (parse_number(F.col(c), integer=True) for c in (total, first, second))
    return df.filter(t != a + b)


def stat_violations(df: DataFrame, kind: str) -> DataFrame:
    fields = {
        "skater": ("points", "goals", "assists"),
        "goalie": ("shotsAgainst", "saves", "goalsAgainst"),
    }[kind]
    return sum_violations(df, *fields)


def _not_whole(c: str) -> Column:
    number = parse_strict_integer(F.col(c))
    return number.isNull()


def _negative_or_bad(c: str) -> Column:
    number = parse_strict_integer(F.col(c))
    return number.isNull() | (number < 0)


def _bad_amount(c: str) -> Column:
    number = parse_number(F.col(c))
    return number.isNull() | (number < 0)


# per feed: field -> predicate that is true when the field is unusable
TYPED_CHECKS = {
    "advanced": {
        "playerId": _not_whole,
        "season": lambda c: bad_season(F.col(c)),
        "name": lambda c: is_blank(F.col(c)),
        "situation": lambda c: is_blank(F.col(c)),
        "games_played": _negative_or_bad,
        "icetime": _bad_amount,
    },
    "skater": {
        "playerId": _not_whole,
        "gamesPlayed": _negative_or_bad,
        "goals": _negative_or_bad,
        "assists": _negative_or_bad,
        "points": _negative_or_bad,
    },
    "goalie": {
        "playerId": _not_whole,
        "gamesPlayed": _negative_or_bad,
        "shotsAgainst": _negative_or_bad,
        "saves": _negative_or_bad,
        "goalsAgainst": _negative_or_bad,
    },
}


def typed_violations(df: DataFrame, feed: str) -> DataFrame:
    """Rows with unusable typed fields, and the list of those fields."""
    named = [F.when(bad(c), c) for c, bad in TYPED_CHECKS[feed].items()]
    flagged = df.withColumn("bad_fields", F.array_compact(F.array(*named)))
    return flagged.filter(F.size("bad_fields") > 0)


def page_problems(pages: DataFrame, job: Sequence[str], limit: int) -> DataFrame:
    """Incomplete paged downloads.

    ``pages`` has the job columns, ``page`` (its place), ``total`` (nullable)
    and ``size`` (rows on the page) and ``no_id`` (rows without an id).
    """
    found = pages.groupBy(*job).agg(
        F.min("total").alias("_least_total"),
        F.max("total").alias("_total"),
        F.sum("size").alias("_rows"),
        F.max("size").alias("_largest"),
        F.sum("no_id").alias("_no_id"),
        F.min(F.when(F.col("size") == 0, F.col("page"))).alias("_empty_at"),
        F.max("page").alias("_last_page"),
        F.max_by("size", "page").alias("_last_size"),
    )
    problem = (
        F.when(F.col("_least_total") != F.col("_total"), "total changed between pages")
        .when(F.col("_largest") > limit, "page exceeds requested limit")
        .when(F.col("_no_id") > 0, "row is missing its id")
        .when(F.col("_empty_at").isNotNull() & (F.col("_rows") < F.col("_total")), "empty page before total was reached")
        .when(F.col("_rows") > F.col("_total"), "received more rows than total")
        .when(F.col("_rows") < F.col("_total"), "fewer rows than total")
        .when(F.col("_total").isNull() & (F.col("_last_size") == limit), "last page is full and no total is known")
        .when(F.col("_rows") == 0, "no rows")
    )
    return found.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(*job, "problem")


# --- thresholds and options --------------------------------------------------------


# fixed values: completeness floors of the default loads
FLOORS = {"teams": 30, "active_players": 500, "games": 100, "index_rows": 500}
MINIMUM_PROFILE_SUCCESS = 0.98


def assert_min_rows(df: DataFrame, minimum: int, what: str) -> None:
    found = df.limit(minimum).count()
    if found < minimum:
        raise QualityError(f"{what}: {found} rows, at least {minimum} needed")


def success_ratio(df: DataFrame, ok: Column) -> DataFrame:
    return df.agg(F.avg(F.when(ok, 1.0).otherwise(0.0)).alias("success_ratio"))


def assert_success(df: DataFrame, ok: Column, minimum: float = MINIMUM_PROFILE_SUCCESS) -> None:
    ratio = success_ratio(df, ok).first()[0]
    if ratio is None or ratio < minimum:
        raise QualityError(f"success ratio {ratio} is below {minimum}")


def cap_share_violations(df: DataFrame, share: str = "cap_percentage") -> DataFrame:
    return df.filter(F.col(share) > 1)


def sequence_violations(df: DataFrame, contract: Sequence[str], season: str) -> DataFrame:
    """Contracts whose seasons repeat or leave a gap."""
    spans = df.groupBy(*contract).agg(
        F.count(season).alias("rows"),
        F.count_distinct(season).alias("seasons"),
        (F.max(season) - F.min(season) + 1).alias("span"),
    )
    return spans.filter((F.col("rows") != F.col("seasons")) | (F.col("seasons") != F.col("span")))


def check_quality_options(minimum_rows: int, maximum_duplicate_ratio: float) -> None:
    if minimum_rows < 0 or not (
        math.isfinite(maximum_duplicate_ratio) and 0 <= maximum_duplicate_ratio <= 1
    ):
        raise QualityError("minimum rows must be >= 0 and the duplicate ratio within [0, 1]")


def check_ordered(first: int | None, last: int | None) -> None:
    if first is not None and last is not None and first > last:
        raise QualityError("season range must be ordered")


def check_feature_options(min_games: int, percentile: float, normalizer: float = 1.0) -> None:
    if min_games < 1:
        raise QualityError("minimum games must be at least 1")
    if not 0 <= percentile <= 1:
        raise QualityError("replacement percentile must be within [0, 1]")
    if not (math.isfinite(normalizer) and normalizer > 0):
        raise QualityError("salary-cap normaliser must be a positive number")


# --- table constraints ---------------------------------------------------------------


def check_violations(df: DataFrame, table: str) -> DataFrame:
    """(check, rows) for each CHECK that fails; a null predicate passes."""
    checks = schemas.CHECKS.get(table, [])
    if not checks:
        return df.sparkSession.createDataFrame([], "check string, rows bigint")
    counted = df.agg(*[F.count_if(~F.expr(rule)).alias(name) for name, rule in checks])
    return counted.unpivot([], [name for name, _ in checks], "check", "rows").filter("rows > 0")


def unique_violations(df: DataFrame, key: schemas.UniqueKey) -> DataFrame:
    """Key values that occur more than once (keys with a null are never equal)."""
    names = [f"key_{i}" for i in range(len(key.exprs))]
    keyed = df.filter(key.where).select(*[F.expr(e).alias(n) for n, e in zip(names, key.exprs)])
    counted = keyed.dropna().groupBy(*names).agg(F.count(F.lit(1)).alias("rows"))
    return counted.filter(F.col("rows") > 1)


def foreign_key_violations(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Distinct child values without a parent row."""
    values = child.select(F.col(column).alias("value")).filter("value is not null").distinct()
    return values.join(parent.select(F.col(key).alias("value")), "value", "left_anti")


def constraint_report(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(table, rule, violations) for every declared constraint of the given tables."""
    parts = []
    for table, df in tables.items():
        checks = schemas.CHECKS.get(table, [])
        if checks:  # every check of a table in one pass
            names = [f"check {name}" for name, _ in checks]
            counts = df.agg(*[F.count_if(~F.expr(e)).alias(n) for n, (_, e) in zip(names, checks)])
            parts.append((table, counts.unpivot([], names, "rule", "violations")))
        broken = [(f"unique {k.name}", unique_violations(df, k)) for k in schemas.UNIQUE_KEYS.get(table, [])]
        for column, parent, pk in schemas.FOREIGN_KEYS.get(table, []):
            if parent in tables:
                orphans = foreign_key_violations(df, column, tables[parent], pk)
                broken.append((f"foreign key {column}", orphans))
        for rule, rows in broken:
            counted = rows.agg(F.count(F.lit(1)).alias("violations"))
            parts.append((table, counted.select(F.lit(rule).alias("rule"), "violations")))
    named = [p.select(F.lit(t).alias("table"), "rule", "violations") for t, p in parts]
    return reduce(DataFrame.unionByName, named)


# --- frames --------------------------------------------------------------------------


def infinite_columns(df: DataFrame) -> DataFrame:
    """(column, rows) for float columns that hold an infinity."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (DoubleType, FloatType))]
    if not floats:
        return df.sparkSession.createDataFrame([], "column string, rows bigint")
    counted = df.agg(*[F.count_if(F.abs(c) == float("inf")).alias(c) for c in floats])
    return counted.unpivot([], floats, "column", "rows").filter("rows > 0")


def grain_violations(df: DataFrame, grain: Sequence[str]) -> DataFrame:
    """Grain values that are null or repeated."""
    counted = df.groupBy(*grain).agg(F.count(F.lit(1)).alias("rows"))
    has_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in grain])
    return counted.filter(has_null | (F.col("rows") > 1))


def assert_frame(df: DataFrame, required: Sequence[str], grain: Sequence[str]) -> None:
    """Columns exist once, the grain is filled and unique, no infinities."""
    assert_columns(df, required)
    if len(set(df.columns)) != len(df.columns):
        raise QualityError("repeated column names")
    assert_none(grain_violations(df, grain), "grain")
    assert_none(infinite_columns(df), "infinite values")


# fixed values: contract columns that must never be model inputs
CONTRACT_COLUMNS = [
    "contract_id",
    "contract_type",
    "average_value_cents",
    "cap_hit_cents",
    "cap_percentage",
    "actual_cap_hit",
    "aav",
]


def assert_no_leakage(df: DataFrame) -> None:
    leaked = sorted(set(CONTRACT_COLUMNS) & set(df.columns))
    if leaked:
        raise QualityError(f"contract columns in the feature frame: {', '.join(leaked)}")


def schema_drift(df: DataFrame, saved: str) -> DataFrame:
    """(column, change, was, now) against a schema saved with ``df.schema.json()``."""
    was = {f["name"]: json.dumps(f["type"]) for f in json.loads(saved)["fields"]}
    now = {f["name"]: json.dumps(f["type"]) for f in df.schema.jsonValue()["fields"]}
    rows = [(c, "removed", was[c], None) for c in was if c not in now]
    rows += [(c, "added", None, now[c]) for c in now if c not in was]
    rows += [(c, "retyped", was[c], now[c]) for c in was if c in now and was[c] != now[c]]
    return df.sparkSession.createDataFrame(rows, "column string, change string, was string, now string")


# --- diagnostics ----------------------------------------------------------------------


def frame_summary(df: DataFrame, entity: str, season: str, covered: Sequence[str] = ()) -> DataFrame:
    """One row: rows, entities, season range, duplicate grain rows, filled counts."""
    per_key = df.groupBy(entity, season).agg(
        F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(f"with_{c}") for c in covered]
    )
    per_entity = per_key.groupBy(entity).agg(
        F.sum("_n").alias("_n"),
        F.sum(F.col("_n") - 1).alias("_dup"),
        F.min(season).alias("_first"),
        F.max(season).alias("_last"),
        *[F.sum(f"with_{c}").alias(f"with_{c}") for c in covered],
    )
    return per_entity.agg(
        F.sum("_n").alias("rows"),
        F.count(entity).alias("entities"),
        F.min("_first").alias("first_season"),
        F.max("_last").alias("last_season"),
        F.sum("_dup").alias("duplicate_rows"),
        *[F.sum(f"with_{c}").alias(f"with_{c}") for c in covered],
    )


def rows_by(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("rows"))


def nulls_by_column(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, nulls) for every (numeric) column, most nulls first."""
    names = columns or [f.name for f in df.schema if isinstance(f.dataType, NumericType)]
    counted = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return counted.unpivot([], names, "column", "nulls").orderBy(F.desc("nulls"), "column")
