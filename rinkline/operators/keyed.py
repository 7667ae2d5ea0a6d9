"""Kernels over keyed rows: one row per key, preferred totals, gaps, intervals.

All take column names, so the same code runs on any entity and period.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of every key under ``order``.

    A row_number filtered to 1 lets Spark keep one row per key on the map
    side (WindowGroupLimit) before anything is shuffled, so a hot key sends
    at most one row per task.
    """
    return top_per_key(df, keys, order, 1)


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None
) -> DataFrame:
    """The first ``n`` rows of every key, optionally with their rank as a column."""
    name = rank or "_rank"
    window = Window.partitionBy(*keys).orderBy(*order)
    kept = df.withColumn(name, F.row_number().over(window)).filter(F.col(name) <= n)
    return kept if rank else kept.drop(name)


def prefer_total(
    df: DataFrame,
    keys: Sequence[str],
    measures: Mapping[str, Column],
    scope: str = "stat_scope",
    total: str = "TOTAL",
) -> DataFrame:
    """Sum the total rows of a key where it has any, else all its other rows.

    One grouped aggregate with two sums per measure: combined on the map
    side, no self-join and no window over a key's rows. A sum over nulls
    only stays null.
    """
    is_total = F.coalesce(F.col(scope) == total, F.lit(False))
    sums = [
        F.sum(F.when(flag, value)).alias(f"{side}_{name}")
        for name, value in measures.items()
        for side, flag in (("t", is_total), ("p", ~is_total))
    ]
    grouped = df.groupBy(*keys).agg(F.max(is_total).alias("_has_total"), *sums)
    return grouped.select(
        *keys,
        *[
            F.when(F.col("_has_total"), F.col(f"t_{name}"))
            .otherwise(F.col(f"p_{name}"))
            .alias(name)
            for name in measures
        ],
    )


def prefer_newest_total(
    df: DataFrame,
    keys: Sequence[str],
    totals: Mapping[str, Column],
    parts: Callable[[Callable[[Column], Column]], Mapping[str, Column]],
    newest: Sequence[Column],
    scope: str = "stat_scope",
    total: str = "TOTAL",
    part: str = "TEAM",
) -> DataFrame:
    """The newest total row of a key (largest ``newest``), else aggregates over its part rows.

    ``parts`` builds its aggregates with a function that blanks a column on other
    rows. One grouped aggregate: the newest total travels as the largest
    (``newest``, values) struct next to the part sums, so nothing is read twice
    and a hot key sends one row per task.
    """
    is_total = F.coalesce(F.col(scope) == total, F.lit(False))
    is_part = F.coalesce(F.col(scope) == part, F.lit(False))
    order = F.struct(*[c.alias(f"_{i}") for i, c in enumerate(newest)])
    values = F.struct(*[v.alias(name) for name, v in totals.items()])
    grouped = df.filter(is_total | is_part).groupBy(*keys).agg(
        F.max_by(values, F.when(is_total, order)).alias("_total"),
        F.max(is_total).alias("_has_total"),
        *[v.alias(f"_p_{name}") for name, v in parts(lambda c: F.when(is_part, c)).items()],
    )
    return grouped.select(
        *keys,
        *[
            F.when(F.col("_has_total"), F.col(f"_total.{name}")).otherwise(F.col(f"_p_{name}")).alias(name)
            for name in totals
        ],
    )


def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Null-safe equality on every key (still a hash join for Spark)."""
    return reduce(
        lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys], F.lit(True)
    )


def absent_from(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key does not occur in ``other`` (nulls compare equal)."""
    probe = other.select(*[F.col(k).alias(f"_o_{k}") for k in keys])
    match = reduce(
        lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_o_{k}")) for k in keys]
    )
    return df.join(probe, match, "left_anti")


def present_in(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``df`` whose key occurs in ``other``."""
    return df.join(other.select(*keys), list(keys), "left_semi")


def coverage_gap(expected: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct expected keys that are not covered."""
    return expected.select(*keys).distinct().join(present.select(*keys), list(keys), "left_anti")


def flag_members(df: DataFrame, members: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """A boolean column: is the composite key one of ``members``?"""
    marked = members.select(*keys).distinct().withColumn(name, F.lit(True))
    return df.join(marked, list(keys), "left").withColumn(
        name, F.coalesce(F.col(name), F.lit(False))
    )


def only_if_single(df: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys held by exactly one row, with that row's values; ambiguous keys vanish.

    Aggregated (count plus any value), so a key shared by very many rows
    collapses on the map side.
    """
    counted = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(v).alias(v) for v in values]
    )
    return counted.filter(F.col("_n") == 1).drop("_n")


def active_on(df: DataFrame, day: Column, start: str, end: str) -> DataFrame:
    """Rows whose closed interval holds the date; a null end never closes."""
    return df.filter(
        (F.col(start) <= day) & (F.col(end).isNull() | (F.col(end) >= day))
    )


def inside_interval(
    points: DataFrame,
    intervals: DataFrame,
    key: str,
    at: str,
    start: str,
    end: str,
    bucket_days: int = 32,
) -> DataFrame:
    """Distinct (key, date) points that lie in one of the key's closed intervals.

    Points collapse to distinct dates. Intervals are cut into calendar
    buckets, so the join is an equi join on (key, bucket): one busy key
    spreads over its buckets, and within a bucket overlapping pieces are
    merged first, so a date meets only disjoint pieces.
    """
    dates = points.select(key, F.to_date(at).alias("_at")).distinct()
    bucket = F.floor(F.unix_date(F.col("_at")) / bucket_days)
    horizon = dates.agg(F.max("_at")).scalar()  # open intervals end at the last date asked for
    day_from = F.unix_date(F.to_date(start))
    day_to = F.unix_date(F.least(F.to_date(end), horizon))
    spans = (
        intervals.select(key, day_from.alias("_from"), day_to.alias("_to"))
        .filter(F.col("_from") <= F.col("_to"))
        .distinct()
        .withColumn(
            "_bucket",
            F.explode(
                F.sequence(
                    F.floor(F.col("_from") / bucket_days), F.floor(F.col("_to") / bucket_days)
                )
            ),
        )
        .select(
            key,
            "_bucket",
            F.greatest("_from", F.col("_bucket") * bucket_days).alias("_from"),
            F.least("_to", F.col("_bucket") * bucket_days + (bucket_days - 1)).alias("_to"),
        )
        .distinct()
    )
    # days covered in a bucket as a bit mask: overlapping pieces merge by OR,
    # which also combines on the map side
    low = F.col("_from") - F.col("_bucket") * bucket_days
    length = F.col("_to") - F.col("_from") + 1
    mask = F.call_function(
        "shiftleft",
        F.call_function("shiftleft", F.lit(1).cast("bigint"), length.cast("int")) - 1,
        low.cast("int"),
    )
    covered = spans.groupBy(key, "_bucket").agg(F.bit_or(mask).alias("_days"))
    shift = (F.unix_date(F.col("_at")) - F.col("_bucket") * bucket_days).cast("int")
    return (
        dates.withColumn("_bucket", bucket)
        .join(covered, [key, "_bucket"])
        .filter(F.call_function("shiftright", F.col("_days"), shift).bitwiseAND(F.lit(1)) == 1)
        .select(key, F.col("_at").alias(at))
    )
