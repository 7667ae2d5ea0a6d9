"""Exact interpolated quantiles per group that never gather a group in one task, one path for every size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rinkline.session import staged

ACCURACY = 10_000


def group_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], p: float) -> DataFrame:
    """Linear-interpolated ``p`` quantile of each column per group, nulls skipped."""
    return named_quantiles(df, keys, {c: (c, p) for c in columns})


def named_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    wanted: Mapping[str, tuple[str, float]],
    accuracy: int = ACCURACY,
    margins: Sequence[float] | None = None,
) -> DataFrame:
    """One row per group with a column per name: the (column, p) quantile, as a double.

    ``df`` must be a stored frame (a table or ``staged``): it is read twice, and the
    small results of both passes are stored. A mergeable sketch brackets each wanted rank, one aggregate counts what lies
    beside the bracket and the few values inside it, and the answer is picked
    by exact rank. A group whose rank lies outside its bracket (the sketch's
    bound rules that out for the default margins) is done again with an open one.
    """
    # a bracket must hold a few ranks on either side, so small groups take a wide
    # one and groups of a handful of rows (no margin fits) take every value
    margins = [3.0 / accuracy, 0.01, 0.1] if margins is None else margins
    columns = {name: F.col(c).cast("double").alias(name) for name, (c, _) in wanted.items()}
    rows = df.select(*keys, *columns.values())

    def sketched(name: str, p: float) -> Column:
        points = [max(p - m, 0.0) for m in margins] + [min(p + m, 1.0) for m in margins]
        at = F.percentile_approx(name, F.array(*map(F.lit, points)), accuracy)
        return F.struct(F.count(name).alias("n"), at.alias("at")).alias(name)

    def tall(frame: DataFrame) -> DataFrame:
        cells = [
            F.struct(F.lit(name).alias("_m"), F.lit(p).alias("_p"), F.col(name).alias("_v"))
            for name, (_, p) in wanted.items()
        ]
        return frame.select(*keys, F.inline(F.array(*cells)))

    def end(first: int, sign: int) -> Column:
        """Bracket end by group size; an end at the edge of the range stays open."""
        picked = F.lit(None).cast("double")
        for i, m in reversed(list(enumerate(margins))):
            edge = F.col("_p") + sign * m
            inner = F.when((edge > 0) & (edge < 1), F.col("_v.at")[first + i])
            picked = F.when(F.col("_v.n") * m >= 3, inner).otherwise(picked)
        return picked

    sketches = tall(staged(rows.groupBy(*keys).agg(*[sketched(name, p) for name, (_, p) in wanted.items()]), "sketches"))
    brackets = sketches.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_m").alias("_k_m"),
        end(0, -1).alias("_low"),
        end(len(margins), 1).alias("_high"),
    )
    values = tall(rows).filter(F.col("_v").isNotNull())
    found = staged(_picked(values, brackets, keys), "quantiles")
    missed = found.filter("_outside").select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_m").alias("_k_m"),
        F.lit(None).cast("double").alias("_low"),
        F.lit(None).cast("double").alias("_high"),
    )
    again = _picked(values, missed, keys)
    every = found.filter(~F.col("_outside")).unionByName(again)
    # a group of nulls only has no value to pick, but still its row
    every = every.select(*keys, "_m", "_q").unionByName(
        sketches.select(*keys, "_m", F.lit(None).cast("double").alias("_q"))
    )
    return every.groupBy(*keys).agg(
        *[F.max(F.when(F.col("_m") == name, F.col("_q"))).alias(name) for name in wanted]
    )


def _picked(values: DataFrame, brackets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _m, _q, _outside): the exact quantile if its ranks lie within the bracket."""
    same = F.col("_m") == F.col("_k_m")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    value = F.col("_v")
    side = F.when(value < F.col("_low"), -1).when(value > F.col("_high"), 1).otherwise(0)
    counted = (
        values.join(brackets, same)
        .select(*keys, "_m", "_p", side.alias("_side"), F.when(side == 0, value).alias("_v"))
        .groupBy(*keys, "_m", "_p", "_side", "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # only the bracket's distinct values remain per group: a sliver of its rows
    group = Window.partitionBy(*keys, "_m")
    ranked = counted.select(
        *keys,
        "_m",
        "_side",
        "_v",
        (F.col("_p") * (F.sum("_n").over(group) - 1)).alias("_position"),
        F.sum("_n")
        .over(group.orderBy("_side", "_v").rowsBetween(Window.unboundedPreceding, 0))
        .alias("_upto"),
    )

    def at(rank: Column) -> Column:
        row = F.struct("_upto", "_side", "_v")
        return F.min(F.when(F.col("_upto") >= rank + 1, row))

    picked = ranked.groupBy(*keys, "_m").agg(
        F.first("_position").alias("_position"),
        at(F.floor("_position")).alias("_lower"),
        at(F.ceil("_position")).alias("_upper"),
    )
    outside = (F.col("_lower._side") != 0) | (F.col("_upper._side") != 0)
    step = F.col("_position") - F.floor("_position")
    lower, upper = F.col("_lower._v"), F.col("_upper._v")
    return picked.select(*keys, "_m", (lower + (upper - lower) * step).alias("_q"), outside.alias("_outside"))


def quantile_tiers(df: DataFrame, column: str, name: str, bins: int = 5) -> DataFrame:
    """Tier 0.. by quantile edges, right-closed, lowest value included, equal edges merged.

    With fewer than two distinct edges there is no bin and every tier is null.
    All edges are found in one pass and joined as one row.
    """
    stored = staged(df, "tiers")
    wanted = {f"_e{i}": (column, i / bins) for i in range(bins + 1)}
    one = stored.select(F.lit(1).alias("_all"), column)
    edges = named_quantiles(one, ["_all"], wanted).select(
        F.array_sort(F.array_distinct(F.filter(F.array(*wanted), lambda e: e.isNotNull()))).alias("_edges")
    )
    inner = F.filter(F.slice("_edges", 2, F.greatest(F.size("_edges") - 2, F.lit(0))), lambda e: F.col(column) > e)
    tier = F.when(F.col(column).isNotNull() & (F.size("_edges") >= 2), F.size(inner)).cast("int")
    return stored.join(F.broadcast(edges), F.lit(True), "left").withColumn(name, tier).drop("_edges")
