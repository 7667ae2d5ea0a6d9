"""Mixing sources to target weights by capped water-filling, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rinkline.llm.common import staged

WORD = "[^\\x20\\x09-\\x0D]+"
#: A source's size may be taken so many times at most.
MOST_EPOCHS = 3
SEED = 17
#: Hash ranges of a source; all below the cut are taken whole.
RANGES = 4096
#: About so many documents of each source are kept apart to bring the sum to the target.
FILLERS = 256
#: Up to so many sources their plan (a few hundred keys each) goes to every task; else it is joined as Spark finds best.
FEW_SOURCES = 1000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sources: DataFrame, budget: Column | None = None, most_epochs: int = MOST_EPOCHS) -> DataFrame:
    """Targets of sources (source, source_size, weight): shares of the budget by weight, none above its cap.

    A cap is ``most_epochs`` times the source's size. Repeating "clamp what is
    above, share the excess by weight" ends at one water level: with sources in
    ascending order of cap by weight, the first k are clamped and the others
    get weight * (budget - their caps) / (the others' weights), for the least k
    that puts none above its cap. Running sums give all k at once; from that k on
    the level only falls, so it is the highest of the levels that fit. The table has a row
    per source, as the table of weights that a mix is asked for with; it is not
    as long as the corpus. Without a budget the sum of all sizes is shared.
    Sources of weight zero get nothing.
    """
    cap = (F.col("source_size") * most_epochs).alias("cap")
    live = F.col("weight") > 0
    rows = sources.select("*", cap, F.when(live, F.col("source_size") * most_epochs / F.col("weight")).alias("ratio"))
    everyone = Window.partitionBy()
    upto = Window.orderBy(F.col("ratio").asc_nulls_last(), F.col("source").asc_nulls_last())
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(everyone) if budget is None else budget
    clamped = F.coalesce(F.sum(F.when(live, F.col("cap"))).over(before), F.lit(0))
    rest = F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = F.when(live, (total - clamped) / rest)
    stops = rows.withColumn("level", level).withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(everyone))
    target = F.when(~live, 0.0).when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("weight") * F.col("level"), F.col("cap")))
    return stops.withColumn("target", target.cast("double")).drop("cap", "ratio", "level")


def mix_sources(docs: DataFrame, weights, budget: Column | None = None, most_epochs: int = MOST_EPOCHS, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text, source) with size, source_size, target, repetitions and taken.

    ``weights`` is a function from the sources (source, source_size) to the same
    rows with a ``weight``. A source's target is met by whole repetitions of all
    its documents and, for the fraction that is left, once more a seeded part of
    them: hash ranges are taken whole up to the cut, and about ``FILLERS``
    documents kept apart are added in hash order, each if it still fits, and one
    more if that comes nearer.

    No document is taken more than ``most_epochs`` times. Equal rows (same
    doc_id, source and text) share one decision. Null and empty texts have size
    0 and are taken as often as the whole repetitions say. A null source is a
    source of its own, last in order. Columns named like the new ones are
    replaced. An empty table gives an empty result.
    """
    new = ("size", "source_size", "target", "repetitions", "taken")
    kept = [f"`{c}`" for c in docs.columns if c not in new]
    digest = F.md5(F.concat_ws("\x1f", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce(F.md5("text"), F.lit(""))))
    measured = docs.select(*kept, word_count(F.col("text")).alias("size"), digest.alias("_key"))
    measured = measured.withColumn("_range", F.conv(F.substring("_key", 1, 3), 16, 10).cast("int")).withColumn("_draw", F.conv(F.substring("_key", 4, 8), 16, 10).cast("double") / (1 << 32))
    narrow = staged(measured.select("source", "size", "_key", "_range", "_draw"), "mix")

    same = F.col("source").eqNullSafe(F.col("_source"))
    totals = narrow.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    targets = water_fill(weights(totals), budget, most_epochs)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most_epochs))).otherwise(0)
    targets = targets.withColumn("_whole", whole.cast("long")).withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    targets = targets.withColumn("_rest", F.when(F.col("_whole") < most_epochs, F.col("_rest")).otherwise(0.0)).withColumn("_chance", F.lit(float(FILLERS)) / F.col("_n"))
    targets = targets.withColumn("_no", F.row_number().over(Window.orderBy("source")))
    targets = staged(targets.withColumnRenamed("source", "_source"), "targets")

    known = narrow.join(targets.select("_source", "_no", "_rest", "_chance"), same)
    filler = F.col("_draw") < F.col("_chance")
    by_range = known.groupBy("_no", "_range").agg(F.sum(F.when(~filler, F.col("size")).otherwise(0)).alias("_plain"), F.first("_rest").alias("_rest"))
    running = Window.partitionBy("_no").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    by_range = by_range.withColumn("_upto", F.sum("_plain").over(running))
    cuts = by_range.where("_upto <= _rest").groupBy("_no").agg(F.max("_range").alias("_cut"), F.max("_upto").alias("_got"))
    # Equal rows are one filler, with their sizes together.
    fillers = known.where(filler).groupBy("_no", "_key").agg(F.sum("size").alias("size"))
    fillers = fillers.groupBy("_no").agg(F.array_sort(F.collect_list(F.struct("_key", "size"))).alias("_list"))
    fill = F.aggregate(
        "_list",
        F.struct((F.col("_rest") - F.coalesce(F.col("_got"), F.lit(0))).cast("double").alias("left"), F.array().cast("array<string>").alias("keys")),
        lambda a, x: F.when((x["size"] > 0) & (x["size"] <= a["left"]), F.struct((a["left"] - x["size"]).cast("double").alias("left"), F.array_append(a["keys"], x["_key"]).alias("keys"))).otherwise(a),
    )
    # What is left then is less than any other filler: one more is added if that comes nearer.
    spare = F.filter("_list", lambda x: (x["size"] > 0) & (x["size"] < 2 * F.col("_fill.left")) & ~F.array_contains("_fill.keys", x["_key"]))
    last = F.array_min(F.transform(spare, lambda x: F.struct(F.abs(x["size"] - F.col("_fill.left")).alias("off"), x["_key"].alias("key"))))["key"]
    chosen = F.coalesce(F.when(last.isNotNull(), F.array_append("_fill.keys", last)).otherwise(F.col("_fill.keys")), F.array().cast("array<string>"))
    plan = targets.join(cuts, "_no", "left").join(fillers, "_no", "left").withColumn("_fill", F.when(F.col("_list").isNotNull(), fill))
    plan = staged(plan.select("_source", "source_size", "target", "_whole", "_chance", F.coalesce("_cut", F.lit(-1)).alias("_cut"), chosen.alias("_keys")), "mix-plan")
    if plan.count() <= FEW_SOURCES:
        plan = F.broadcast(plan)

    once = F.when(F.col("_draw") < F.col("_chance"), F.array_contains("_keys", F.col("_key"))).otherwise(F.col("_range") <= F.col("_cut"))
    out = measured.join(plan, same).withColumn("repetitions", F.col("_whole") + once.cast("long")).withColumn("taken", F.col("repetitions") * F.col("size"))
    return out.select(*kept, *new)


def repeating_weights(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Weights dealt in turn to the sources in code-point order, null last."""
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
