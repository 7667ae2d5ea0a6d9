"""Idempotent merges of snapshots into parquet tables.

A merge is planned as a frame (one row per target key with an ``_action``)
and applied separately, so a dry run is the same plan without the sink.
Rows missing from the new snapshot are always retained.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkline import schemas
from rinkline.operators.keyed import absent_from, first_per_key
from rinkline.session import staged

CREATED, UPDATED, KEPT = "created", "updated", "kept"
#: Partition values that are pushed to a scan as a filter, at most.
PUSHED_VALUES = 1000


def _rule(rule: str, old: Column, new: Column) -> Column:
    """Value of a matched row's column under a precedence rule."""
    if rule == "new":
        return new
    if rule == "new_or_old":
        return F.coalesce(new, old)
    if rule == "old_or_new":
        return F.coalesce(old, new)
    if rule == "either":
        return F.coalesce(old, F.lit(False)) | F.coalesce(new, F.lit(False))
    if rule == "old_unless_empty_json":
        return F.when(old.isNull() | (old == "{}"), new).otherwise(old)
    if rule == "old":
        return old
    raise ValueError(f"unknown rule {rule!r}")


def merge_plan(
    existing: DataFrame,
    incoming: DataFrame,
    keys: Sequence[str],
    rules: Mapping[str, str],
    default: str = "old",
) -> DataFrame:
    """Full outer merge on null-safe keys, one rule per matched column.

    ``incoming`` must hold one row per key (see ``last_per_grain``). Columns
    it lacks keep the old value. The result has the existing columns plus
    ``_action``.
    """
    columns = existing.columns
    had, got = F.col("_had").isNotNull(), F.col("_got").isNotNull()
    old = existing.select(*[F.col(c).alias(f"o_{c}") for c in columns], F.lit(True).alias("_had"))
    offered = [c for c in columns if c in incoming.columns]
    new = incoming.select(*[F.col(c).alias(f"n_{c}") for c in offered], F.lit(True).alias("_got"))
    match = F.lit(True)
    for k in keys:
        match = match & F.col(f"o_{k}").eqNullSafe(F.col(f"n_{k}"))
    out = []
    for c in columns:
        was = F.col(f"o_{c}")
        if c not in offered:
            out.append(was.alias(c))
            continue
        now = F.col(f"n_{c}").cast(existing.schema[c].dataType)
        both = was if c in keys else _rule(rules.get(c, default), was, now)
        out.append(F.when(~had, now).when(got, both).otherwise(was).alias(c))
    action = F.when(~had, CREATED).when(got, UPDATED).otherwise(KEPT).alias("_action")
    had, got = F.coalesce(F.col("_had"), F.lit(False)), F.coalesce(F.col("_got"), F.lit(False))
    return old.join(new, match, "full_outer").select(*out, action)


def last_per_grain(incoming: DataFrame, grain: Sequence[str], order: str = "_ord") -> DataFrame:
    """The last row of each grain by an explicit order column."""
    return first_per_key(incoming, grain, [F.col(order).desc()])


def merge_counts(plan: DataFrame) -> DataFrame:
    """One row: records created, updated and kept."""
    return plan.agg(
        F.count_if(F.col("_action") == CREATED).alias("records_created"),
        F.count_if(F.col("_action") == UPDATED).alias("records_updated"),
        F.count_if(F.col("_action") == KEPT).alias("records_kept"),
    )


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Incoming rows whose key is new, one per key."""
    fresh = absent_from(incoming, existing, keys)
    return first_per_key(fresh, keys, [F.col(c) for c in fresh.columns if c not in keys] or [F.lit(1)])


def stat_rules(kind: str, advanced: bool) -> dict[str, str]:
    """Every metric, the row hash and the update time take the incoming value."""
    columns = [m.column for m in schemas.layout(kind, advanced)]
    tail = ["source_row_hash", "updated_at"] + (["extra_metrics"] if advanced else [])
    return {c: "new" for c in columns + tail}


def stat_grain(advanced: bool) -> list[str]:
    grain = ["player_id", "season_start_year", "team_id", "stat_scope", "game_type"]
    return grain + (["situation"] if advanced else []) + ["source_id"]


def merge_stats(existing: DataFrame, incoming: DataFrame, kind: str, advanced: bool) -> DataFrame:
    """Plan of a stat upsert; team null and 0 are the same key by null-safe match."""
    return merge_plan(existing, incoming, stat_grain(advanced), stat_rules(kind, advanced))


def merge_schedule(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Games: a known game only refreshes its state, scores and sync time."""
    mutable = ["game_state", "away_score", "home_score", "last_synced_at"]
    return merge_plan(existing, incoming, ["nhl_game_id"], {c: "new" for c in mutable})


def apply_merge(plan: DataFrame, path: str, partition: str | None = None) -> DataFrame:
    """Write a plan over the table at ``path`` and return its counts.

    The plan is staged first because it reads the table it replaces. With a
    partition column only the partitions it holds are overwritten: read the
    existing side through ``touched`` so that untouched ones are never read.
    """
    result = staged(plan, "merge")
    rows = result.drop("_action")
    if partition is not None:
        out = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        out.partitionBy(partition).parquet(path)
    else:
        replace_table(rows, path)
    return merge_counts(result)


def replace_table(rows: DataFrame, path: str) -> None:
    """Write a whole table beside the one at ``path``, then switch the two folders.

    The only copy is never half written: until the switch readers see the old
    table, and if the switch is cut short one of the two folders is complete.
    """
    spark = rows.sparkSession
    fresh, former = f"{path}.new-{uuid4().hex}", f"{path}.old-{uuid4().hex}"
    rows.write.parquet(fresh)
    of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    store = of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if store.exists(of(path)):
        store.rename(of(path), of(former))
    if not store.rename(of(fresh), of(path)):
        raise OSError(f"could not move {fresh} to {path}")
    store.delete(of(former), True)
    spark.catalog.refreshByPath(path)


def touched(existing: DataFrame, incoming: DataFrame, partition: str) -> DataFrame:
    """Existing rows in the partitions that the incoming rows fall in, pruned at the scan.

    Their values (seasons, at most ``PUSHED_VALUES`` of them) become a filter on
    the partition column; more than that are joined. Rows without a value are
    touched by incoming rows without one.
    """
    values = incoming.select(partition).distinct()
    found = [r[0] for r in values.limit(PUSHED_VALUES + 1).collect()]
    if len(found) > PUSHED_VALUES:
        same = F.col(partition).eqNullSafe(F.col("_value"))
        return existing.join(values.withColumnRenamed(partition, "_value"), same, "left_semi")
    kept = F.col(partition).isin([v for v in found if v is not None])
    return existing.filter(kept | F.col(partition).isNull() if None in found else kept)


# --- run ledger -----------------------------------------------------------------

# fixed values: summary entries that describe a run but are not records
DIMENSIONS = {"players", "teams", "cached", "profile_failures"}


def _whole(value: object) -> bool:
    return type(value) is int and value >= 0


def ingested_records(summary: Mapping[str, object]) -> int:
    """Sum of the non-negative integer counts of a summary, dimensions excluded."""
    return sum(v for k, v in summary.items() if k not in DIMENSIONS and _whole(v))


def summary_count(summary: Mapping[str, object], key: str, default: int = 0) -> int:
    value = summary.get(key, default)
    return value if _whole(value) else default


def collected_counts(summary: Mapping[str, object]) -> dict[str, int]:
    """Fetched and committed counts; committed only if a write count is present."""
    out: dict[str, int] = {}
    if type(summary.get("records_read")) is int:
        out["fetched"] = summary["records_read"]
    writes = [summary.get(k, 0) for k in ("records_created", "records_updated")]
    named = "records_created" in summary or "records_updated" in summary
    if named and all(type(w) is int for w in writes):
        out["committed"] = sum(writes)
    return out


def progress_counts(summary: Mapping[str, int], dry_run: bool) -> dict[str, int]:
    """Gap-fill roll-up: read, created, updated and skipped from its counters."""
    get = lambda *names: sum(summary.get(n, 0) for n in names)
    out = dict(summary)
    out["records_read"] = get("processed_player_seasons")
    out["records_created"] = out["records_updated"] = 0
    if dry_run:
        out["proposed_contracts"] = get("contracts_parsed")
    else:
        out["records_read"] += get("contracts_parsed")
        out["records_created"] = get("contracts_created", "contract_seasons_created")
        out["records_updated"] = get("contracts_matched", "contract_seasons_updated")
    out["records_skipped"] = get(
        "records_skipped", "players_without_nhl_ids", "profiles_failed", "profiles_not_found"
    )
    return out


def run_record(
    spark: SparkSession,
    run_id: int,
    source_id: int,
    job_name: str,
    status: str,
    summary: Mapping[str, object],
    error: str | None = None,
) -> DataFrame:
    """One ``ingestion_runs`` row; a summary without counts falls back to their sum.

    A failed run counts only what its committed summary says; a cancelled or
    running one counts nothing.
    """
    import json

    fallback = ingested_records(summary) if status == "succeeded" else 0
    counted = status in ("succeeded", "failed")
    fields = [("records_read", fallback), ("records_created", 0), ("records_updated", fallback), ("records_skipped", 0)]
    counts = [summary_count(summary, k, d) if counted else 0 for k, d in fields]
    note = None if error is None else error[:4000]
    row = (run_id, source_id, job_name, status, *counts, note, json.dumps(dict(summary), sort_keys=True))
    names = "id bigint, source_id bigint, job_name string, status string, records_read bigint, records_created bigint, records_updated bigint, records_skipped bigint, error_message string, metadata string"
    df = spark.createDataFrame([row], names)
    finished = F.lit(None) if status == "running" else F.current_timestamp()
    return schemas.conform(
        df.withColumn("started_at", F.current_timestamp()).withColumn("finished_at", finished),
        "ingestion_runs",
    )
