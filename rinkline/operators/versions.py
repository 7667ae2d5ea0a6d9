"""Versioned season tables: a version is a manifest of season folders, and a merge switches to a new one in one step.

A table's folder holds

- ``data/<write>/_part=<season>/``  Parquet files, never changed once written;
- ``manifests/v<number>/``          one row per season: its folder (Parquet).

Readers take the newest manifest and open only the folders they need. A writer
puts new folders beside the old ones and renames its manifest into place, which
fails if another writer was first. Until then everybody sees the old version, so
a failed or killed write leaves the table as it was, and a reader that has begun
keeps its files. ``vacuum`` removes what only old versions name.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rinkline.operators.merge import CREATED, KEPT, UPDATED
from rinkline.session import shuffles_removed

PARTS = "part string, folder string"
ACTIONS = {"records_created": CREATED, "records_updated": UPDATED, "records_kept": KEPT}


class Conflict(RuntimeError):
    """Another writer has made the version that this one was about to make."""


class Merged(NamedTuple):
    version: int
    counts: dict[str, int]


def _hadoop(spark: SparkSession):
    return spark.sparkContext._jvm.org.apache.hadoop.fs, spark.sparkContext._jsc.hadoopConfiguration()


def _names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if it isn't there."""
    fs, conf = _hadoop(spark)
    at = fs.Path(path)
    store = at.getFileSystem(conf)
    return [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []


def newest(spark: SparkSession, path: str) -> int:
    """Number of the newest version, 0 if there is none."""
    return max((int(n[1:]) for n in _names(spark, f"{path}/manifests") if n.startswith("v")), default=0)


def manifest(spark: SparkSession, path: str, version: int | None = None, schema: str = PARTS) -> DataFrame:
    """The rows of a version's manifest (of the newest one by default)."""
    version = newest(spark, path) if version is None else version
    if not version:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/manifests/v{version:012d}")


def commit(rows: DataFrame, path: str, after: int) -> int:
    """Make ``rows`` the manifest of the version after ``after``; raises ``Conflict`` if that one exists."""
    spark = rows.sparkSession
    fs, conf = _hadoop(spark)
    made = f"{path}/pending-{uuid4().hex}"
    rows.coalesce(1).write.parquet(made)
    target = fs.Path(f"{path}/manifests/v{after + 1:012d}")
    target.getFileSystem(conf).mkdirs(target.getParent())
    whole = target.getFileSystem(conf).makeQualified(target)
    none = spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0)
    try:
        fs.FileContext.getFileContext(whole.toUri(), conf).rename(fs.Path(made), whole, none)
    except Exception as e:
        fs.Path(made).getFileSystem(conf).delete(fs.Path(made), True)
        if newest(spark, path) > after:
            raise Conflict(f"version {after + 1} of {path} exists already") from e
        raise
    return after + 1


def read(spark: SparkSession, path: str, schema, among: DataFrame | None = None, version: int | None = None) -> DataFrame:
    """Rows of a version; with ``among`` (a column of parts) only the folders of those parts are opened.

    The manifest, one row per season, is what the driver reads to plan the scan.
    """
    parts = manifest(spark, path, version)
    if among is not None:
        wanted = among.select(F.col(among.columns[0]).cast("string").alias("wanted")).distinct()
        parts = parts.join(wanted, F.col("part").eqNullSafe(F.col("wanted")), "left_semi")
    folders = [f"{path}/{r[0]}" for r in parts.select("folder").orderBy("folder").collect()]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _write(rows: DataFrame, path: str, partition: str) -> tuple[DataFrame, dict[str, int]]:
    """Write planned rows into a folder of their own: its manifest rows, and the counts that were observed while writing.

    A hot season is written by several tasks (rebalancing splits it).
    """
    spark = rows.sparkSession
    name = f"data/{uuid4().hex}"
    seen = Observation()
    counted = [F.count_if(F.col("_action") == a).alias(n) for n, a in ACTIONS.items()]
    dealt = rows.withColumn("_part", F.col(partition)).hint("rebalance", "_part").observe(seen, *counted)
    with shuffles_removed(spark):
        dealt.drop("_action").write.partitionBy("_part").parquet(f"{path}/{name}")
    made = []
    for folder in _names(spark, f"{path}/{name}"):
        if folder.startswith("_part="):
            value = folder.removeprefix("_part=")
            made.append((None if value == "__HIVE_DEFAULT_PARTITION__" else value, f"{name}/{folder}"))
    return spark.createDataFrame(made, PARTS), seen.get


def create(rows: DataFrame, path: str, partition: str) -> Merged:
    """The first version of a table; every row counts as created. The partition column holds whole numbers or nulls."""
    parts, counts = _write(rows.withColumn("_action", F.lit(CREATED)), path, partition)
    return Merged(commit(parts, path, 0), counts)


def merge(incoming: DataFrame, path: str, schema, partition: str, plan: Callable[[DataFrame, DataFrame], DataFrame]) -> Merged:
    """Merge rows into the newest version: only the seasons that they fall in are read and written anew.

    ``plan(existing, incoming)`` gives the new rows of those seasons with their
    ``_action`` (see ``merge_plan``); a key must not move from one season to
    another. Rows without a season are a part of their own. Without incoming rows
    no version is made.
    """
    spark = incoming.sparkSession
    before = newest(spark, path)
    existing = read(spark, path, schema, incoming.select(partition), before)
    parts, counts = _write(plan(existing, incoming), path, partition)
    if parts.isEmpty():
        return Merged(before, counts)
    untouched = manifest(spark, path, before).join(parts.select(F.col("part").alias("new")), F.col("part").eqNullSafe(F.col("new")), "left_anti")
    return Merged(commit(untouched.unionByName(parts), path, before), counts)


def vacuum(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Remove manifests but the ``keep`` newest and the data folders that none of those names; returns how many folders went."""
    fs, conf = _hadoop(spark)
    versions = sorted(n for n in _names(spark, f"{path}/manifests") if n.startswith("v"))
    gone = versions[:-keep] if keep else []
    named = {f for v in versions[len(gone) :] for f in (r[0] for r in manifest(spark, path, int(v[1:])).select("folder").collect())}
    stale = [f"data/{w}/{p}" for w in _names(spark, f"{path}/data") for p in _names(spark, f"{path}/data/{w}") if p.startswith("_part=") and f"data/{w}/{p}" not in named]
    for folder in [f"manifests/{v}" for v in gone] + stale:
        at = fs.Path(f"{path}/{folder}")
        at.getFileSystem(conf).delete(at, True)
    return len(stale)
