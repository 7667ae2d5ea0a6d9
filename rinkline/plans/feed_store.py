"""Snapshots of feeds behind checks: a refused snapshot leaves the last good one in place.

A store has a folder per accepted snapshot and a versioned manifest with one row
per feed: the state of its last offer, and the folder and date of its last good
snapshot (see ``operators.versions``).
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from typing import NamedTuple
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkline.operators import versions as V
from rinkline.operators.quality import QualityError
from rinkline.plans import roster as R

STATES = "feed string, state string, reason string, offered date, good date, folder string, records long"
ACCEPTED, REFUSED = "accepted", "refused"


class Offer(NamedTuple):
    state: str
    reason: str | None
    records: int


def states(spark: SparkSession, path: str) -> DataFrame:
    """One row per feed that was ever offered."""
    return V.manifest(spark, path, schema=STATES)


def offer(rows: DataFrame, violations: DataFrame, path: str, feed: str, day: date, at_least: int = 0) -> Offer:
    """Store a snapshot if it has no violations and rows enough, else note why not.

    ``records`` are those of the snapshot that is the good one afterwards (0 if
    there is none yet).
    """
    spark = rows.sparkSession
    version = V.newest(spark, path)
    known = V.manifest(spark, path, version, STATES)
    before = known.where(F.col("feed") == feed).first()
    folder, records, reason = f"snapshots/{uuid4().hex}", 0, None
    if not violations.isEmpty():
        reason = "violations"
    else:
        rows.write.parquet(f"{path}/{folder}")
        records = spark.read.schema(rows.schema).parquet(f"{path}/{folder}").count()
        if records < at_least:
            reason = f"{records} of at least {at_least} rows"
    if reason is None:
        row = (feed, ACCEPTED, None, day, day, folder, records)
    else:
        good = (before["good"], before["folder"], before["records"]) if before else (None, None, 0)
        row = (feed, REFUSED, reason, day, *good)
    others = known.where(F.col("feed") != feed)
    V.commit(others.unionByName(spark.createDataFrame([row], STATES)), path, version)
    return Offer(row[1], reason, row[6])


def last_good(spark: SparkSession, path: str, feed: str, schema) -> DataFrame:
    """Rows of a feed's last good snapshot; an error without one."""
    row = states(spark, path).where(F.col("feed") == feed).first()
    if row is None or row["folder"] is None:
        raise QualityError(f"there is no good snapshot of {feed}")
    return spark.read.schema(schema).parquet(f"{path}/{row['folder']}")


def feed_errors(spark: SparkSession, path: str, feeds: list[str], day: date) -> DataFrame:
    """(feed, problem) for each of the feeds whose good snapshot isn't of the day; no rows if all are of one version."""
    wanted = spark.createDataFrame([(f,) for f in feeds], "feed string")
    known = wanted.join(states(spark, path), "feed", "left")
    problem = F.when(F.col("state").isNull(), "never offered").when(F.col("state") == REFUSED, F.col("reason")).when(~F.col("good").eqNullSafe(F.lit(day)), "another day's")
    return known.select("feed", problem.alias("problem")).where("problem is not null")


def sync_statuses(
    tables: Mapping[str, DataFrame], path: str, day: date, major: str = "major", minor: str = "minor", schemas: tuple[str, str] = ("external_id string", "external_id string, full_name string, birth_date date, _ord int")
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Statuses from the stored rosters (see ``roster.sync_statuses``); refused unless both are good and of the day."""
    spark = tables["players"].sparkSession
    errors = feed_errors(spark, path, [major, minor], day)
    if not errors.isEmpty():
        raise QualityError("roster feeds aren't complete: " + ", ".join(f"{r.feed} ({r.problem})" for r in errors.orderBy("feed").collect()))
    return R.sync_statuses(tables, last_good(spark, path, major, schemas[0]), last_good(spark, path, minor, schemas[1]), day, errors)
