"""Versioned season tables and the model store."""

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from rinkline.operators import merge as M
from rinkline.operators import versions as V

SCHEMA = "id long, season int, v string"


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plan(existing, incoming):
    return M.merge_plan(existing, incoming, ["id", "season"], {"v": "new"})


@pytest.fixture
def path(spark, tmp_path):
    rows = [(1, 2001, "a"), (2, 2001, "b"), (3, 2002, "c"), (4, None, "d"), (5, 2003, "e")]
    at = str(tmp_path / "table")
    made = V.create(spark.createDataFrame(rows, SCHEMA), at, "season")
    assert made == (1, {"records_created": 5, "records_updated": 0, "records_kept": 0})
    return at


def test_a_merge_reads_and_writes_only_its_seasons(spark, path):
    incoming = spark.createDataFrame([(2, 2001, "B"), (6, 2004, "f"), (7, None, "g")], SCHEMA)
    seen = []

    def watched(existing, new):
        seen.extend(existing.inputFiles())
        return plan(existing, new)

    before = rows_of(V.manifest(spark, path))
    merged = V.merge(incoming, path, SCHEMA, "season", watched)
    assert merged == (2, {"records_created": 2, "records_updated": 1, "records_kept": 2})
    assert {f.split("_part=")[1].split("/")[0] for f in seen} == {"2001", "__HIVE_DEFAULT_PARTITION__"}
    after = rows_of(V.manifest(spark, path))
    assert {p for p in before if p in after} == {p for p in before if p[0] in ("2002", "2003")}
    assert rows_of(V.read(spark, path, SCHEMA)) == sorted([(1, 2001, "a"), (2, 2001, "B"), (3, 2002, "c"), (4, None, "d"), (5, 2003, "e"), (6, 2004, "f"), (7, None, "g")], key=str)
    assert rows_of(V.read(spark, path, SCHEMA, version=1)) == sorted([(1, 2001, "a"), (2, 2001, "b"), (3, 2002, "c"), (4, None, "d"), (5, 2003, "e")], key=str)


def test_the_same_merge_twice_creates_nothing(spark, path):
    incoming = spark.createDataFrame([(2, 2001, "B"), (9, 2002, "n")], SCHEMA)
    V.merge(incoming, path, SCHEMA, "season", plan)
    once = rows_of(V.read(spark, path, SCHEMA))
    again = V.merge(incoming, path, SCHEMA, "season", plan)
    assert again.counts["records_created"] == 0 and rows_of(V.read(spark, path, SCHEMA)) == once
    assert V.merge(incoming.limit(0), path, SCHEMA, "season", plan).version == again.version


def test_a_failed_write_leaves_the_old_version(spark, path):
    old = V.read(spark, path, SCHEMA)
    broken = lambda e, n: plan(e, n).withColumn("v", F.when(F.col("id") == 2, F.raise_error(F.lit("no"))).otherwise(F.col("v")))
    with pytest.raises(PySparkException):
        V.merge(spark.createDataFrame([(2, 2001, "B")], SCHEMA), path, SCHEMA, "season", broken)
    assert V.newest(spark, path) == 1 and rows_of(old) == rows_of(V.read(spark, path, SCHEMA))


def test_readers_of_the_old_version_and_second_writers(spark, path):
    old = V.read(spark, path, SCHEMA)
    V.merge(spark.createDataFrame([(1, 2001, "z")], SCHEMA), path, SCHEMA, "season", plan)
    assert (1, 2001, "a") in rows_of(old)
    with pytest.raises(V.Conflict):
        V.commit(V.manifest(spark, path, 1), path, 1)
    assert V.vacuum(spark, path) == 1
    assert len(rows_of(V.read(spark, path, SCHEMA))) == 5 and V.newest(spark, path) == 2


def test_counts_are_those_of_the_plan(spark, path):
    """What is observed while writing equals an aggregate over the plan, also where tasks are many."""
    incoming = spark.range(0, 5000, numPartitions=40).select("id", (F.col("id") % 7 + 2000).cast("int").alias("season"), F.lit("x").alias("v"))
    want = M.merge_counts(plan(V.read(spark, path, SCHEMA, incoming.select("season")), incoming)).first().asDict()
    assert V.merge(incoming, path, SCHEMA, "season", plan).counts == want
