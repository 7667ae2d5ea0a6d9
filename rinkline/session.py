"""Session settings and the shared staging folder."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

_named: dict[str, str] = {}
_written: dict[str, list[str]] = {}
_tables: dict[str, list[str]] = {}

#: Spark's own setting for removing an execution's shuffle files at its end.
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build(app: str = "rinkline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings above; cluster sizing stays with the caller."""
    builder = SparkSession.builder.appName(app)
    if master is not None:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Raises when none is named: a folder of one machine would lose the files
    that other executors write.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or _named.get(spark.sparkContext.applicationId)
    if not named:
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return named.rstrip("/")


def on_one_machine(spark: SparkSession) -> SparkSession:
    """Name a temporary folder for a session that runs in one process and names none.

    Driver and executors are the same process there, so the folder is shared.
    A cluster session is left as it is and must name its own folder.
    """
    sc = spark.sparkContext
    single = sc.master == "local" or sc.master.startswith("local[")
    if single and not spark.conf.get("spark.checkpoint.dir", None) and sc.applicationId not in _named:
        _named[sc.applicationId] = tempfile.mkdtemp(prefix="rinkline-")
    return spark


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, remembered for ``clear_staged``."""
    path = f"{shared_folder(spark)}/staged/{name}-{uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written within go when it is done, not when the driver next collects garbage."""
    before = spark.conf.get(_CLEAN_UP)
    spark.conf.set(_CLEAN_UP, True)
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_UP, before)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a frame is read by several passes that must see the same
    values: the written table survives executor loss, is columnar (later
    passes prune columns) and has a size the planner knows exactly.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, key: str, name: str) -> DataFrame:
    """``staged`` in buckets of ``key``: later joins and aggregates by it (and more) don't shuffle these rows again.

    ``df`` should be dealt by ``key`` to ``parts`` partitions already, so that a task writes one file.
    """
    spark = df.sparkSession
    path, table = new_path(spark, name), f"rinkline_{name}_{uuid4().hex}"
    _tables.setdefault(spark.sparkContext.applicationId, []).append(table)
    with shuffles_removed(spark):
        df.write.option("compression", "zstd").option("path", path).bucketBy(parts(spark), key).format("parquet").saveAsTable(table)
    return spark.table(table)


def parts(spark: SparkSession) -> int:
    """Partitions of a shuffle, and buckets of ``staged_by``."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def clear_staged(spark: SparkSession) -> None:
    """Remove what this application staged; call it when no staged frame is needed any more."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for table in _tables.pop(spark.sparkContext.applicationId, []):
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    for path in _written.pop(spark.sparkContext.applicationId, []):
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(conf).delete(target, True)
