"""Table, CSV, prediction and model files."""

from __future__ import annotations

import csv
import io
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from rinkline import schemas
from rinkline.operators.quality import QualityError, assert_none

# tables large enough to be laid out by season, so that a season filter prunes
# files and a merge rewrites only the seasons it touches
SEASON_TABLES = [
    "player_team_stints",
    "contract_seasons",
    "games",
    "skater_season_stats",
    "goalie_season_stats",
    "skater_advanced_season_stats",
    "goalie_advanced_season_stats",
]


def read_table(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """A stored table with its declared schema and column order."""
    columns = schemas.struct(table)
    return spark.read.schema(columns).parquet(f"{folder}/{table}").select(*columns.names)


def read_tables(spark: SparkSession, folder: str, *tables: str) -> dict[str, DataFrame]:
    return {t: read_table(spark, folder, t) for t in tables or schemas.TABLES}


def write_table(df: DataFrame, folder: str, table: str) -> None:
    out = schemas.conform(df, table).write.mode("overwrite")
    if table in SEASON_TABLES:
        out = out.partitionBy("season_start_year")
    out.parquet(f"{folder}/{table}")


def read_one(df: DataFrame) -> DataFrame:
    return df.limit(1)


def read_database(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    lower: int,
    upper: int,
    partitions: int,
    **options: str,
) -> DataFrame:
    """A database table read in parallel ranges of ``column``."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    bounds = {
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
        "customSchema": schemas.TABLES[table],
    }
    return reader.options(**bounds, **options).load()


def csv_header(spark: SparkSession, path: str) -> list[str]:
    """Header names of a CSV file (byte-order mark dropped); repeated names are refused."""
    line = spark.read.text(path).first()
    names = next(csv.reader(io.StringIO(line[0].lstrip("﻿"))), []) if line else []
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise QualityError(f"duplicate CSV columns: {', '.join(repeated)}")
    return names


def assert_one_header(spark: SparkSession, path: str) -> None:
    """All files of a path must have the same header line: one schema is read from all of them."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")
    )
    first = lines.filter("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("header"))
    header = F.regexp_replace("header", "^\ufeff|\r$", "")
    if len(first.select(header.alias("header")).distinct().limit(2).collect()) > 1:
        raise QualityError("CSV files differ in their columns")


def read_csv(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """A CSV snapshot as text columns plus ``_ord``, its row order in the file.

    Every value stays text (an empty cell is null), short rows are padded
    with nulls and rows with too many values are refused, as are files whose
    headers differ. A cell can't hold a line break, so large files can be split.
    """
    names = csv_header(spark, path)
    if check:
        assert_one_header(spark, path)
    columns = StructType([StructField(n, StringType()) for n in [*names, "_uneven"]])
    rows = (
        spark.read.schema(columns)
        .option("header", True)
        .option("escape", '"')
        .option("columnNameOfCorruptRecord", "_uneven")  # rows with another number of values
        .csv(path)
    )
    order = F.struct(
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    ordered = rows.select("*", order.alias("_ord"))
    if check:
        cells = F.split(F.regexp_replace("_uneven", '"([^"]|"")*"', "q"), ",")
        surplus = rows.filter(F.size(cells) > len(names)).select("_uneven", *names)
        assert_none(surplus, "malformed CSV row has too many values")
    return ordered.drop("_uneven")


def stack_feeds(*feeds: DataFrame) -> DataFrame:
    """Feeds one after another; ``_ord`` makes "the last row wins" well defined.

    Feeds without an order column of their own are ordered by place only.
    """
    stacked = None
    for place, feed in enumerate(feeds):
        inner = F.col("_ord") if "_ord" in feed.columns else F.lit(0)
        ordered = feed.withColumn("_ord", F.struct(F.lit(place).alias("feed"), inner.alias("at")))
        stacked = ordered if stacked is None else stacked.unionByName(ordered, allowMissingColumns=True)
    return stacked


def write_predictions(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Evaluated predictions, in as many files as the frame has partitions."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
