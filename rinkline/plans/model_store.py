"""Fitted models and their predictions as a store of versions, one of which is active.

``publish`` writes a version's files; the table of versions is a manifest (see
``operators.versions``) that is replaced in one step, so a version is listed only
when its files are complete and there is never more than one active version.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rinkline.operators.quality import QualityError
from rinkline.operators.versions import commit, manifest, newest
from rinkline.session import shuffles_removed
from rinkline.plans.model import MODEL_TYPE, Fitted, Trained, assert_metadata, metadata_json, score

VERSIONS = "id long, model_type string, version string, folder string, sha256 string, active boolean, metadata string"


def versions(spark: SparkSession, path: str) -> DataFrame:
    """All published versions, in the order of their ids."""
    return manifest(spark, path, schema=VERSIONS)


def publish(trained: Trained, path: str, version: str, spark: SparkSession) -> int:
    """Store a trained model under a new version name and return its id; its metadata is validated before anything is written."""
    text = metadata_json(trained.metadata)
    at = newest(spark, path)
    known = manifest(spark, path, at, VERSIONS)
    if not known.where(F.col("version") == version).isEmpty():
        raise QualityError(f"model version {version!r} exists already")
    folder, model = f"models/{uuid4().hex}", trained.final.to_json()
    spark.createDataFrame([(model,)], "model string").coalesce(1).write.parquet(f"{path}/{folder}")
    number = (known.agg(F.max("id")).first()[0] or 0) + 1
    row = (number, MODEL_TYPE, version, folder, hashlib.sha256(model.encode()).hexdigest(), False, text)
    commit(known.unionByName(spark.createDataFrame([row], VERSIONS)), path, at)
    return number


def activate(spark: SparkSession, path: str, version: str) -> None:
    """Make one version the active one of its type, in one step."""
    at = newest(spark, path)
    known = manifest(spark, path, at, VERSIONS)
    kind = known.where(F.col("version") == version).select("model_type").first()
    if kind is None:
        raise QualityError(f"there is no model version {version!r}")
    same = F.col("model_type") == kind[0]
    commit(known.withColumn("active", F.when(same, F.col("version") == version).otherwise(F.col("active"))), path, at)


def load(spark: SparkSession, path: str, version: str | None = None) -> tuple[int, Fitted, Mapping]:
    """Id, model and metadata of a version (the active one by default); refuses bytes that aren't those that were published."""
    wanted = F.col("active") if version is None else F.col("version") == version
    row = versions(spark, path).where(wanted).first()
    if row is None:
        raise QualityError("there is no active model version" if version is None else f"there is no model version {version!r}")
    metadata = json.loads(row["metadata"])
    assert_metadata(metadata)
    model = spark.read.schema("model string").parquet(f"{path}/{row['folder']}").first()[0]
    if hashlib.sha256(model.encode()).hexdigest() != row["sha256"]:
        raise QualityError(f"model version {row['version']!r} isn't what was published")
    return row["id"], Fitted.from_json(model), metadata


def predict(features: DataFrame, path: str, version: str | None = None) -> DataFrame:
    """Rows for the ``predictions`` table by a stored version (the active one by default)."""
    number, fitted, _ = load(features.sparkSession, path, version)
    return score(fitted, features, number)


def store_predictions(rows: DataFrame, path: str, version_id: int) -> DataFrame:
    """Write a version's evaluated or scored rows once and read them back; a second write for the version is refused."""
    at = f"{path}/predictions/version={version_id}"
    with shuffles_removed(rows.sparkSession):
        rows.write.mode("errorifexists").parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)
