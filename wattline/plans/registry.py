"""Versioned model bundles: pipeline, metadata and reference profile.

Layout: ``<registry>/<model>/<version>/{pipeline, metadata, reference_profile}``
and an append-only index table ``<registry>/_index``.
"""

from __future__ import annotations

import logging
import platform
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timezone

import pyspark
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from wattline.contract import TARGET
from wattline.plans.scoring import PREDICTION, align, prediction_rows, require_rows
from wattline.sources.files import exists, names_in
from wattline.sources.sinks import load_profile, save_profile

log = logging.getLogger(__name__)

INDEX = "_index"
CATEGORIES = "reference_categories"
INDEX_SCHEMA = "model string, version string, created_utc string"


METADATA_SCHEMA = (
    "model_name string, numeric_features array<string>, categorical_features array<string>, metrics map<string,double>, "
    "split_strategy string, source string, version string, target string, feature_order array<string>, created_utc string, "
    "python_version string, spark_version string, code_version string"
)


def model_metadata(
    spark: SparkSession,
    model_name: str,
    numeric_features: Sequence[str],
    categorical_features: Sequence[str],
    metrics: Mapping[str, float],
    split_strategy: str,
    source: str,
    version: str,
    code_version: str | None = None,
) -> DataFrame:
    """What a bundle says about its model, as one row of METADATA_SCHEMA."""
    row = (
        model_name, list(numeric_features), list(categorical_features), {k: float(v) for k, v in metrics.items()}, split_strategy, source,
        version, TARGET, [*numeric_features, *categorical_features], None, platform.python_version(), pyspark.__version__, code_version,
    )
    stamp = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return spark.createDataFrame([row], METADATA_SCHEMA).withColumn("created_utc", stamp)


def new_version() -> str:
    """UTC version id, sortable as text."""
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")


def version_index(entries: DataFrame) -> DataFrame:
    """(model, version, is_latest) from index entries, duplicates removed."""
    versions = entries.select("model", "version").distinct()
    latest = versions.groupBy("model").agg(F.max("version").alias("latest"))
    return versions.join(latest, "model").select(
        "model", "version", (F.col("version") == F.col("latest")).alias("is_latest")
    )


def save_bundle(
    spark: SparkSession, pipeline: PipelineModel, metadata: DataFrame, registry: str, profile: DataFrame | None = None,
    categories: DataFrame | None = None,
) -> str:
    """Store a fitted pipeline with its one-row metadata and list it in the index.

    ``categories`` is the training table's ``value_counts``, for drift checks of wide features.
    """
    about = metadata.first()
    folder = f"{registry.rstrip('/')}/{about['model_name']}/{about['version']}"
    pipeline.write().overwrite().save(f"{folder}/pipeline")
    stored = spark.createDataFrame([about], METADATA_SCHEMA)
    stored.coalesce(1).write.mode("overwrite").json(f"{folder}/metadata")
    if profile is not None:
        save_profile(profile, folder)
    if categories is not None:
        categories.write.mode("overwrite").parquet(f"{folder}/{CATEGORIES}")
    entry = stored.select(F.col("model_name").alias("model"), "version", "created_utc")
    entry.coalesce(1).write.mode("append").parquet(f"{registry.rstrip('/')}/{INDEX}")
    return folder


def list_versions(spark: SparkSession, registry: str) -> DataFrame:
    """The versions in the index and in the folders; a missing or unreadable index costs nothing."""
    base = registry.rstrip("/")
    found = [(m, v, None) for m in names_in(spark, base) if not m.startswith("_") for v in names_in(spark, f"{base}/{m}")]
    entries = spark.createDataFrame(found, INDEX_SCHEMA)
    if exists(spark, f"{base}/{INDEX}"):
        try:
            listed = spark.read.schema(INDEX_SCHEMA).parquet(f"{base}/{INDEX}").collect()  # one row per stored version
            entries = entries.unionByName(spark.createDataFrame(listed, INDEX_SCHEMA))
        except Exception:  # noqa: BLE001 - whatever is wrong with it, the folders tell the same
            log.warning("the index of %s cannot be read; its folders are listed instead", base)
    return version_index(entries)


def resolve_bundle(spark: SparkSession, registry: str, model: str, version: str = "latest") -> str:
    """Folder of a version of a model, by default of its newest."""
    wanted = F.col("is_latest") if version == "latest" else F.lit(True)
    row = list_versions(spark, registry).where((F.col("model") == model) & wanted).first()
    if version == "latest" and row is None:
        raise FileNotFoundError(f"The registry at {registry} holds no version of '{model}'.")
    return f"{registry.rstrip('/')}/{model}/{row['version'] if version == 'latest' else version}"


@dataclass
class PowerModel:
    """A loaded bundle, ready to score DataFrames."""

    pipeline: PipelineModel
    metadata: Row
    folder: str

    @classmethod
    def from_dir(cls, spark: SparkSession, folder: str) -> PowerModel:
        for part in ("pipeline", "metadata"):
            if not exists(spark, f"{folder}/{part}"):
                raise FileNotFoundError(f"No {part} under {folder}")
        about = spark.read.schema(METADATA_SCHEMA).json(f"{folder}/metadata").first()  # keys it doesn't know are left out
        return cls(PipelineModel.load(f"{folder}/pipeline"), about, folder)

    @classmethod
    def from_registry(cls, spark: SparkSession, registry: str, model: str, version: str = "latest") -> PowerModel:
        return cls.from_dir(spark, resolve_bundle(spark, registry, model, version))

    def align(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return align(df, self.metadata.numeric_features, self.metadata.categorical_features, keep)

    def predict(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Aligned features, the kept columns and ``prediction``."""
        keep = [k for k in keep if k not in self.metadata.feature_order]
        aligned = self.align(df, keep)
        return self.pipeline.transform(aligned).select(*aligned.columns, PREDICTION)

    def predict_rows(self, df: DataFrame, order: Sequence[str] = ()) -> DataFrame:
        """(index, predicted_power_watts): a request's own positions, else those in ``order``; no input is an error."""
        keep = [*order, *[c for c in ("row_index",) if c in df.columns and c not in order]]
        return prediction_rows(self.predict(require_rows(df), keep), order)

    def predict_one(self, spark: SparkSession, record: dict) -> float:
        """Prediction for a single record; only the model's own features are looked at."""
        known = {k: None if record.get(k) is None else str(record[k]) for k in self.metadata.feature_order}
        df = spark.createDataFrame([tuple(known.values())], ", ".join(f"`{k}` string" for k in known))
        return float(self.predict(df).first()[PREDICTION])

    def profile(self, spark: SparkSession) -> DataFrame:
        return load_profile(spark, self.folder)

    def categories(self, spark: SparkSession) -> DataFrame | None:
        """(feature, value, n) of the training table, when it was stored."""
        path = f"{self.folder}/{CATEGORIES}"
        return spark.read.parquet(path) if exists(spark, path) else None
