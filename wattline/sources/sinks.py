"""Report tables, reference profiles and the prediction log."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.operators.drift import PROFILE_SCHEMA
from wattline.sources.files import exists

PROFILE_FILE = "reference_profile"
METADATA_FILE = "metadata"


def write_table(df: DataFrame, out_dir: str, name: str, form: str = "parquet") -> str:
    """Write one result table under ``<out_dir>/<name>``, replacing an older one."""
    path = f"{out_dir.rstrip('/')}/{name}"
    writer = df.write.mode("overwrite")
    if form == "csv":
        flat = df.select(*[F.to_json(c).alias(c) if t.startswith(("array", "map", "struct")) else F.col(c) for c, t in df.dtypes])
        flat.write.mode("overwrite").option("header", True).csv(path)
    else:
        writer.format(form).save(path)
    return path


def write_tables(tables: Mapping[str, DataFrame], out_dir: str, form: str = "parquet") -> dict[str, str]:
    return {name: write_table(df, out_dir, name, form) for name, df in tables.items()}


def save_profile(profile: DataFrame, out_dir: str, form: str = "parquet") -> str:
    """Store a reference profile; it has one row per feature."""
    return write_table(profile.coalesce(1), out_dir, PROFILE_FILE, form)


def load_profile(spark: SparkSession, reference: str) -> DataFrame:
    """Profile stored at a path, in a run folder, in its ``monitoring`` folder or in a model bundle."""
    base = reference.rstrip("/")
    places = [base] if base.endswith(PROFILE_FILE) else []
    places += [f"{base}/{PROFILE_FILE}", f"{base}/monitoring/{PROFILE_FILE}"]
    for place in places:
        if exists(spark, place):
            return spark.read.schema(PROFILE_SCHEMA).parquet(place)
    raise FileNotFoundError(f"No reference profile found under {reference}.")


def log_rows(
    scored: DataFrame, inputs: Sequence[str], model_name: str, model_version: str,
    row_index: Column | str = "row_index", prediction: str = "prediction",
) -> DataFrame:
    """Prediction-log rows: one time stamp per call, inputs as a struct with nulls for gaps."""
    index = F.col(row_index) if isinstance(row_index, str) else row_index
    return scored.select(
        F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("logged_at_utc"),
        F.lit(model_name).alias("model_name"),
        F.lit(model_version).alias("model_version"),
        index.cast("bigint").alias("row_index"),
        F.col(prediction).alias("predicted_power_watts"),
        F.struct(*[F.col(c) for c in inputs]).alias("inputs"),
    )


def write_log(rows: DataFrame, path: str, mode: str = "append") -> None:
    """Write gzipped JSON lines: every line repeats all names, and every JSON reader of Spark unpacks them."""
    rows.write.mode(mode).option("ignoreNullFields", False).option("compression", "gzip").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Append to the JSON-lines log. Prediction and inputs sit on the same row, so their counts agree."""
    write_log(rows, path)
