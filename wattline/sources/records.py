"""Scoring inputs: JSON documents, JSON lines and CSV files of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.sources.files import read_text_csv

# Typed fields of a scoring record.
RECORD_FIELDS = (
    ("gpu_utilization_pct", "double"),
    ("memory_utilization_pct", "double"),
    ("graphics_clock_mhz", "double"),
    ("memory_clock_mhz", "double"),
    ("temperature_c", "double"),
    ("ambient_c", "double"),
    ("workload_type", "string"),
)
_TYPES = {"double": T.DoubleType(), "string": T.StringType()}
RECORD_SCHEMA = T.StructType([T.StructField(n, _TYPES[t]) for n, t in RECORD_FIELDS])
REQUEST_SCHEMA = T.StructType([T.StructField("records", T.ArrayType(RECORD_SCHEMA))])


def read_records(spark: SparkSession, path: str, json_lines: bool = False, schema: T.StructType | None = None) -> DataFrame:
    """Records of a file: ``{"records": [...]}``, one object or a list in JSON, else CSV.

    A JSON document is one unit for Spark; ``json_lines`` reads one document per
    line, which is the form to use for large inputs.
    """
    name = path.rstrip("/").lower()
    if not name.endswith((".json", ".jsonl")):
        return read_text_csv(spark, path)
    reader = spark.read.option("multiLine", not (json_lines or name.endswith(".jsonl")))
    df = (reader.schema(schema) if schema is not None else reader).json(path)
    return unwrap(df)


def unwrap(df: DataFrame) -> DataFrame:
    """One row per entry of ``records``; rows without that list stand for themselves."""
    if "records" not in df.columns:
        return df
    inner = [f.name for f in df.schema["records"].dataType.elementType.fields]
    own = [c for c in df.columns if c != "records"]
    listed = df.where("records is not null").select(F.explode("records").alias("r")).select("r.*")
    single = df.where("records is null").drop("records")
    if not own:
        return listed.select(*inner)
    return listed.unionByName(single, allowMissingColumns=True)


def parse_requests(payload: Column) -> Column:
    """Typed records of a JSON request text."""
    return F.from_json(payload, REQUEST_SCHEMA)["records"]


def request_rows(df: DataFrame, payload: str = "value") -> DataFrame:
    """One row per record of each request, with its position and unknown keys in ``extras``.

    ``row_index`` counts from 0 in the request, so answers can be matched to records.
    A request without a record is an error of that request and gives no row; see
    :func:`empty_requests`.
    """
    raw = F.from_json(F.col(payload), "records array<map<string,string>>")["records"]
    pairs = F.arrays_zip(parse_requests(F.col(payload)).alias("typed"), raw.alias("raw"))
    known = [n for n, _ in RECORD_FIELDS]
    out = df.select("*", F.posexplode(pairs).alias("row_index", "r"))
    extras = F.map_filter(F.col("r.raw"), lambda k, v: ~k.isin(known))
    return out.select(*df.columns, "row_index", *[F.col(f"r.typed.{n}").alias(n) for n in known], extras.alias("extras"))


def empty_requests(df: DataFrame, payload: str = "value") -> DataFrame:
    """Requests that are not valid: no ``records`` list or an empty one."""
    records = parse_requests(F.col(payload))
    return df.where(records.isNull() | (F.size(records) < 1))
