"""Structured Streaming jobs: scoring, drift and monitor-text intake.

Each batch is written under its own ``batch_id`` folder in overwrite mode, so a
batch that is run again after a failure replaces its own output.
"""

from __future__ import annotations

import logging
from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wattline.functions.coerce import to_time
from wattline.operators.drift import drift_report
from wattline.sources.records import empty_requests, request_rows
from wattline.sources.sinks import log_rows, write_log
from wattline.sources.smi_text import label_samples, malformed_lines, parse_lines

log = logging.getLogger(__name__)

REQUEST_KEY = "request_key"
Scorer = Callable[[DataFrame], DataFrame]


def _start(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, once: bool) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each)
    return (writer.trigger(availableNow=True) if once else writer).start()


def score_stream(
    requests: DataFrame,
    scorer: Scorer,
    inputs: Sequence[str],
    order: Sequence[str],
    out_path: str,
    log_path: str,
    checkpoint: str,
    model_name: str,
    model_version: str,
    once: bool = False,
    reject_path: str | None = None,
) -> StreamingQuery:
    """Score a stream of JSON requests (column ``value``) and log the predictions.

    ``scorer`` adds ``prediction`` to rows that carry the record fields. ``row_index`` is
    the record's position in its request, and columns of the stream other than ``value``
    are written with it. ``request_key`` names the request: the stream's own column of that
    name, else the SHA-256 of its text, which a client can work out; requests of one text
    have one answer. A batch is scored once. Requests without a record go, with their key, to
    ``reject_path`` (by default ``out_path`` with ``-rejects``). The log never blocks
    scoring: when it fails the batch still counts as done.
    """
    rejects = (reject_path or f"{out_path.rstrip('/')}-rejects").rstrip("/")

    def each(batch: DataFrame, batch_id: int) -> None:
        own = [c for c in batch.columns if c != "value" and c not in order]
        own = [*own, *([REQUEST_KEY] if REQUEST_KEY not in own else [])]
        keyed = batch if REQUEST_KEY in batch.columns else batch.withColumn(REQUEST_KEY, F.sha2("value", 256))
        answered = [*own, *order, "row_index", "predicted_power_watts"]
        logged = [*answered, *[c for c in inputs if c not in answered]]
        scored = scorer(request_rows(keyed)).withColumn("predicted_power_watts", F.col("prediction")).select(*logged)
        # Answers and log come from one scoring of the batch: the log is made of the stored answers. Only
        # inputs that those lack are held beside them, without the text of the request.
        apart = len(logged) > len(answered)
        if apart:
            scored.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            answers, place = scored.select(*answered), f"{out_path.rstrip('/')}/batch_id={batch_id}"
            # keys are hex digits: zstd stores them in half the room that snappy takes
            answers.write.mode("overwrite").option("compression", "zstd").parquet(place)
            empty_requests(keyed).write.mode("overwrite").parquet(f"{rejects}/batch_id={batch_id}")
            try:
                rows = scored if apart else batch.sparkSession.read.schema(answers.schema).parquet(place)
                entries = log_rows(rows, inputs, model_name, model_version, prediction="predicted_power_watts")
                write_log(entries, f"{log_path.rstrip('/')}/batch_id={batch_id}", "overwrite")
            except Exception:  # noqa: BLE001 - logging must not stop scoring
                log.exception("prediction log failed for batch %s", batch_id)
        finally:
            if apart:
                scored.unpersist()

    return _start(requests, each, checkpoint, once)


def drift_stream(
    records: DataFrame, profile: DataFrame, out_path: str, checkpoint: str, once: bool = False, **limits: float | DataFrame
) -> StreamingQuery:
    """Write one drift report per arriving batch; an empty batch gives none.

    The profile is collected once, before the stream starts; ``limits`` go to the report.
    """
    profile = profile.sparkSession.createDataFrame(profile.collect(), profile.schema)  # one row per feature

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        report = drift_report(profile, batch, **limits)
        report.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")

    return _start(records, each, checkpoint, once)


def intake_stream(
    spark: SparkSession,
    in_path: str,
    out_path: str,
    checkpoint: str,
    session: str,
    workload: str = "local_nvidia_smi_trace",
    once: bool = False,
    reject_path: str | None = None,
) -> StreamingQuery:
    """Turn arriving monitor-text files into labelled telemetry rows with zone-less times.

    ``read_telemetry(spark, "local_nvidia_smi", out_path)`` reads them back. Lines that
    are not samples go to ``reject_path`` (by default ``out_path`` with ``-rejects``).
    """
    rejects = (reject_path or f"{out_path.rstrip('/')}-rejects").rstrip("/")

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = label_samples(parse_lines(batch, strict=False), session, workload)
        rows = rows.withColumn("timestamp", to_time(F.col("timestamp")))
        rows.write.mode("overwrite").parquet(f"{out_path.rstrip('/')}/batch_id={batch_id}")
        malformed_lines(batch).write.mode("overwrite").parquet(f"{rejects}/batch_id={batch_id}")

    return _start(spark.readStream.text(in_path), each, checkpoint, once)
