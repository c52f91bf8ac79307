"""What the scoring stream stores: packed requests and answers, and no second copy of the batch."""

import json
from pathlib import Path

from suite import streams
from suite.streams import _finish
from wattline.streaming import jobs


def _run(spark, tmp_path, inputs, order, monkeypatch):
    (tmp_path / "in").mkdir()
    records = [{"gpu_utilization_pct": float(i), "memory_utilization_pct": i / 7, "workload_type": "a"} for i in range(30)]
    (tmp_path / "in" / "r.txt").write_text("\n".join(json.dumps({"records": records[i : i + 2]}) for i in range(0, 30, 2)))
    held, plain = [], jobs.write_log

    def noted(rows, path, mode):
        held.extend(str(x.name()) for x in spark.sparkContext._jsc.getPersistentRDDs().values())
        plain(rows, path, mode)

    spark.catalog.clearCache()
    monkeypatch.setattr(jobs, "write_log", noted)
    paths = [str(tmp_path / p) for p in ("out", "log", "checkpoint")]
    scorer = lambda df: df.withColumn("prediction", df["gpu_utilization_pct"] * 2)
    _finish(jobs.score_stream(spark.readStream.text(str(tmp_path / "in")), scorer, inputs, order, *paths, "m", "v", once=True))
    log = spark.read.json(paths[1]).select("row_index", "predicted_power_watts", "inputs.*")
    return held, spark.read.parquet(paths[0]), log


def test_the_log_is_made_of_the_stored_answers(spark, tmp_path, monkeypatch):
    fields = ["gpu_utilization_pct", "workload_type"]
    held, answers, log = _run(spark, tmp_path, fields, fields, monkeypatch)
    assert held == []
    columns = ["row_index", "predicted_power_watts", *fields]
    assert sorted(map(tuple, log.select(columns).collect())) == sorted(map(tuple, answers.select(columns).collect()))
    assert log.count() == 30 and all(".zstd." in f.name for f in Path(tmp_path / "out").rglob("part-*"))


def test_inputs_that_answers_lack_are_logged_without_the_request_text(spark, tmp_path, monkeypatch):
    held, answers, log = _run(spark, tmp_path, ["gpu_utilization_pct", "memory_utilization_pct"], ["gpu_utilization_pct"], monkeypatch)
    assert len(held) == 1 and "value#" not in held[0].splitlines()[0]  # its columns
    assert "memory_utilization_pct" not in answers.columns and answers.count() == 30
    assert all(abs(r["memory_utilization_pct"] * 14 - r["predicted_power_watts"]) < 1e-9 for r in log.collect()) and log.count() == 30


def test_requests_of_the_query_are_stored_packed(spark, tmp_path, monkeypatch, sf_dir):
    monkeypatch.setattr(streams, "spool_path", lambda spark, label: str(tmp_path / label))
    rows = streams.score_stream(spark, sf_dir).agg({"rows": "sum"}).first()[0]
    stored = [f for f in Path(tmp_path / "scoring" / "in").rglob("part-*")]
    assert rows > 1000 and sum(f.stat().st_size for f in stored) < rows * 60  # a request has about 190 bytes
