"""The prediction log repeats all names on every line, so it is stored packed."""

from pathlib import Path

from wattline.sources import sinks


def test_log_is_packed_and_reads_back_whole(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("cast(id % 50 as double) as x", "id as row_index", "cast(id as double) as prediction", "cast(null as string) as w")
    for _ in range(2):
        sinks.append_log(sinks.log_rows(rows, ["x", "w"], "m", "v"), str(tmp_path / "log"))
    log = spark.read.json(str(tmp_path / "log"))
    assert log.count() == 40_000 and log.selectExpr("sum(predicted_power_watts) as s").first()["s"] == 2 * sum(range(20_000))
    assert {"x", "w"} == set(log.schema["inputs"].dataType.names)
    stored = sum(f.stat().st_size for f in Path(tmp_path / "log").glob("part-*"))
    assert stored < 40_000 * 30  # a line has about 160 bytes
