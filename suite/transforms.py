"""Projections, scalar expressions, filters and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import query
from suite.views import FEATURES, KEYS, LEAKY_SQL, leaky, rdg, readings, table, tel, telemetry
from wattline.functions import coerce, scalars
from wattline.operators import audit
from wattline.operators.ordering import first_rows, row_index, session_blocks
from wattline.operators.selection import medians
from wattline.operators.wide import column_stats
from wattline.plans.scoring import align
from wattline.sources import bmc_csv, long_csv, wide_csv


@query(
    "prj_01_clean_header",
    """SELECT p_partkey, trim(regexp_replace(lower(trim('  ' || p_name || ' (%) ' || p_type || '--' || p_brand || ' ')), '[^0-9a-zA-Z]+', '_', 'g'), '_') AS header
    FROM part""",
)
def clean_header(spark, sf_dir):
    raw = F.concat(F.lit("  "), "p_name", F.lit(" (%) "), "p_type", F.lit("--"), "p_brand", F.lit(" "))
    return table(spark, sf_dir, "part").select("p_partkey", coerce.clean_text(raw).alias("header"))


@query(
    "prj_02_alias_resolution",
    tel(
        """ SELECT 'node-' || session_id || '_gpu_' || CAST(k2 AS VARCHAR) AS session_id, count(*) AS "rows",
        round(sum(power_watts), 4) AS power, round(sum(gpu_utilization_pct), 4) AS util,
        round(sum(temperature_c), 4) AS temp, round(sum(k1::DOUBLE), 4) AS tx
        FROM telemetry WHERE power_watts > 0 AND power_watts < 2000 GROUP BY 1"""
    ),
)
def alias_resolution(spark, sf_dir):
    raw = telemetry(spark, sf_dir).select(
        F.concat(F.lit("node-"), "session_id").alias("Host Name".replace(" ", "")),
        F.col("k2").alias("Minor Number"),
        F.col("power_watts").alias("GPU Power (W)"),
        F.lit(-1.0).alias("power"),
        F.col("gpu_utilization_pct").alias("SM-Utilization"),
        F.col("memory_utilization_pct").alias("utilization.memory"),
        F.col("temperature_c").alias("temperature.gpu"),
        F.col("k1").alias("PCIe TX bytes"),
    )
    df = wide_csv.normalize_wide(raw, "mit_supercloud", "trace.csv")
    return df.groupBy("session_id").agg(
        F.count("*").alias("rows"),
        F.round(F.sum("power_watts"), 4).alias("power"),
        F.round(F.sum("gpu_utilization_pct"), 4).alias("util"),
        F.round(F.sum("temperature_c"), 4).alias("temp"),
        F.round(F.sum("pcie_tx_mbps"), 4).alias("tx"),
    )


@query("prj_03_numeric_coercion", rdg(" SELECT event_id, clean AS value FROM readings"))
def numeric_coercion(spark, sf_dir):
    return readings(spark, sf_dir).select("event_id", coerce.to_number(F.col("dirty")).alias("value"))


@query(
    "prj_03_number_forms",
    """SELECT event_id, CASE event_id % 8 WHEN 0 THEN event_id::DOUBLE WHEN 1 THEN NULL WHEN 2 THEN event_id * 1000.0::DOUBLE
       WHEN 3 THEN -event_id::DOUBLE WHEN 4 THEN event_id + 0.5::DOUBLE WHEN 5 THEN NULL WHEN 6 THEN NULL ELSE 0.5::DOUBLE END AS value
    FROM events""",
)
def number_forms(spark, sf_dir):
    i = F.col("event_id").cast("string")
    forms = [
        i, F.concat(i, F.lit("d")), F.concat(i, F.lit("e3")), F.concat(F.lit("-"), i),
        F.concat(F.lit(" +"), i, F.lit(".5 ")), F.lit("inf"), F.concat(i, F.lit(" W")), F.lit(".5"),
    ]
    text = forms[7]
    for r in range(7):
        text = F.when(F.col("event_id") % 8 == r, forms[r]).otherwise(text)
    return table(spark, sf_dir, "events").select("event_id", coerce.to_number(text).alias("value"))


@query(
    "prj_04_time_coercion",
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 2 THEN date_trunc('day', ts)
       WHEN event_id % 4 = 1 THEN date_trunc('millisecond', ts) ELSE date_trunc('second', ts) END::TIMESTAMP AS at
    FROM events""",
)
def time_coercion(spark, sf_dir):
    m = F.col("event_id") % 4
    text = (
        F.when(m == 3, F.lit("not a time"))
        .when(m == 2, F.date_format("ts", "yyyy-MM-dd"))
        .when(m == 1, F.date_format("ts", "yyyy/MM/dd HH:mm:ss.SSS"))
        .otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    return table(spark, sf_dir, "events").select("event_id", coerce.to_time(text).alias("at"))


@query("prj_05_missing_tokens", rdg(" SELECT mt, count(*) AS \"rows\", count(clean) AS valid, round(sum(clean), 4) AS total FROM readings GROUP BY 1"))
def missing_tokens(spark, sf_dir):
    value = coerce.reading(F.col("dirty"))
    return readings(spark, sf_dir).groupBy("mt").agg(
        F.count("*").alias("rows"), F.count(value).alias("valid"), F.round(F.sum(value), 4).alias("total")
    )


@query(
    "prj_06_session_id",
    """SELECT CASE WHEN l_orderkey % 10 = 0 THEN 'unknown' ELSE CAST(l_orderkey % 40 AS VARCHAR) END || '_gpu_' || CAST(l_linenumber AS VARCHAR) AS session_id,
    count(*) AS "rows" FROM lineitem GROUP BY 1""",
)
def session_id(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    job = F.when(F.col("l_orderkey") % 10 != 0, F.col("l_orderkey") % 40)
    return li.groupBy(scalars.session_of(job, F.col("l_suppkey"), "trace", F.col("l_linenumber")).alias("session_id")).agg(
        F.count("*").alias("rows")
    )


@query(
    "prj_07_provenance",
    """SELECT 'local_nvidia_smi_gpu_trace' AS workload_type, 'gpu_telemetry.csv' AS source_file,
       'gpu_telemetry_gpu_' || CAST(l_linenumber AS VARCHAR) AS session_id, count(*) AS "rows"
    FROM lineitem WHERE l_extendedprice / 100 > 0 AND l_extendedprice / 100 < 2000 GROUP BY 3""",
)
def provenance(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        F.col("l_linenumber").alias("index"), (F.col("l_extendedprice") / 100).alias("power_watts"),
        F.col("l_quantity").alias("gpu_utilization_pct"), F.col("l_tax").alias("memory_utilization_pct"),
        F.col("l_quantity").alias("temperature_c"), F.lit("collected").alias("workload_type"), F.lit("own").alias("session_id"),
    )
    df = wide_csv.normalize_wide(raw, "local_nvidia_smi", "gpu_telemetry.csv")
    return df.groupBy("workload_type", "source_file", "session_id").agg(F.count("*").alias("rows"))


@query(
    "prj_08_metric_rename",
    """SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS "timestamp", CAST(user_id AS VARCHAR) AS session_id,
       round(avg(CASE WHEN event_type = 'click' THEN value END), 6) AS power_watts,
       round(avg(CASE WHEN event_type = 'error' THEN value END), 6) AS memory_utilization_pct,
       round(avg(CASE WHEN event_type = 'purchase' THEN value END), 6) AS graphics_clock_mhz,
       round(avg(CASE WHEN event_type = 'signup' THEN value END), 6) AS temperature_c,
       round(avg(CASE WHEN event_type = 'view' THEN value END), 6) AS gpu_utilization_pct
    FROM events GROUP BY 1, 2""",
)
def metric_rename(spark, sf_dir):
    names = dict(zip(("click", "error", "purchase", "signup", "view"), long_csv.METRIC_NAMES))
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    raw = readings(spark, sf_dir).select(
        "ts", "dv", F.element_at(F.create_map(*pairs), F.col("mt")).alias("mt"), "vl"
    )
    wide = long_csv.rename_metrics(long_csv.pivot_readings(long_csv.typed_readings(raw), list(long_csv.METRIC_NAMES)))
    return wide.select("timestamp", "session_id", *[F.round(c, 6).alias(c) for c in long_csv.METRIC_NAMES.values()])


def _milli_units(spark, sf_dir):
    return telemetry(spark, sf_dir).select(
        "k1", "k2",
        (F.col("temperature_c") * 1000).alias("inlet_temp"),
        F.col("ambient_c").alias("outlet_c"),
        (F.col("gpu_utilization_pct") * 1000).alias("psu_vin"),
        (F.col("power_watts") * 1000000).alias("micro_power"),
        (F.col("power_watts") * 1000).alias("milli_power"),
        F.col("power_watts").alias("plain_power"),
        (F.col("power_watts") * 1000).alias("other"),
    )


@query(
    "prj_09_unit_rescale",
    tel(
        """ SELECT k2, round(sum(temperature_c), 3) AS inlet_temp, round(sum(ambient_c), 3) AS outlet_c, round(sum(gpu_utilization_pct), 3) AS psu_vin,
        round(sum(power_watts), 3) AS micro_power, round(sum(power_watts), 3) AS milli_power,
        round(sum(power_watts), 3) AS plain_power, round(sum(power_watts * 1000), 1) AS other FROM telemetry GROUP BY 1"""
    ),
)
def unit_rescale(spark, sf_dir):
    df = bmc_csv.repair_units(_milli_units(spark, sf_dir))
    names = ["inlet_temp", "outlet_c", "psu_vin", "micro_power", "milli_power", "plain_power"]
    return df.groupBy("k2").agg(
        *[F.round(F.sum(c), 3).alias(c) for c in names], F.round(F.sum("other"), 1).alias("other")
    )


@query(
    "prj_10_memory_ratio",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax * 100 > 0 THEN round(l_quantity / (l_tax * 100) * 100.0, 4) END AS memory_utilization_pct
    FROM lineitem""",
)
def memory_ratio(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumns(
        {"mem_used_gpu0": F.col("l_quantity"), "mem_total_gpu0": F.col("l_tax") * 100}
    )
    return bmc_csv.add_memory_share(li).select(
        "l_orderkey", "l_linenumber", "l_partkey", F.round("memory_utilization_pct", 4).alias("memory_utilization_pct")
    )


@query(
    "prj_11_target_inference",
    """SELECT l_suppkey, round(sum(coalesce(CASE WHEN l_linenumber <> 2 THEN l_quantity END, 0) + coalesce(CASE WHEN l_linenumber <> 3 THEN l_tax END, 0)), 4) AS power_watts
    FROM lineitem GROUP BY 1""",
)
def target_inference(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumns(
        {
            "PSU1_Total_Power": F.when(F.col("l_linenumber") != 2, F.col("l_quantity")),
            "PSU2_Total_Power": F.when(F.col("l_linenumber") != 3, F.col("l_tax")),
        }
    )
    return bmc_csv.infer_target(li).groupBy("l_suppkey").agg(F.round(F.sum("power_watts"), 4).alias("power_watts"))


@query(
    "prj_12_bmc_finalize",
    tel(
        """ SELECT session_id AS source_file, session_id, 'bmc_real_trace' AS workload_type, min("timestamp") AS first_at,
        round(avg(gpu_utilization_pct), 6) AS util, round(avg(temperature_c), 6) AS temp, round(avg(power_watts), 6) AS power
        FROM telemetry GROUP BY 1, 2"""
    ),
)
def bmc_finalize(spark, sf_dir):
    raw = telemetry(spark, sf_dir).select(
        F.col("session_id").alias("source_file"), F.col("timestamp").alias("_time"),
        F.col("gpu_utilization_pct").alias("util_gpu0"), F.col("temperature_c").alias("temp_gpu0"),
        F.col("power_watts").alias("power_gpu0"),
    )
    df = bmc_csv.finalize(bmc_csv.infer_target(raw))
    return df.groupBy("source_file", "session_id", "workload_type").agg(
        F.min("timestamp").alias("first_at"), F.round(F.avg("gpu_utilization_pct"), 6).alias("util"),
        F.round(F.avg("temperature_c"), 6).alias("temp"), F.round(F.avg("power_watts"), 6).alias("power"),
    )


@query(
    "prj_13_clamp_round",
    tel(
        """ SELECT k1, k2, power_watts AS raw, round_even(least(greatest(power_watts * 3 - 60, 18), 420), 3) AS power_watts,
        round_even(least(greatest(temperature_c * 2, 22), 92), 3) AS temperature_c FROM telemetry"""
    ),
)
def clamp_round(spark, sf_dir):
    limit = lambda c, name: scalars.clamp(c, *scalars.CLAMP_LIMITS[name])
    return telemetry(spark, sf_dir).select(
        "k1", "k2", F.col("power_watts").alias("raw"),
        limit(F.col("power_watts") * 3 - 60, "power_watts").alias("power_watts"),
        limit(F.col("temperature_c") * 2, "temperature_c").alias("temperature_c"),
    )


_ORDER = '"timestamp", k1, k2, session_id, gpu_utilization_pct, memory_utilization_pct, graphics_clock_mhz, memory_clock_mhz, temperature_c, ambient_c, workload_type, power_watts'


@query(
    "prj_14_session_blocks",
    tel(
        f""" SELECT 'synthetic_session_' || CAST(i // greatest(100, n // 6) AS VARCHAR) AS session_id, count(*) AS "rows",
        round(sum(power_watts), 4) AS power, min("timestamp") AS first_at, max("timestamp") AS last_at
        FROM (SELECT *, row_number() OVER (ORDER BY {_ORDER}) - 1 AS i, count(*) OVER () AS n FROM telemetry) GROUP BY 1"""
    ),
)
def blocks(spark, sf_dir):
    t = telemetry(spark, sf_dir).withColumnRenamed("session_id", "trace")
    df = session_blocks(t, ["timestamp", "k1", "k2", "trace"])
    return df.groupBy("session_id").agg(
        F.count("*").alias("rows"), F.round(F.sum("power_watts"), 4).alias("power"),
        F.min("timestamp").alias("first_at"), F.max("timestamp").alias("last_at"),
    )


SCORE_SQL = """25 + 1.15::DOUBLE * gpu_utilization_pct + 0.45::DOUBLE * memory_utilization_pct
    + 0.018::DOUBLE * (graphics_clock_mhz - 900) + 0.008::DOUBLE * (memory_clock_mhz - 3200)
    + 0.75::DOUBLE * greatest(temperature_c - 45, 0) + 0.0025::DOUBLE * gpu_utilization_pct * memory_utilization_pct"""


@query("prj_15_analytic_power", tel(f" SELECT k1, k2, power_watts, round({SCORE_SQL}, 6) AS prediction FROM telemetry"))
def analytic_power(spark, sf_dir):
    return telemetry(spark, sf_dir).select(
        "k1", "k2", "power_watts", F.round(scalars.analytic_power_of_row(), 6).alias("prediction")
    )


@query(
    "prj_16_regime_signal",
    "SELECT event_id, round(sin(event_id / 900.0) * 6 + CASE WHEN event_id % 2000 < 400 THEN 8 ELSE 0 END, 6) AS regime FROM events",
)
def regime(spark, sf_dir):
    return table(spark, sf_dir, "events").select(
        "event_id", F.round(scalars.regime_signal(F.col("event_id")), 6).alias("regime")
    )


@query(
    "prj_17_safe_number",
    "SELECT event_type, count(*) AS \"rows\", count(CASE WHEN event_id % 3 = 2 THEN value END) AS valid FROM events GROUP BY 1",
)
def safe_number(spark, sf_dir):
    raw = (
        F.when(F.col("event_id") % 3 == 0, F.lit(float("nan")))
        .when(F.col("event_id") % 3 == 1, F.lit(float("-inf")))
        .otherwise(F.col("value"))
    )
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("rows"), F.count(coerce.safe_number(raw)).alias("valid")
    )


@query(
    "prj_21_align_inputs",
    rdg(
        """ SELECT event_id, clean AS gpu_utilization_pct, CAST(NULL AS DOUBLE) AS memory_utilization_pct,
        CAST(NULL AS DOUBLE) AS temperature_c, mt AS workload_type FROM readings"""
    ),
)
def align_inputs(spark, sf_dir):
    raw = readings(spark, sf_dir).select(
        "event_id", F.col("dirty").alias("gpu_utilization_pct"), F.col("mt").alias("workload_type"), "dv"
    )
    numbers = ["gpu_utilization_pct", "memory_utilization_pct", "temperature_c"]
    return align(raw, numbers, ["workload_type"], keep=["event_id"])


@query(
    "flt_01_plausible_target",
    tel(""" SELECT workload_type, count(*) AS "rows", round(min(p), 6) AS lowest, round(max(p), 6) AS highest
        FROM (SELECT workload_type, CASE WHEN k1 % 7 = 0 THEN NULL ELSE power_watts * 12 - 400 END AS p FROM telemetry)
        WHERE p > 0 AND p < 2000 GROUP BY 1"""),
)
def plausible(spark, sf_dir):
    df = telemetry(spark, sf_dir).withColumn(
        "power_watts", F.when(F.col("k1") % 7 != 0, F.col("power_watts") * 12 - 400)
    )
    return audit.plausible_target(df).groupBy("workload_type").agg(
        F.count("*").alias("rows"), F.round(F.min("power_watts"), 6).alias("lowest"), F.round(F.max("power_watts"), 6).alias("highest")
    )


@query(
    "flt_02_key_nulls",
    """SELECT event_type AS mt, count(*) AS "rows" FROM events WHERE event_id % 3 <> 0 AND event_id % 5 <> 0 GROUP BY 1""",
)
def key_nulls(spark, sf_dir):
    raw = readings(spark, sf_dir).select(
        F.when(F.col("event_id") % 3 != 0, F.col("ts").cast("string")).otherwise(F.lit("bad")).alias("ts"),
        F.when(F.col("event_id") % 5 != 0, F.col("dv")).alias("dv"), "mt", "vl",
    )
    return long_csv.typed_readings(raw).groupBy("mt").agg(F.count("*").alias("rows"))


def _holes(spark, sf_dir):
    t = leaky(spark, sf_dir)
    return t.withColumns(
        {
            "rare": F.when(F.col("k1") % 50 == 0, F.col("ambient_c")),
            "quarter": F.when(F.col("k1") % 2 == 0, F.col("ambient_c")),
            "empty": F.lit(None).cast("double"),
        }
    )


_HOLES_SQL = f""", {LEAKY_SQL}, holes AS (
  SELECT *, CASE WHEN k1 % 50 = 0 THEN ambient_c END AS rare, CASE WHEN k1 % 2 = 0 THEN ambient_c END AS quarter,
  CAST(NULL AS DOUBLE) AS empty FROM leaky)"""
_HOLE_COLUMNS = (
    "k1 k2 timestamp session_id gpu_utilization_pct memory_utilization_pct graphics_clock_mhz memory_clock_mhz temperature_c "
    "ambient_c workload_type power_watts target_copy constant board_power_like rare quarter empty"
).split()
_NUMERIC_HOLES = [c for c in _HOLE_COLUMNS if c not in ("timestamp", "session_id", "workload_type")]


def _each(columns, template):
    return " UNION ALL ".join(template.format(c=c, q=f'"{c}"') for c in columns)


@query(
    "flt_03_sparse_columns",
    tel(
        _HOLES_SQL
        + " "
        + _each(
            _HOLE_COLUMNS,
            "SELECT '{c}' AS \"column\", '{c}' NOT IN ('power_watts', 'session_id', 'timestamp') AND "
            "count({q}) < greatest(40, floor(0.25 * count(*))) AS dropped FROM holes",
        )
    ),
)
def sparse(spark, sf_dir):
    df = _holes(spark, sf_dir)
    return audit.decisions(df, audit.sparse_columns(df))


@query(
    "flt_04_flat_columns",
    tel(
        _HOLES_SQL
        + " "
        + _each(
            _NUMERIC_HOLES,
            "SELECT '{c}' AS \"column\", '{c}' <> 'power_watts' AND (count({q}) < greatest(20, floor(0.05 * count(*))) "
            "OR count(DISTINCT {q}) <= 1) AS dropped FROM holes",
        )
        + " UNION ALL SELECT * FROM (VALUES ('timestamp', false), ('session_id', false), ('workload_type', false))"
    ),
)
def flat(spark, sf_dir):
    df = _holes(spark, sf_dir)
    return audit.decisions(df, audit.flat_columns(df))


@query(
    "flt_05_power_names",
    tel(
        _HOLES_SQL
        + ", named AS (SELECT *, 1 AS PSU1_volts, 1 AS fan_vin FROM holes) "
        + _each(
            [*_HOLE_COLUMNS, "PSU1_volts", "fan_vin"],
            "SELECT '{c}' AS \"column\", '{c}' <> 'power_watts' AND regexp_matches(lower('{c}'), 'power|energy|watts|psu|_cin|_vin') AS dropped, "
            "count({q}) AS filled FROM named",
        )
    ),
)
def power_names(spark, sf_dir):
    # The decision of every column, with how many values it holds.
    df = _holes(spark, sf_dir).withColumns({"PSU1_volts": F.lit(1), "fan_vin": F.lit(1)})
    filled = column_stats(df, df.columns, lambda _, x: {"filled": F.count(x)}, lambda d, c: d[c].cast("string"))
    decided = audit.decisions(df, audit.power_named_columns(df))
    return decided.join(filled.withColumnRenamed("feature", "column"), "column")


@query(
    "flt_06_leaking_columns",
    tel(
        _HOLES_SQL
        + " "
        + _each(
            [c for c in _NUMERIC_HOLES if c not in ("constant", "empty")],
            "SELECT '{c}' AS \"column\", '{c}' <> 'power_watts' AND abs(corr({q}, power_watts)) >= 0.995 "
            "AND count({q}) >= 12 AS dropped FROM holes",
        )
        + " UNION ALL SELECT * FROM (VALUES ('timestamp', false), ('session_id', false), ('workload_type', false), ('constant', false), ('empty', false))"
    ),
)
def leaking(spark, sf_dir):
    df = _holes(spark, sf_dir)
    return audit.decisions(df, audit.leaking_columns(df))


@query(
    "flt_07_row_cap",
    tel(
        f""" SELECT session_id, count(*) AS "rows", round(sum(power_watts), 4) AS power
        FROM (SELECT * FROM telemetry ORDER BY k1, k2, "timestamp", session_id, power_watts LIMIT 5000) GROUP BY 1"""
    ),
)
def row_cap(spark, sf_dir):
    df = first_rows(telemetry(spark, sf_dir), ["k1", "k2", "timestamp", "session_id", "power_watts"], 5000)
    return df.groupBy("session_id").agg(F.count("*").alias("rows"), F.round(F.sum("power_watts"), 4).alias("power"))


@query(
    "agg_01_pivot",
    """SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS ts, CAST(user_id AS VARCHAR) AS dv,
       round(avg(value) FILTER (event_type = 'click'), 6) AS click, round(avg(value) FILTER (event_type = 'error'), 6) AS error,
       round(avg(value) FILTER (event_type = 'purchase'), 6) AS purchase, round(avg(value) FILTER (event_type = 'signup'), 6) AS signup,
       round(avg(value) FILTER (event_type = 'view'), 6) AS view FROM events GROUP BY 1, 2""",
)
def pivot(spark, sf_dir):
    metrics = ["click", "error", "purchase", "signup", "view"]
    wide = long_csv.pivot_readings(long_csv.typed_readings(readings(spark, sf_dir)), metrics)
    return wide.select("ts", "dv", *[F.round(m, 6).alias(m) for m in metrics])


@query(
    "agg_02_merge_duplicates",
    tel(
        """ SELECT session_id AS source_file, "timestamp" AS _time, round(avg(gpu_utilization_pct), 6) AS util_gpu0,
        round(avg(power_watts), 6) AS power_gpu0 FROM telemetry GROUP BY 1, 2"""
    ),
)
def merge_duplicates(spark, sf_dir):
    raw = telemetry(spark, sf_dir).select(
        F.col("session_id").alias("source_file"), F.col("timestamp").alias("_time"), "workload_type",
        F.col("gpu_utilization_pct").alias("util_gpu0"), F.col("power_watts").alias("power_gpu0"),
    )
    df = bmc_csv.merge_duplicates(raw)
    return df.select("source_file", "_time", *[F.round(c, 6).alias(c) for c in ("util_gpu0", "power_gpu0")])


@query(
    "agg_03_medians",
    tel(" " + _each([*FEATURES, "power_watts"], "SELECT '{c}' AS \"column\", round(median({q}), 6) AS median FROM telemetry")),
)
def column_medians(spark, sf_dir):
    found = medians(telemetry(spark, sf_dir), [*FEATURES, "power_watts"])
    return spark.createDataFrame(list(found.items()), "column string, median double").withColumn("median", F.round("median", 6))


@query(
    "win_02_row_index",
    tel(
        f""" SELECT session_id, min(i) AS first_index, max(i) AS last_index, CAST(sum(i) AS BIGINT) AS total FROM (
        SELECT session_id, row_number() OVER (ORDER BY {_ORDER}) - 1 AS i FROM telemetry) GROUP BY 1"""
    ),
)
def positions(spark, sf_dir):
    df = row_index(telemetry(spark, sf_dir), ["timestamp", *KEYS, "session_id"])
    return df.groupBy("session_id").agg(
        F.min("row_index").alias("first_index"), F.max("row_index").alias("last_index"), F.sum("row_index").alias("total")
    )
