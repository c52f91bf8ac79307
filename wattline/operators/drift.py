"""Reference profiles and input drift.

A profile is a long table with one row per feature, so it has as many rows as
the model has inputs. The drift report collects that small table and one row of
aggregates per feature, and answers every check from those.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from wattline.functions.coerce import numeric
from wattline.operators.columns import feature_columns, is_numeric
from wattline.operators.selection import column_quantiles
from wattline.operators.wide import column_stats, unpivoted

# Sizes kept in a categorical profile and default check limits.
KEPT_CATEGORIES = 100
KEPT_TOP_VALUES = 20
MIN_ROWS = 20
MEAN_SHIFT = 2.0
SHARE_LIMIT = 0.20

PROFILE_SCHEMA = (
    "feature string, feature_type string, ordinal int, row_count bigint, count bigint, missing_rate double, "
    "mean double, std double, min double, p05 double, p50 double, p95 double, max double, "
    "unique_count bigint, categories array<string>, categories_truncated boolean, "
    "top_values array<struct<value:string,count:bigint>>"
)

STATS_SCHEMA = "feature string, rows bigint, valid bigint, bad bigint, mean double, outside bigint"

CHECK_SCHEMA = (
    "feature string, feature_type string, check string, reference_value double, reference_text string, "
    "input_value double, threshold double, severity string, message string"
)


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    """Project to ``schema``; columns the frame lacks are null."""
    fields = df.sparkSession.createDataFrame([], schema).schema.fields
    have = set(df.columns)
    return df.select(
        *[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields]
    )


def value_counts(df: DataFrame, columns: Sequence[str], weight: str | None = None) -> DataFrame:
    """(feature, value, n) of the non-null values of text columns; a row counts ``weight`` times."""
    if not columns:
        return df.sparkSession.createDataFrame([], "feature string, value string, n bigint")
    if weight is not None:
        cells = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("string").alias("value")) for c in columns]
        long = df.select(F.col(weight).alias("n"), F.explode(F.array(*cells)).alias("c")).select("c.*", "n").dropna(subset=["value"])
        return long.groupBy("feature", "value").agg(F.sum("n").alias("n"))
    long = unpivoted(df, columns, lambda d, c: d[f"`{c}`"].cast("string"), ("feature", "value"))
    return long.groupBy("feature", "value").agg(F.count("*").alias("n"))


def numeric_profile(df: DataFrame, columns: Sequence[str], exact: bool = True) -> DataFrame:
    """Count, missing rate, moments and quantiles of numeric features."""
    stats = column_stats(
        df,
        columns,
        lambda _, x: {
            "row_count": F.count(F.lit(1)),
            "count": F.count(x),
            "mean": F.avg(x),
            "std": F.stddev_pop(x),
            "min": F.min(x),
            "max": F.max(x),
        },
    )
    found = column_quantiles(df, columns, (0.05, 0.5, 0.95), exact)
    side = df.sparkSession.createDataFrame(
        [(c, *[found.get(c, {}).get(p) for p in (0.05, 0.5, 0.95)]) for c in columns],
        "feature string, p05 double, p50 double, p95 double",
    )
    # One row per column on both sides.
    return stats.join(F.broadcast(side), "feature").withColumns(
        {
            "feature_type": F.lit("numeric"),
            "missing_rate": 1.0 - F.try_divide(F.col("count"), F.col("row_count")),
        }
    )


def categorical_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts and the most frequent categories of text features.

    ``row_number() <= 100`` lets Spark cut each task's rows to 100 per feature
    before the shuffle, so a feature with very many values stays cheap.
    """
    counts = value_counts(df, columns)
    order = Window.partitionBy("feature").orderBy(F.col("n").desc(), "value")
    top = (
        counts.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= KEPT_CATEGORIES)
        .groupBy("feature")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "value", "n"))).alias("kept"))
    )
    totals = counts.groupBy("feature").agg(F.sum("n").alias("count"), F.count("*").alias("unique_count"))
    rows = df.agg(F.count("*").alias("row_count")).first()["row_count"]
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "feature string")
    joined = names.join(totals, "feature", "left").join(top, "feature", "left")
    kept = F.coalesce("kept", F.array().cast("array<struct<rank:int,value:string,n:bigint>>"))
    filled = F.coalesce("count", F.lit(0))
    return joined.select(
        "feature",
        F.lit("categorical").alias("feature_type"),
        F.lit(rows).cast("bigint").alias("row_count"),
        filled.alias("count"),
        (1.0 - F.try_divide(filled, F.lit(rows))).alias("missing_rate"),
        F.coalesce("unique_count", F.lit(0)).alias("unique_count"),
        F.transform(kept, lambda k: k["value"]).alias("categories"),
        (F.coalesce("unique_count", F.lit(0)) > KEPT_CATEGORIES).alias("categories_truncated"),
        F.transform(
            F.slice(kept, 1, KEPT_TOP_VALUES), lambda k: F.struct(k["value"].alias("value"), k["n"].alias("count"))
        ).alias("top_values"),
    )


def reference_profile(
    df: DataFrame,
    numeric_features: Sequence[str] | None = None,
    categorical_features: Sequence[str] | None = None,
    exact: bool = True,
) -> DataFrame:
    """Profile of the training features, one row per feature in model order.

    A feature the data lacks still gets a row (all statistics null), so that the
    expected input columns stay known.
    """
    if numeric_features is None or categorical_features is None:
        numeric_features, categorical_features = feature_columns(df)
    order = list(numeric_features) + list(categorical_features)
    numbers = [c for c in numeric_features if c in df.columns]
    texts = [c for c in categorical_features if c in df.columns]
    parts = []
    if numbers:
        parts.append(_shaped(numeric_profile(df, numbers, exact), PROFILE_SCHEMA))
    if texts:
        parts.append(_shaped(categorical_profile(df, texts), PROFILE_SCHEMA))
    gone = [(c, "numeric" if c in set(numeric_features) else "categorical") for c in order if c not in df.columns]
    if gone:
        parts.append(_shaped(df.sparkSession.createDataFrame(gone, "feature string, feature_type string"), PROFILE_SCHEMA))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    names = F.array(*[F.lit(c) for c in order])
    return out.withColumn("ordinal", F.array_position(names, F.col("feature")).cast("int") - 1)


def profile_warnings(df: DataFrame, features: Sequence[str], min_rows: int = MIN_ROWS) -> list[str]:
    """What makes a profile weak: too few rows, missing features."""
    out = []
    n = df.limit(min_rows).count()
    if n < min_rows:
        out.append(f"Only {n} reference rows; drift checks are weak below {min_rows}.")
    gone = [c for c in features if c not in df.columns]
    if gone:
        out.append(f"Expected features missing from the reference data: {', '.join(gone)}.")
    return out


def input_statistics(df: DataFrame, numeric_features: Sequence[str]) -> DataFrame:
    """(feature, feature_type, input_rows, input_count, input_mean)."""
    stats = column_stats(
        df,
        numeric_features,
        lambda _, x: {"input_rows": F.count(F.lit(1)), "input_count": F.count(x), "input_mean": F.avg(x)},
    )
    return stats.withColumn("feature_type", F.lit("numeric"))


def join_profile(stats: DataFrame, profile: DataFrame) -> DataFrame:
    """Input statistics next to the reference; features absent on either side drop out."""
    # One row per model input: broadcasting the profile is bounded by the schema.
    return stats.join(F.broadcast(profile), ["feature", "feature_type"])


def unseen_values(df: DataFrame, profile: DataFrame) -> DataFrame:
    """(feature, value, n) of input categories that the profile's lists don't hold.

    At most 100 known categories are kept per feature, so their list is broadcast.
    Features with a truncated or empty list are skipped; :func:`new_values` compares
    them with the whole table of categories.
    """
    usable = profile.where("feature_type = 'categorical' and not categories_truncated and size(categories) > 0")
    names = [r["feature"] for r in usable.select("feature").collect() if r["feature"] in df.columns]
    known = usable.select("feature", F.explode("categories").alias("value"))
    return value_counts(df, names).join(F.broadcast(known), ["feature", "value"], "left_anti")


def new_values(df: DataFrame, columns: Sequence[str], categories: DataFrame) -> DataFrame:
    """(feature, value, n) of input values that the table ``categories`` (feature, value) lacks.

    Values are counted before the anti join, so a value of any frequency is one row.
    """
    return value_counts(df, columns).join(categories.select("feature", "value"), ["feature", "value"], "left_anti")


def _check(
    feature: str, kind: str, check: str, severity: str, message: str,
    reference: object = None, value: Column | None = None, limit: float | None = None, text: str | None = None,
) -> Column:
    return F.struct(
        F.lit(feature).alias("feature"),
        F.lit(kind).alias("feature_type"),
        F.lit(check).alias("check"),
        F.lit(reference).cast("double").alias("reference_value"),
        F.lit(text).cast("string").alias("reference_text"),
        (F.lit(None) if value is None else value).cast("double").alias("input_value"),
        F.lit(limit).cast("double").alias("threshold"),
        F.lit(severity).alias("severity"),
        F.lit(message).alias("message"),
    )


def _state(bad: bool) -> str:
    return "warning" if bad else "ok"


def _schema_rows(df: DataFrame, features: Sequence[tuple[str, str]], bad: Mapping[str, int]) -> list[Column]:
    """Check rows for missing, non-numeric and extra columns."""
    rows = []
    names = [f for f, _ in features]
    for f, kind in features:
        if f not in df.columns:
            text = f"Expected feature '{f}' is absent; it will be imputed or ignored."
            rows.append(_check(f, kind, "missing_feature", "warning", text))
        elif bad.get(f):
            text = f"Feature '{f}' has {bad[f]} value(s) that are not numbers."
            rows.append(_check(f, kind, "non_numeric_values", "warning", text, value=F.lit(bad[f])))
    for c in df.columns:
        if c not in names:
            rows.append(_check(c, "extra", "extra_feature", "info", f"Column '{c}' is not used by the model."))
    return rows


def _check_table(df: DataFrame, rows: Sequence[Column]) -> DataFrame:
    """Check rows as a table, in order; a few per feature."""
    spark = df.sparkSession
    if not rows:
        return spark.createDataFrame([], CHECK_SCHEMA)
    found = spark.range(1).select(F.posexplode(F.array(*rows)).alias("position", "c"))
    return found.select("c.*", "position").orderBy("position").drop("position")


def _text_columns(df: DataFrame, features: Sequence[tuple[str, str]]) -> list[str]:
    return [f for f, k in features if k == "numeric" and f in df.columns and not is_numeric(df.schema[f].dataType)]


def _not_numbers(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """How many values of each text column are present but not numbers."""
    if not columns:
        return {}
    broken = lambda d, c: d[f"`{c}`"].isNotNull() & numeric(d, c).isNull()
    return {r["feature"]: r["n"] for r in column_stats(df, columns, lambda _, x: {"n": F.count_if(x)}, broken).collect()}


def schema_checks(df: DataFrame, features: Sequence[tuple[str, str]]) -> DataFrame:
    """Missing, non-numeric and extra columns of an input. ``features`` is (name, type)."""
    if df.isEmpty():
        raise ValueError("The input to check has no rows.")
    return _check_table(df, _schema_rows(df, features, _not_numbers(df, _text_columns(df, features))))


def _number_stats(df: DataFrame, refs: Sequence[Row]) -> DataFrame | None:
    """(feature, rows, valid, bad, mean, outside) of the numeric inputs."""
    at = {r["feature"]: r for r in refs if r["feature_type"] == "numeric"}
    if not at:
        return None

    def value(d: DataFrame, c: str) -> Column:
        kept = F.lit(False) if is_numeric(d.schema[c].dataType) else d[f"`{c}`"].isNotNull()
        return F.struct(numeric(d, c).alias("x"), kept.alias("given"))

    def build(c: str, v: Column) -> dict[str, Column]:
        x, r = v["x"], at[c]
        low, high = F.lit(r["min"]).cast("double"), F.lit(r["max"]).cast("double")
        return {
            "rows": F.count(F.lit(1)),
            "valid": F.count(x),
            "bad": F.count_if(v["given"] & x.isNull()),
            "mean": F.avg(x),
            "outside": F.count_if((x < low) | (x > high)),
        }

    return column_stats(df, list(at), build, value)


def _text_stats(df: DataFrame, refs: Sequence[Row]) -> DataFrame | None:
    """(feature, rows, valid, bad, mean, outside) of the text inputs; outside means unseen."""
    known = {r["feature"]: list(r["categories"] or []) for r in refs if r["feature_type"] == "categorical"}
    if not known:
        return None
    judged = {
        r["feature"] for r in refs if r["feature_type"] == "categorical" and r["categories"] and not r["categories_truncated"]
    }

    def build(c: str, x: Column) -> dict[str, Column]:
        return {
            "rows": F.count(F.lit(1)),
            "valid": F.count(x),
            "bad": F.lit(0).cast("bigint"),
            "mean": F.lit(None).cast("double"),
            "outside": F.count_if(~x.isin(known[c])) if c in judged else F.lit(0).cast("bigint"),
        }

    return column_stats(df, list(known), build, lambda d, c: d[f"`{c}`"].cast("string"))


def drift_report(
    profile: DataFrame,
    df: DataFrame,
    min_rows: int = MIN_ROWS,
    mean_shift_threshold: float = MEAN_SHIFT,
    range_share_threshold: float = SHARE_LIMIT,
    missing_delta_threshold: float = SHARE_LIMIT,
    unseen_share_threshold: float = SHARE_LIMIT,
    categories: DataFrame | None = None,
) -> DataFrame:
    """Every schema and drift check of an input as one table, from one aggregate job.

    A profile lists the most frequent categories of a feature. With ``categories``, the
    reference's ``value_counts``, features with more are checked against all of theirs;
    without it their check says that it was not made. The profile and the aggregates have one row per feature; the input itself is
    only ever aggregated.
    """
    refs = sorted(profile.collect(), key=lambda r: r["ordinal"])
    features = [(r["feature"], r["feature_type"]) for r in refs]
    judged = [r for r in refs if r["feature"] in df.columns and r["row_count"] is not None]
    total = df.select(F.lit("__dataset__").alias("feature")).groupBy("feature").agg(F.count("*").alias("rows"))
    parts = [_shaped(t, STATS_SCHEMA) for t in (total, _number_stats(df, judged), _text_stats(df, judged)) if t is not None]
    stats = {r["feature"]: r for r in reduce(DataFrame.unionByName, parts).collect()}
    if "__dataset__" not in stats:
        raise ValueError("The input to check has no rows.")
    n = stats["__dataset__"]["rows"]
    cut = [r["feature"] for r in judged if r["feature_type"] == "categorical" and r["categories_truncated"]]
    unseen: dict[str, int] = {}
    if cut and categories is not None:
        found = new_values(df, cut, categories).groupBy("feature").agg(F.sum("n").alias("n")).collect()  # one row per feature
        unseen = {f: 0 for f in cut} | {r["feature"]: r["n"] for r in found}
    unprofiled = [f for f in _text_columns(df, features) if f not in stats]
    bad = {f: s["bad"] for f, s in stats.items()} | _not_numbers(df, unprofiled)
    rows = []
    if n < min_rows:
        known_rows = max((r["row_count"] for r in refs if r["row_count"] is not None), default=None)
        text = f"Only {n} input rows; drift estimates are unstable."
        rows.append(_check("__dataset__", "dataset", "small_input_sample", "warning", text, known_rows, F.lit(n), min_rows))
    rows += _schema_rows(df, features, bad)
    for r in judged:
        f, kind, s = r["feature"], r["feature_type"], stats[r["feature"]]
        before, missing = r["missing_rate"] or 0.0, 1.0 - s["valid"] / n
        delta = missing - before
        rows.append(
            _check(
                f, kind, "missing_rate_delta", _state(delta > missing_delta_threshold),
                f"Missing rate changed by {delta:.3f}.", before, F.lit(missing), missing_delta_threshold,
            )
        )
        share = s["outside"] / s["valid"] if s["valid"] else 0.0
        if kind == "categorical":
            if f in cut and f not in unseen:
                text = f"Not checked: the profile lists {len(r['categories'])} of {r['unique_count']} categories; pass all of them."
                rows.append(_check(f, kind, "unseen_category_share", "info", text, r["unique_count"], None, unseen_share_threshold))
                continue
            if f in unseen:
                share = unseen[f] / s["valid"] if s["valid"] else 0.0
            rows.append(
                _check(
                    f, kind, "unseen_category_share", _state(share > unseen_share_threshold),
                    f"{share:.1%} of values are new categories.", r["unique_count"] or 0, F.lit(share), unseen_share_threshold,
                )
            )
            continue
        if not s["valid"]:
            text = f"Feature '{f}' has no valid number."
            rows.append(_check(f, kind, "no_valid_numeric_values", "warning", text, r["count"], F.lit(0), 1))
            continue
        if r["mean"] is not None:
            shift = abs(s["mean"] - r["mean"]) / max(r["std"] or 0.0, 1e-9)
            rows.append(
                _check(
                    f, kind, "mean_shift_std", _state(shift > mean_shift_threshold),
                    f"Mean moved by {shift:.2f} reference deviations.", r["mean"], F.lit(s["mean"]), mean_shift_threshold,
                )
            )
        if r["min"] is not None and r["max"] is not None:
            rows.append(
                _check(
                    f, kind, "outside_reference_range_share", _state(share > range_share_threshold),
                    f"{share:.1%} of values leave the reference range.", None, F.lit(share), range_share_threshold,
                    text=f"[{r['min']}, {r['max']}]",
                )
            )
    return _check_table(df, rows)


def monitoring_summary(report: DataFrame, profile: DataFrame) -> DataFrame:
    """Status, reference rows, warning count and the warning lines of a drift report."""
    bad = F.col("severity") == "warning"
    line = F.when(bad, F.concat(F.col("feature"), F.lit(": "), F.col("check")))
    rows = profile.agg(F.max("row_count").alias("n")).first()["n"]
    # At most four checks per feature: the list is bounded by the schema.
    return report.agg(
        F.when(F.count_if(bad) > 0, "warning").otherwise("ok").alias("status"),
        F.lit(rows).cast("bigint").alias("reference_rows"),
        F.count_if(bad).alias("warning_count"),
        F.array_join(F.sort_array(F.collect_list(line)), "; ").alias("warnings"),
    )
