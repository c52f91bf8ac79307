"""Order statistics, cuts and positions against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wattline.operators import ordering, selection
from wattline.operators.ordering import cut_point, first_rows, flag_first, row_index, session_blocks


def _random_values(seed, n):
    rng = np.random.default_rng(seed)
    kinds = [
        rng.normal(size=n),
        np.round(rng.exponential(5, n)),  # many ties
        rng.lognormal(0, 8, n),  # very long tail
        np.where(rng.random(n) < 0.4, 7.25, rng.normal(size=n)),  # one value holds 40 %
    ]
    return dict(zip("abcd", kinds))


@pytest.mark.parametrize("bound", [5, 100_000])
def test_quantiles_match_numpy(spark, bound):
    values = _random_values(3, 700)
    df = spark.createDataFrame(pd.DataFrame(values))
    probs = (0.0, 0.05, 0.37, 0.5, 0.95, 0.99, 1.0)
    got = selection.quantiles(selection.long_form(df, list(values)), probs, row_bound=bound)
    for name, v in values.items():
        for p in probs:
            assert got[name][p] == pytest.approx(np.quantile(v, p), rel=1e-12, abs=1e-12)


def test_quantiles_skip_missing_and_single_values(spark):
    df = spark.createDataFrame([(1.0, None, float("nan")), (1.0, None, 4.0), (1.0, None, 2.0)], "one double, none double, some double")
    got = selection.column_quantiles(df, ["one", "none", "some"], (0.5,))
    assert got == {"one": {0.5: 1.0}, "some": {0.5: 3.0}}


def test_sketch_quantiles_are_close(spark):
    v = np.arange(10_000, dtype=float)
    df = spark.createDataFrame(pd.DataFrame({"v": v}))
    got = selection.column_quantiles(df, ["v"], (0.5,), exact=False)
    assert abs(got["v"][0.5] - 5000) < 20


def _rows(seed, n):
    r = random.Random(seed)
    words = ["", "a", "ab", "abcdefgh", "abcdefghij", "abcdefghik", "zz", None]
    stamps = [None, *pd.date_range("2025-01-01", periods=5, freq="s").to_pydatetime()]
    return [
        (r.choice(stamps), r.choice(words), r.choice([0.5, 1.5, None, -3.0]), r.choice([True, False]), r.randint(0, 3))
        for _ in range(n)
    ]


SCHEMA = "at timestamp_ntz, word string, x double, flag boolean, k int"


def _sorted(rows, order, columns):
    names = list(order) + [c for c in columns if c not in order]
    return sorted(rows, key=lambda r: tuple((r[columns.index(c)] is None, r[columns.index(c)] or 0 if c != "word" else (r[columns.index(c)] or "")) for c in names))


@pytest.mark.parametrize("bound", [1, 7, 100_000])
@pytest.mark.parametrize("order", [["at"], ["word", "k"], ["x"], ["flag", "word"]])
def test_first_rows_match_a_plain_sort(spark, order, bound):
    columns = ["at", "word", "x", "flag", "k"]
    rows = _rows(11, 300)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = _sorted(rows, order, columns)
    for k in (1, 77, 150, 299):
        out = flag_first(df, order, k, "first", 300, row_bound=bound).collect()
        assert len(out) == 300
        got = sorted(map(repr, [tuple(r)[:5] for r in out if r["first"]]))
        assert got == sorted(map(repr, want[:k])), (order, k)


def test_hot_copies_are_cut_exactly(spark):
    hot = spark.range(5000).select(F.lit(3).alias("a"), F.lit("same").alias("b"))
    rest = spark.range(1000).select((F.col("id") % 10).cast("int").alias("a"), F.col("id").cast("string").alias("b"))
    df = hot.unionByName(rest)
    cut = cut_point(df, ["a"], 2000, 6000, row_bound=50)
    assert cut.copies >= 5000 and 0 < cut.inside < cut.copies
    out = flag_first(df, ["a"], 2000, "first", 6000, row_bound=50)
    assert out.count() == 6000
    assert out.where("first").count() == 2000
    assert first_rows(df, ["a"], 2000).where("b = 'same'").count() == out.where("first and b = 'same'").count()


def test_trivial_cuts(spark):
    df = spark.range(10)
    assert flag_first(df, ["id"], 0, "f").where("f").count() == 0
    assert flag_first(df, ["id"], 10, "f").where("f").count() == 10
    assert flag_first(df.limit(0), ["id"], 3, "f").count() == 0


def test_row_index_is_a_permutation_in_order(spark):
    rows = _rows(5, 400)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    out = sorted(row_index(df, ["at", "word"]).collect(), key=lambda r: r["row_index"])
    assert [r["row_index"] for r in out] == list(range(400))
    want = _sorted(rows, ["at", "word"], ["at", "word", "x", "flag", "k"])
    assert [tuple(r)[:5] for r in out] == want


def test_row_index_spreads_identical_rows(spark):
    df = spark.range(0, 8000, 1, 16).select(F.lit(1).alias("a"))
    out = row_index(df, ["a"])
    assert out.agg(F.countDistinct("row_index")).first()[0] == 8000
    # Copies fall into several ranges, because the source partition is the last sort key.
    parts = out.inputFiles()
    assert len(parts) > 1


def test_no_row_level_single_partition_window(spark, telemetry):
    plan = ordering.row_index(telemetry, ["timestamp"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_session_blocks(spark):
    df = spark.range(650).select(F.col("id").alias("t"))
    out = session_blocks(df, ["t"])
    sizes = {r["session_id"]: r["count"] for r in out.groupBy("session_id").count().collect()}
    assert sizes == {f"synthetic_session_{i}": 108 for i in range(6)} | {"synthetic_session_6": 2}
