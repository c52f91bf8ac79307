"""Registered queries against DuckDB, and the driver contract."""

import pytest

import __spark_entry__ as entry_point
from suite.registry import ORACLES, QUERIES
from suite.verify import compare, connect

# Model fits are covered in test_models; here only their cheap relatives run.
SLOW = ("ml_", "exp_", "str_", "scr_01", "reg_01", "reg_03")
NAMES = [n for n in QUERIES if n in ORACLES and not n.startswith(SLOW)]


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, sf_dir, name):
    status, detail, _ = compare(spark, con, name, sf_dir)
    assert status in ("ok", "ok-EMPTY"), detail


def test_contract(spark):
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert entry_point.entry(spark).count() > 0
