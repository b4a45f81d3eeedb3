"""Every registered query with an SQL form agrees with it, and every other one gives rows."""

from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import connect, differences  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_oracle_has_a_query():
    assert set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("key", sorted(oracle_sql()))
def test_matches_oracle(spark, connection, key):
    assert differences(spark, connection, FOLDER, key) is None


@pytest.mark.parametrize("key", ["lmm_fit", "smooth_curve", "elevated_rate_imputed", "excess_by_day"])
def test_model_queries_give_rows(spark, key):
    assert queries()[key](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry(spark).count() > 0
