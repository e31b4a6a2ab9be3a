"""Every registered query against its SQL on DuckDB, over whole tables at the smallest scale."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402
import check  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Fitting many models takes minutes on one machine; these run in tools/check.py.
SLOW = {"prepared_fit", "experiment_regression", "experiment_classification", "experiment_untuned", "network_fit", "forest_selection"}


@pytest.fixture(scope="module")
def connection():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, connection, name):
    assert check.compare(spark, connection, FOLDER, QUERIES[name], ORACLES.get(name)) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
