import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tools"))

from plumbline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("8")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Rows as a table: table("a long, b double", [(1, 2.0)])."""

    def make(schema, rows, partitions=None):
        frame = spark.createDataFrame(rows, schema)
        return frame.repartition(partitions) if partitions else frame

    return make
