import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from marketloom import get_session  # noqa: E402
from marketloom.sources.tables import Market  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return get_session("8", shuffle_partitions=4, app="tests")


@pytest.fixture(scope="session")
def market(spark):
    return Market(spark, SF_DIR)


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


def rows(df, *order):
    """Rows as tuples, sorted by all columns unless an order is given."""
    got = [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
    return got if order else sorted(got, key=lambda t: tuple((v is not None, str(v)) for v in t))
