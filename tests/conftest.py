import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from stockweave.session import local_session  # noqa: E402
from stockweave.sources.driver import driver_tables  # noqa: E402

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    return local_session(cpus=8, shuffle_partitions=3, memory="8g")


@pytest.fixture(scope="session")
def small(spark):
    """The business tables over the smallest supplied data."""
    return driver_tables(spark, f"{DATA}/sf0.001")
