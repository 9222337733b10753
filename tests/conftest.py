import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from weighbridge.session import local_session  # noqa: E402
from weighbridge.sources import release  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "tests", "6g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


@pytest.fixture
def frame(spark):
    """frame(ddl, rows...) -> DataFrame"""
    return lambda ddl, *rows: spark.createDataFrame(list(rows), ddl)
