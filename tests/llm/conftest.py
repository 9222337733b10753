import os

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("test tables not present")
    return SF


@pytest.fixture
def documents(spark):
    """documents((doc_id, text), ...) with columns that clash with the operators' own names."""
    def make(*rows):
        full = [(i, t, "x", "y", 1, 2, [3]) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, node string, component string, n int, v int, spans array<int>")

    return make
