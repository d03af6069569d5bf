import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import small  # noqa: E402


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with every odd case."""
    return spark.createDataFrame(small.odd_rows(), small.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], small.SCHEMA)


@pytest.fixture(scope="session")
def sf_dir():
    path = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip("no test data")
    return path
