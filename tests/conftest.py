import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from gridmill.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.log.level": "ERROR"})
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from gridmill.registry.base import Tables
    return Tables(spark, "/root/testdata/sf0.001")
