import os
import sys

import pytest
from pyspark.sql import SparkSession

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, HOME)
MIDDLE = os.environ.get("TEST_SF_DIR_MIDDLE", "/root/testdata/sf0.1")
SMALL = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from lectern.session import build

    session = build("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false", "spark.driver.host": "127.0.0.1"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="module", autouse=True)
def no_tables_cached_by_other_modules():
    """Plans read a table that another module has cached in place of the files, with exchanges of their own."""
    yield
    if session := SparkSession.getActiveSession():
        session.catalog.clearCache()
