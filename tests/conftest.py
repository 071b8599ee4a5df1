import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallyloom.session import local_session

    s = local_session(4, 4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    yield s
    s.stop()


@pytest.fixture()
def small_batches(spark):
    """Arrow batches of three rows, so that state must cross them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield spark
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
