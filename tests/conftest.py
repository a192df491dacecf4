import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

import bindings  # noqa: E402
import quillwork  # noqa: E402

quillwork.ship_by_value(bindings)


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("quillwork-tests")
               .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
               .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g")
               .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="quillwork-tests-"))
               .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
