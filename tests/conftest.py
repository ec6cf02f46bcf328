"""One local session; scenarios are separate videos of one analysis, so each rule runs once."""
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession  # noqa: E402

from lanewise.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = configure(SparkSession.builder.master("local[8]").appName("lanewise-tests")
                  .config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false")
                  .config("spark.driver.memory", "8g")).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
