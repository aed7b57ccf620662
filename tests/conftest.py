import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.default.parallelism", "4").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    from blockloom.session import drop_scratch, ship

    ship(session)
    yield session
    drop_scratch(session)
