import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from forgeclock.session import local_session

    session = local_session(8, memory="6g")
    yield session
    session.stop()


def documents(spark, rows):
    """(object_key, v) from Python text."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "object_key string, body string")
    return df.select("object_key", F.try_parse_json("body").alias("v"))
