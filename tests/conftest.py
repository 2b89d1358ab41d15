import os

import pytest

from freshet.session import local_session

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def column(spark):
    """Evaluate a Column function on a list of texts."""

    def evaluate(function, values, schema="t string"):
        from pyspark.sql import functions as F

        rows = spark.createDataFrame([(i, value) for i, value in enumerate(values)], f"i int, {schema}")
        result = rows.select("i", function(F.col("t")).alias("r")).orderBy("i")
        return [row.r for row in result.collect()]

    return evaluate
