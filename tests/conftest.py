import pytest
from pyspark.sql import SparkSession

import shelfmark


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("shelfmark-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield shelfmark.configure(session)
    session.stop()


@pytest.fixture(scope="session")
def rows(spark):
    """Build a DataFrame from tuples and a schema text."""
    return lambda data, schema: spark.createDataFrame(data, schema)
