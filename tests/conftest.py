import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SAMPLE_ROOT = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[*]").appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        # A zone with a daylight-saving gap at midnight: no result may depend on it.
        .config("spark.sql.session.timeZone", "America/Sao_Paulo")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="module", autouse=True)
def nothing_cached(spark):
    """Tables that one module caches do not show up in the plans that another looks at."""
    yield
    spark.catalog.clearCache()


@pytest.fixture(scope="session")
def sample():
    return f"{SAMPLE_ROOT}/sf0.001"


@pytest.fixture
def one(spark):
    """Evaluate column expressions on one literal row."""
    def evaluate(*columns, **values):
        row = spark.range(1)
        return tuple(row.select(*columns).first())
    return evaluate
