import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("placemap-tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def table(spark):
    """Build a table from rows and a schema string."""
    return lambda schema, rows: spark.createDataFrame(rows, schema)


POSITIONS = "run_id long, name string, x double, y double"
DISTANCES = "run_id long, place_a string, place_b string, li_eval long, li_spring long"
DIRECTIONS = "run_id long, place_a string, place_b string, direction string"
SAMPLES = POSITIONS
