import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture
def frame(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make


@pytest.fixture
def hourly(spark):
    """Hourly rows from (grid, start, values): consecutive hours, half of it internet."""
    from pyspark.sql import functions as F

    def make(*series):
        rows = []
        for grid, start, values in series:
            rows += [(grid, start, i, float(v)) for i, v in enumerate(values)]
        df = spark.createDataFrame(rows, "grid_id string, start string, i int, total_activity double")
        ts = F.to_timestamp("start") + F.make_dt_interval(F.lit(0), F.col("i"))
        return df.select("grid_id", ts.alias("timestamp"), "total_activity",
                         (F.col("total_activity") * 0.5).alias("internet_activity"),
                         F.to_date(ts).alias("date"))

    return make
