import pytest
from pyspark.sql import SparkSession

from millrace.plans.binder import Engine


@pytest.fixture(scope="session")
def spark():
    s = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    yield e
    spark.conf.set("spark.sql.caseSensitive", "false")
