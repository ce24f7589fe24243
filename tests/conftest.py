import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from handprint.session import prepare
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.driver.memory", "8g")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    prepare(s)
    yield s


@pytest.fixture(scope="session")
def mac(spark):
    """The 4 x 3 matrix M of the goldens, long form, absent = no row."""
    rows = [("Mac1", "a", 1.0), ("Mac1", "b", 25.0), ("Mac1", "c", 3.0),
            ("Mac2", "b", 23.0), ("Mac2", "c", 5.0),
            ("Mac3", "b", 30.0), ("Mac3", "c", 20.0),
            ("Mac4", "b", 15.0), ("Mac4", "c", 1.0)]
    values = spark.createDataFrame(rows, "doc_id string, feature string, value double")
    docs = spark.createDataFrame([(d,) for d in ["Mac1", "Mac2", "Mac3", "Mac4"]], "doc_id string")
    return values, docs
