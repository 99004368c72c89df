import os

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    root = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.warehouse.dir", str(root / "warehouse")).config("spark.checkpoint.dir", str(root / "shared")).getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    session.sparkContext.setCheckpointDir(str(root / "shared"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def data_dir():
    path = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(path):
        pytest.skip(f"{path} is not there")
    return path
