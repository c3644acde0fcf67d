from __future__ import annotations

import tempfile

import pytest
from pyspark.sql import SparkSession

from cloakframe.catalog.fixtures import demo_policy

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    if not session.conf.get("spark.checkpoint.dir", None):
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def policy(spark):
    return demo_policy(spark)


@pytest.fixture
def scratch(tmp_path):
    return lambda name: str(tmp_path / name)
