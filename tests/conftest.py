from __future__ import annotations

import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    s = (
        SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").config("spark.local.dir", folder).config("spark.checkpoint.dir", f"{folder}/checkpoint").config("spark.sql.warehouse.dir", f"{folder}/warehouse").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    return SF
