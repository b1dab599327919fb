import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spanwise.session import local_session  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", 4, "6g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture
def values(spark):
    """Evaluate Columns over literal rows: ``values(rows, schema, column)`` gives a list in row order."""
    def run(rows, schema, build):
        df = spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"_i int, {schema}")
        return [r.v for r in df.select("_i", build().alias("v")).orderBy("_i").collect()]
    return run
