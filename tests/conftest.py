import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lograph.session import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tests", "local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4", spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def one(spark):
    """Value of a column expression over one row of named values."""
    def value(expression, **columns):
        given = [F.lit(v).cast("bigint" if isinstance(v, int) else "string").alias(name) for name, v in columns.items()]
        frame = spark.range(1).select(*given) if given else spark.range(1)
        return frame.select(expression.alias("v")).first()["v"]

    return value
