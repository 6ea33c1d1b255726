import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallyloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


def column(df, name):
    return [row[name] for row in df.collect()]


def values(spark, expression, texts, kind="string"):
    """Apply a column function to a list of values, in order."""
    rows = spark.createDataFrame(list(enumerate(texts)), f"i int, x {kind}")
    return column(rows.select("i", expression("x").alias("y")).orderBy("i"), "y")
