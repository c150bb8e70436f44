import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from textlake.session import clear_scratch, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        8,
        "tests",
        **{
            "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
        },
    )
    yield session
    clear_scratch(session)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture
def one(spark):
    """Evaluate column expressions over a one-row table of the given strings."""

    def run(expr, **values):
        df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
        return df.select(expr.alias("x")).first()["x"]

    return run
