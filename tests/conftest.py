import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tallywarden.session import build_session, new_folder, prepare  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = prepare(build_session("tests", "local[8]", 4))
    yield session
    session.stop()


@pytest.fixture
def work(spark):
    return new_folder(spark, "test")


@pytest.fixture
def tx(spark):
    """Transactions from (user, amount, seconds) in arrival order."""

    def build(rows, start_us=1_700_000_000_000_000):
        data = [(i, str(i), u, float(a), start_us + round(t * 1_000_000)) for i, (u, a, t) in enumerate(rows)]
        df = spark.createDataFrame(data, "seq bigint, transaction_id string, user_id string, amount double, us bigint")
        return df.selectExpr("*", "timestamp_micros(us) AS ts", "cast(null as string) AS event")

    return build
