import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from orderloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(**{"spark.sql.shuffle.partitions": "4"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"


def gappy_lookups(spark, folder):
    """Lookups with gaps, so that every step has something to reject."""
    from orderloom.sources import tables

    full = tables.lookups(spark, folder)
    return full._replace(
        prices=full.prices.filter("price_cents < 99000"),
        balances=full.balances.filter("balance >= 0"),
        stock=full.stock.filter("on_hand > 5"),
    )
