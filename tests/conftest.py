"""One local session for all tests."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tradewind.session import get_spark, ship

    s = get_spark("tests", cpus=4)
    s.sparkContext.setLogLevel("ERROR")
    ship(s)
    yield s
    s.stop()
