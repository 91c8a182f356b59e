import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import session  # noqa: E402

from strataline.settings import GROUP_ROWS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    found = session(os.environ.get("TEST_CPUS", "8"))
    yield found
    found.stop()


@pytest.fixture(params=["short", "long"])
def any_length(spark, request):
    """Runs a test with plain windows and with series cut into chunks of three rows."""
    if request.param == "long":
        spark.conf.set(GROUP_ROWS, "3")
    yield request.param
    spark.conf.unset(GROUP_ROWS)
