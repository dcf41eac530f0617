import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from plumbline.session import SMALL_BYTES_CONF, local_session  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 8, "4g")
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(params=["small", "large"])
def plan(request, spark):
    """Runs a test with the single-window plan and with the range-split plan."""
    before = spark.conf.get(SMALL_BYTES_CONF, None)
    spark.conf.set(SMALL_BYTES_CONF, "0" if request.param == "large" else str(1 << 70))
    yield request.param
    spark.conf.unset(SMALL_BYTES_CONF) if before is None else spark.conf.set(SMALL_BYTES_CONF, before)
