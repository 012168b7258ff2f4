import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from flowtusk.session import local_session  # noqa: E402

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="flowtusk-tests")
    yield session
    from flowtusk.plans.storage import drop_stored
    drop_stored(session)
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return DATA


@pytest.fixture
def packets(spark):
    """Make packets from (ts_us, src, dst, len) tuples, numbered in the order given."""
    def make(*rows):
        numbered = [(i, ts, src, dst, 6, length) for i, (ts, src, dst, length) in enumerate(rows)]
        return spark.createDataFrame(
            numbered, "pkt_id bigint, ts_us bigint, src_ip string, dst_ip string, protocol smallint, pkt_len int")
    return make
