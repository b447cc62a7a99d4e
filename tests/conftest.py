import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pricewise.session import build_session
    s = build_session("local[2]", app="pricewise-tests", shuffle_partitions=4, driver_memory="4g",
                      extra={"spark.checkpoint.dir": tempfile.mkdtemp(prefix="pricewise-test-ckpt-")})
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF001
