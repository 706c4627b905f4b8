import os

os.environ.setdefault("OMP_NUM_THREADS", "1")  # as Spark sets it for its workers

import pytest

from meridian.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
