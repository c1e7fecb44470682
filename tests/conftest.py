import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("MAILSPARK_TEST_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    from mailspark.session import local_session
    s = local_session("*", app="mailspark-tests")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF
