import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from braidwork.session import session

    s = session(4, 4, "tests", spark__driver__memory="4g")
    yield s
    s.stop()
