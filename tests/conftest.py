import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from crewgrid.session import build_session

    s = build_session("crewgrid-tests", 8, 4, "6g")
    yield s
    s.stop()
