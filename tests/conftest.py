from __future__ import annotations

import pytest

from postloom.session import get_session


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", "local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
