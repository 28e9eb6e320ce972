import pytest

from prsloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4, "6g")
    s.sparkContext.setLogLevel("ERROR")
    return s
