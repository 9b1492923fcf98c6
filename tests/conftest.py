import pytest

from keelson.session import get_session


@pytest.fixture(scope="session")
def spark():
    return get_session("tests", master="local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="3g")
