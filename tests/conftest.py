import pytest

from skeinworks.session import local_session

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    return local_session("*", 8, driver_memory="8g")
