import pytest

from textloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(cores=4, memory="8g", name="tests")


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"
