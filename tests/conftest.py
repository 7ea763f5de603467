import pytest

from markwright.session import get_session, ship_package


@pytest.fixture(scope="session")
def spark():
    session = get_session("tests", spark__master="local[4]", spark__sql__shuffle__partitions="4", spark__driver__memory="4g", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    session.sparkContext.setLogLevel("ERROR")
    ship_package(session)
    yield session
    session.stop()
