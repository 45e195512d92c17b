import pytest

from textmill.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(cores=4, shuffle_partitions=4, memory="3g")
    yield session
    session.stop()
