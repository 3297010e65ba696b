import pytest

from notewell.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=4, shuffle_partitions=4, spark__driver__memory="4g")
    yield session
    session.stop()
