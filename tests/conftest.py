import pytest

from ruleflow.storage import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("ruleflow-tests", cores="8", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
