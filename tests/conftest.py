import pytest


@pytest.fixture(scope="session")
def spark():
    from signalspark.session import get_session

    session = get_session("tests", master="local[4]", shuffle_partitions=4, **{"spark__ui__enabled": "false", "spark__sql__autoBroadcastJoinThreshold": "1m"})
    yield session
    session.stop()
