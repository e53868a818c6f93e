import pytest

from spanwork.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "4g", **{"spark.sql.adaptive.coalescePartitions.enabled": "true"})
    yield session
    session.stop()
