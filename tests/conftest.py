import pytest

from driftnet.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session(4, 4, spark__sql__execution__arrow__maxRecordsPerBatch="50")
