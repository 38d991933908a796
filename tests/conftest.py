import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from incident_signals.session import local_session

    session = local_session(4, shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return os.environ.get("SF_DIR", "/root/testdata/sf0.001")
