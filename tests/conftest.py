import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from relweave.session import local_session

    session = local_session(cores=8, shuffle_partitions=4, memory="10g")
    yield session
    session.stop()
