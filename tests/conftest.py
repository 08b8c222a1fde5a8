import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

DATA = "/root/testdata"


@pytest.fixture(scope="session")
def spark():
    from sievework.session import local_session, prepare

    session = prepare(local_session(memory="4g", shuffle_partitions=4))
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def tiny():
    return f"{DATA}/sf0.001"


@pytest.fixture(scope="session")
def small():
    return f"{DATA}/sf0.01"
