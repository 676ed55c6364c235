import os

import pytest

from spendlens.session import local_session, shared_root

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "spendlens-tests")
    session.sparkContext.setLogLevel("ERROR")
    shared_root(session)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR
