import os
import sys

import pytest

ROOT = os.path.join(os.path.dirname(os.path.abspath(__file__)), "..")
sys.path.insert(0, ROOT)

from radiolens.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "radiolens-tests")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tables(spark):
    from radiolens.catalog import Tables

    return Tables(spark, SMALL)
