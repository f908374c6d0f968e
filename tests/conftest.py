import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF = os.environ.get("TAPELINE_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from tapeline.session import local_session

    return local_session(shuffle_partitions=4)


@pytest.fixture(scope="session")
def duck():
    from compare import duck

    return duck(SF)


@pytest.fixture(scope="session")
def sf():
    return SF
