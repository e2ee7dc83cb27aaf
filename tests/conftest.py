import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark():
    from ledgerline import build_session

    return build_session(cpus=8, partitions=4, app="ledgerline-tests")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
