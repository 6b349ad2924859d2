import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from examloom.session import get_session, ship_package

    s = get_session("local[4]", spark__sql__shuffle__partitions="4")
    ship_package(s)
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
