"""One local session for all tests."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from larkspur import storage
    from larkspur.session import get_session

    s = get_session("tests", "local[4]", spark__ui__enabled="false", spark__sql__shuffle__partitions="4", spark__driver__memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    storage.clean(s)


@pytest.fixture(scope="session")
def sf():
    return SF
