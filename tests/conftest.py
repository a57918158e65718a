import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from aerolake.session import get_session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = get_session("tests", 8, spark__sql__shuffle__partitions="4", spark__driver__memory="8g")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
