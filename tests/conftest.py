import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallyspark.session import session

    s = session("tests", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
                spark__driver__memory="3g", spark__checkpoint__dir="file://" + tempfile.mkdtemp(prefix="tests-"),
                spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="tests-warehouse-"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
