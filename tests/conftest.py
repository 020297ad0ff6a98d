import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 8g pyspark-shell")


@pytest.fixture(scope="session")
def spark():
    from filingmatch.session import session
    s = session("local[4]", 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
