import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from lantern.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    s.sparkContext.setLogLevel("ERROR")
    yield s


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
