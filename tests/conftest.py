import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from perilake.session import build_session, release  # noqa: E402
from perilake.sources.tables import Lakehouse  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = build_session(
        "tests", "local[8]", 4, spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g", spark__sql__warehouse__dir=f"{scratch}/warehouse", spark__checkpoint__dir=f"{scratch}/checkpoint",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    release(session)
    session.stop()


@pytest.fixture()
def lake(spark, tmp_path):
    prefix = f"t{abs(hash(str(tmp_path))) % 10**8}_"
    made = Lakehouse(spark, str(tmp_path / "lake"), prefix)
    yield made
    for layer in ("bronze", "silver", "gold"):
        spark.sql(f"DROP DATABASE IF EXISTS {made.database(layer)} CASCADE")


def rows(frame):
    return [r.asDict() for r in frame.collect()]
