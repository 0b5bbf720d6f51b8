import datetime as dt
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from haulage import schemas  # noqa: E402
from haulage.session import build_session  # noqa: E402
from haulage.sources.tables import Tables  # noqa: E402

SMALL_SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = build_session(master="local[*]", shuffle_partitions=8, app_name="haulage-tests",
                      shared=str(tmp_path_factory.mktemp("shared")))
    yield s
    s.stop()


def D(x):
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


def TS(s):
    return dt.datetime.fromisoformat(s)


@pytest.fixture
def make_tables(spark):
    """Tables from small hand-made row lists (missing tables are empty)."""
    def make(**rows):
        frames = {}
        for name, schema in schemas.ALL.items():
            data = rows.get(name)
            if data is None and name == "roles":
                data = schemas.ROLE_ROWS
            frames[name] = spark.createDataFrame(data or [], schema)
        return Tables(**frames)
    return make
