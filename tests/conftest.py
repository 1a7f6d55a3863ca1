import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from glyphloom.session import session, ship  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores=4, partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    ship(s)
    return s


@pytest.fixture(scope="session")
def folder():
    if not DATA.exists():
        pytest.skip("no test data here")
    return str(DATA)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
