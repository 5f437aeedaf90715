import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import session

    s = session("4", 4, spark__sql__adaptive__coalescePartitions__enabled="true", spark__driver__memory="3g")
    yield s
    s.stop()


def rows(df):
    return sorted(map(tuple, df.collect()), key=lambda r: [(x is None, str(x)) for x in r])
