import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from slotwise.session import get_session  # noqa: E402

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    s = get_session(
        "local[*]",
        app_name="slotwise-tests",
        shuffle_partitions=8,
        conf={"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]
