from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from loadgrid.session import build_session, checkpoint_dir

    s = build_session("local[4]", app="loadgrid-tests", shuffle_partitions=4,
                      conf={"spark.ui.showConsoleProgress": "false"})
    s.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(s)
    yield s


def ts(s: str) -> dt.datetime:
    return dt.datetime.fromisoformat(s)


@pytest.fixture
def mk(spark):
    """Build a long table ``series, <ts cols>, Energy`` from tuples."""
    def make(rows, schema="series string, DateTime timestamp_ntz, Energy double"):
        conv = []
        for r in rows:
            conv.append(tuple(ts(v) if isinstance(v, str) and len(v) >= 10 and v[4] == "-" and ":" in v else v
                              for v in r))
        return spark.createDataFrame(conv, schema)
    return make
