from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from obsfuse.runtime import session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores=4, **{"spark.sql.shuffle.partitions": 4})
    s.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
