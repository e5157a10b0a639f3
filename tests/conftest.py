from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from riskloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = local_session(4, shuffle_partitions=4, memory="6g", **{"spark.checkpoint.dir": shared})
    session.sparkContext.setLogLevel("ERROR")
    assert session.conf.get("spark.checkpoint.dir") == shared
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """Make a (path, content) table from keyword pairs."""
    def make(*rows):
        return spark.createDataFrame(list(rows), "path string, content string")
    return make
