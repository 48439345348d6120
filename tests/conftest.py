from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from logbasin.session import get_session  # noqa: E402

# An invented line in the quoted layout.
LINE = (
    'Aug  8 03:33:33 www.example.org 10.1.2.1 [10.233.1.14] - "" [08/Aug/2025:03:33:33 -0300]'
    ' "GET /org-1/files/7.js?v=1 HTTP/1.1" 200 905 "-" "Mozilla/5.0 (iPhone) Mobile" Time 4213 Age ""'
    ' "application/javascript" "" - "/Portal/vs-TEPROD" "/Portal/Pool_1" TEPROD'
)


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = get_session(
        "tests",
        **{
            "spark.master": "local[4]",
            "spark.sql.shuffle.partitions": "4",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.sql.warehouse.dir": str(tmp_path_factory.mktemp("warehouse")),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def line():
    return LINE


@pytest.fixture
def lines(spark):
    def make(*values: str):
        """A table of lines; none gives an empty one."""
        return spark.createDataFrame([(v,) for v in values], "value string")

    return make
