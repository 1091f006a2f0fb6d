from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from webfrontier.session import build_session  # noqa: E402

SF = "/root/testdata/sf0.001"


# Started here, because the test modules make column expressions when they are imported.
SESSION = build_session("tests", 8)
SESSION.sparkContext.setLogLevel("ERROR")


@pytest.fixture(scope="session")
def spark():
    yield SESSION
    SESSION.stop()


@pytest.fixture(scope="session")
def one(spark):
    """Value of a column expression on a one-row table with the given column ``x``."""

    def value(expression, x, kind="string"):
        return spark.createDataFrame([(x,)], f"x {kind}").select(expression).first()[0]

    return value
