from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tabsmith.session import local_session  # noqa: E402

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="tabsmith-tests", memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def table(spark):
    def load(name: str):
        path = DATA / f"{name}.parquet"
        if not path.exists():
            pytest.skip(f"no test data at {path}")
        return spark.read.parquet(str(path))

    return load
