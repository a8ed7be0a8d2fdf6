from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from tallyweir.session import build_session

    session = build_session(cpus=4, app="tests", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"})
    yield session
    session.stop()


def same(df, expected: list[tuple], columns: list[str]) -> None:
    """The rows of df, in any order."""
    from tools.compare import cell

    key = repr
    assert sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=key) == sorted((tuple(map(cell, e)) for e in expected), key=key)
